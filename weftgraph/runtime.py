"""Session helpers: the shared folder for intermediate tables, and tables read by name."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = _written.setdefault("local", [])
    if not own:
        own.append(tempfile.mkdtemp(prefix="weftgraph-"))
    return own[0]


def files(spark: SparkSession, path: str):
    """(file system, path) of the cluster's own file API, so that shared and remote folders work like local ones."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = files(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, p = files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = files(spark, path)
    fs.delete(p, True)


def stamp(spark: SparkSession, path: str) -> tuple:
    """(path, length, latest change) of a table's files: it differs after any rewrite."""
    fs, p = files(spark, path)
    one = fs.getFileStatus(p)
    found = [one] if one.isFile() else list(fs.listStatus(p))
    return path, sum(x.getLen() for x in found), max([one.getModificationTime(), *(x.getModificationTime() for x in found)])


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs at most the re-read of files, and two readers see the
    same rows in the same files even where the plan samples (range partitioning).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weftgraph-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a frame of ``materialize``; nothing lazy may still read it."""
    path = getattr(df, "_weft_path", None)
    if path:
        _delete(df.sparkSession, path)
        kept = _written.get(df.sparkSession.sparkContext.applicationId, [])
        if path in kept:
            kept.remove(path)


def release_all(spark: SparkSession) -> None:
    """Delete every intermediate table of this application."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
