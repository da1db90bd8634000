"""Edges kept up to date from a stream of edge files: each micro-batch is deduplicated against what is there and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import canonical_edges
from ..runtime import children, exists, materialize, release


def edge_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


BUCKETS = 256


def ingest(stream: DataFrame, out: str, checkpoint: str):
    """Start a query that appends new canonical edges to ``out``. A batch is written to its own folder by batch id, so a repeated batch overwrites itself and no edge_id is stored twice.

    Edges lie in BUCKETS folders by the hash of their id, and a batch is held against the ids of its own buckets only.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        edges = materialize(canonical_edges(batch).withColumn("bucket", F.pmod(F.xxhash64("edge_id"), F.lit(BUCKETS)).cast("int")), "batch")
        if exists(spark, out) and any(name != f"batch={batch_id}" for name in children(spark, out)):
            own = [r[0] for r in edges.select("bucket").distinct().collect()]  # at most BUCKETS
            known = spark.read.parquet(out).where((F.col("batch") != batch_id) & F.col("bucket").isin(own)).select("edge_id")
            fresh = edges.join(known, "edge_id", "left_anti")
        else:
            fresh = edges
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/batch={batch_id}")
        release(edges)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_rates(stream: DataFrame, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Edges loaded per day and type, late rows within the watermark counted."""
    return stream.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", width), F.upper(F.trim("edge_type")).alias("edge_type")).agg(F.count(F.lit(1)).alias("n"))
