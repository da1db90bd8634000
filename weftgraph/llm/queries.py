"""Queries of the training-data problems; those with a plain SQL form have it here too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import clean_nodes
from ..runtime import table
from .generated import not_by_hand
from .heavy_hitters import heavy_hitters
from .mixing import mix
from .packing import pack
from .pii import find_pii, redact
from .splitting import split_oversized
from .syntax import check_files, fault_rates
from .tokens import with_tokens

SHARE = 0.005


def node_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Every element of both columns once, normalised, NULL and blank ones dropped."""
    t = table(spark, sf, "hyperedges").select(F.lit("targets").alias("field"), F.explode(clean_nodes(F.col("targets"))).alias("value"))
    m = table(spark, sf, "scored_edges").select(F.lit("matched_nodes").alias("field"), F.explode(clean_nodes(F.col("matched_nodes"))).alias("value"))
    return t.unionByName(m)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf, "chunks"))
    return pieces.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and chunk_id is not null").select("chunk_id")


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(table(spark, sf, "chunks")).distinct()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sketch candidates, then exact counts of these alone. At most 1/SHARE (1 + error) candidates a field pass, so the broadcast is bounded."""
    stream = node_stream(spark, sf)
    likely = heavy_hitters(stream).where(F.col("est_count") >= SHARE * F.col("total")).select("field", "value", "total")
    exact = stream.join(F.broadcast(likely), ["field", "value"]).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))
    return exact.where(F.col("n") >= SHARE * F.col("total")).select("field", F.col("value").alias("node"))


def p3_top_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 most frequent names of each column by sketch, with approximate counts."""
    from pyspark.sql import Window

    w = Window.partitionBy("field").orderBy(F.desc("est_count"), "value")
    return heavy_hitters(node_stream(spark, sf)).withColumn("place", F.row_number().over(w)).where("place <= 100").select("field", F.col("value").alias("node"), "est_count", "total", "place")


def p4_files(spark: SparkSession, sf: str) -> DataFrame:
    return not_by_hand(table(spark, sf, "converted_documents"), table(spark, sf, "library_files"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_files(spark, sf).where("kind <> ''").select("source_path")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return check_files(table(spark, sf, "converted_documents")).where("edit_cost > 0").select("source_path")


def p5_files(spark: SparkSession, sf: str) -> DataFrame:
    return check_files(table(spark, sf, "converted_documents"))


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    return fault_rates(p5_files(spark, sf))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack(with_tokens(table(spark, sf, "documents").select("doc_id", "text")).drop("text"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Fill of every container."""
    return p7_containers(spark, sf).groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = with_tokens(table(spark, sf, "documents").select("doc_id", "source", "text")).drop("text")
    return mix(docs, table(spark, sf, "mix_targets"))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    found = find_pii(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "person_lexicon"))
    return found.select("doc_id", "kind", "start_pos").distinct()


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return redact(docs, find_pii(docs, table(spark, sf, "person_lexicon")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p3_top_nodes, p4_found, p4_files, p5_found, p5_files, p5_rates, p7_containers, p7_fill, p8_mixture, p8_shares, p9_found, p9_redacted)}


_NORM = r"trim(regexp_replace({}, '[\x00-\x1f\x7f\s]+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    norm = _NORM.format("x")
    return {
        "p1_found": """
            SELECT chunk_id FROM (SELECT chunk_id, text, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, loaded_at DESC NULLS LAST) AS r FROM chunks)
            WHERE r = 1 AND length(text) > 2000""",
        "p3_found": f"""
            WITH e AS (SELECT 'targets' AS field, unnest(targets) AS x FROM hyperedges UNION ALL SELECT 'matched_nodes', unnest(matched_nodes) FROM scored_edges),
            c AS (SELECT field, {norm} AS node, count(*) AS n FROM e WHERE x IS NOT NULL AND {norm} <> '' GROUP BY ALL)
            SELECT field, node FROM (SELECT *, sum(n) OVER (PARTITION BY field) AS total FROM c) WHERE n >= 0.005 * total""",
    }
