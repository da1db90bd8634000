"""Per-key work on skewed keys by exact offset chunking.

Rows are counted per key and input partition, the counts are prefix-summed over the partitions, and
each row's number within its key is its partition's offset plus its place there. No step gathers a
key: the only window over rows is keyed by (partition, key), so a key with a third of all rows is
spread over all partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

PID, RANK, BEFORE = "__pid", "__rank", "__before"


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), weight: str | None = None, sort_globally: bool = False) -> DataFrame:
    """Add ``__rank`` (0-based number within the key) and, with ``weight``, ``__before`` (weight of the key's earlier rows).

    ``order`` breaks ties inside an input partition; give enough columns for a total order if the numbers
    must be the same in every run. With ``sort_globally`` rows are range-partitioned by (keys, order) first, so that the
    numbers follow ``order`` over the whole key. NULL keys form a key of their own. An empty input gives
    an empty result. Rows equal in all of ``order`` get consecutive numbers in either order.
    """
    taken = [c for c in df.columns if c in (PID, RANK, BEFORE)]
    if taken:
        raise ValueError(f"columns {taken} are reserved")
    if sort_globally:
        df = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    rows = materialize(df.withColumn(PID, F.spark_partition_id()), "numbered")
    sums = [F.count(F.lit(1)).alias("__n")] + ([F.sum(weight).alias("__w")] if weight else [])
    ahead = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(PID, *keys).agg(*sums)
    offsets = offsets.select(
        F.col(PID).alias("__opid"),
        *[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__off"),
        *([F.coalesce(F.sum("__w").over(ahead), F.lit(0)).alias("__woff")] if weight else []),
    )
    inside = Window.partitionBy(PID, *keys).orderBy(*(order or [F.lit(0)]))
    placed = rows.withColumn("__place", F.row_number().over(inside) - 1)
    if weight:
        placed = placed.withColumn("__wplace", F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = (F.col(PID) == F.col("__opid")) & _all_equal(keys)
    out = placed.join(offsets, on)
    cols = [*df.columns, (F.col("__off") + F.col("__place")).alias(RANK)]
    if weight:
        cols.append((F.col("__woff") + F.col("__wplace")).alias(BEFORE))
    return out.select(*cols)


def _all_equal(keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__o{i}"))
    return on


def chunked_key_stats(df: DataFrame, keys: Sequence[str], latest: str | None = None, order: Sequence[str] = (), chunk_rows: int = 100_000) -> DataFrame:
    """One row per key: ``n_rows``, ``n_chunks`` and, with ``latest``, the largest value of that column.

    Each key's numbered rows are cut into chunks of ``chunk_rows``; a chunk yields a state (first and last
    number, count, largest value), and the ordered states are merged. The merge checks that each state holds as many rows as numbers
    and begins where the one before ended; anything else would mean that rows were lost or doubled, and fails the job.
    NULL keys are a key; NULLs in ``latest`` are passed over (all NULL: NULL); no rows: no result rows.
    """
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be at least 1")
    rows = number_rows(df.select(*keys, *dict.fromkeys([*([latest] if latest else []), *order])), keys, order)
    extra = [F.max(latest).alias("__latest")] if latest else []
    states = rows.groupBy(*keys, F.expr(f"{RANK} div {chunk_rows}").alias("__chunk")).agg(
        F.count(F.lit(1)).alias("__n"), F.min(RANK).alias("__first"), F.max(RANK).alias("__last"), *extra
    )
    ahead = Window.partitionBy(*keys).orderBy("__chunk")  # one row per chunk: rows / chunk_rows of a key at most
    touches = (F.col("__first") == F.coalesce(F.lag("__last").over(ahead) + 1, F.lit(0))) & (F.col("__n") == F.col("__last") - F.col("__first") + 1)
    checked = F.when(touches, F.col("__n")).otherwise(F.raise_error(F.lit("chunk states of a key do not touch")).cast("long"))
    return states.withColumn("__n", checked).groupBy(*keys).agg(
        F.sum("__n").alias("n_rows"), F.count(F.lit(1)).alias("n_chunks"), *([F.max("__latest").alias(f"latest_{latest}")] if latest else []),
    )


def with_distinct(stats: DataFrame, df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``stats`` (one row per key) with the number of distinct non-NULL values that each key has in ``df``, 0 for none.

    Pairs of key and value are reduced before the shuffle and spread by both, so no key is hot; they travel as two pairs of 64-bit hashes instead of texts, and meet the key's text in ``stats`` only.
    """
    h = lambda k: [F.xxhash64(*k), F.xxhash64(F.lit(1), *k)]
    (k1, k2), (v1, v2) = h([F.col(k) for k in keys]), h([F.col(value)])
    pairs = df.where(F.col(value).isNotNull()).select(k1.alias("__k"), k2.alias("__k2"), v1.alias("__v"), v2.alias("__v2")).distinct()
    counts = pairs.groupBy("__k", "__k2").agg(F.count(F.lit(1)).alias("__n"))
    out = stats.withColumn("__h", k1).withColumn("__h2", k2).join(counts, (F.col("__h") == F.col("__k")) & (F.col("__h2") == F.col("__k2")), "left")
    return out.select(*stats.columns, F.coalesce("__n", F.lit(0)).alias(name))
