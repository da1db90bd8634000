"""Sources mixed to target weights: exact block quotas split over shards by a multivariate-hypergeometric tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import BEFORE, RANK, number_rows
from ..runtime import materialize

SEED, BLOCK, SHARD_ROWS = 17, 16, 200_000  # rows a shard has at most, about: one task puts them in order


def split_quotas(blocks: dict[str, int], shards: int, rng: np.random.Generator) -> dict[str, list[int]]:
    """Blocks per source and shard. Each tree node draws how many blocks of each source go left, without replacement, so that all quotas come out exact."""
    names = sorted(blocks)
    out = np.zeros((shards, len(names)), dtype=np.int64)

    def draw(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        n = int(have.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, n, method="marginals") if n else np.zeros_like(have)
        draw(lo, mid, left)
        draw(mid, hi, have - left)

    if names:
        draw(0, shards, np.array([blocks[n] for n in names], dtype=np.int64))
    return {n: out[:, i].tolist() for i, n in enumerate(names)}


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, shards: int | None = None, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (doc_id, source, repeat_no, n_tokens, shard, position) and the shares (source, weight, max_repeats, available, quota, tokens, share, target_share).

    ``shards`` (by default as many as keep a shard under SHARD_ROWS rows) are each put in order by one task. ``docs``: doc_id, source, n_tokens; ``targets``: source, weight, max_repeats (one small row per source, read by the driver). Without
    ``total_tokens`` the total is the largest at which every source with documents can give its weight. A source without documents gives none, and its weight is
    spread over the others in proportion; a source without a target, with weight NULL or 0, or with max_repeats NULL or 0 is not drawn. A quota above max_repeats
    times what a source has is cut to that and the share reached shows it. The documents of a source are put in a pseudo-random order of
    their ids; whole passes are drawn first, then the start of one more pass, to the document nearest the quota. So counts of one
    document differ by at most 1 within a source. Repeated target rows count once (largest weight). Documents without tokens are not drawn.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).where("source is not null and n_tokens > 0")
    base = materialize(base.withColumn("perm", F.xxhash64(F.lit(seed), "doc_id")), "sized")  # sizes are read twice below
    wanted = {r["source"]: (float(r["w"]), int(r["m"])) for r in targets.where("source is not null").groupBy("source").agg(F.max("weight").alias("w"), F.max("max_repeats").alias("m")).collect() if (r["w"] or 0) > 0 and (r["m"] or 0) > 0}
    numbered = materialize(number_rows(base.where(F.col("source").isin(*wanted) if wanted else F.lit(False)), ["source"], ["perm", "doc_id"], weight="n_tokens", sort_globally=True), "mix")
    have = {r["source"]: (r["n"], r["t"]) for r in numbered.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    live = {s: wanted[s] for s in wanted if s in have}
    weight = sum(w for w, _ in live.values()) or 1.0
    if total_tokens is None:
        total_tokens = int(min((m * have[s][1] * weight / w for s, (w, m) in live.items()), default=0))
    quota = {s: min(round(total_tokens * w / weight), m * have[s][1]) for s, (w, m) in live.items()}
    plan = spark.createDataFrame([(s, quota[s] // have[s][1], quota[s] % have[s][1], have[s][0]) for s in sorted(quota)], "source string, passes long, rest long, docs long")
    drawn = numbered.join(F.broadcast(plan), "source")  # one row per target source
    times = F.col("passes") + F.when(F.col(BEFORE) + F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    drawn = drawn.withColumn("__times", times).where("__times > 0")
    stream = drawn.select("doc_id", "source", "n_tokens", "docs", F.col(RANK).alias("r"), F.explode(F.expr("sequence(0L, __times - 1)")).alias("repeat_no"))
    stream = stream.withColumn("block", F.expr(f"(repeat_no * docs + r) div {block}"))
    rows = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.sum("__times").alias("n")).collect()}
    shards = shards or max(1, -(-sum(rows.values()) // SHARD_ROWS))
    quotas = split_quotas({s: -(-n // block) for s, n in rows.items()}, shards, np.random.default_rng(seed))
    where = spark.createDataFrame([(s, np.cumsum(per).tolist()) for s, per in quotas.items()], "source string, ends array<long>")  # one row per target source
    shard = F.expr("size(filter(ends, x -> x <= block))")  # the shard whose blocks reach beyond this one
    placed = stream.join(F.broadcast(where), "source").withColumn("shard", shard.cast("int"))
    inside = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "repeat_no"), "doc_id", "repeat_no")
    out = placed.withColumn("position", F.row_number().over(inside) - 1).select("doc_id", "source", F.col("repeat_no").cast("int").alias("repeat_no"), "n_tokens", "shard", "position")
    given = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("__times")).alias("tokens"), F.max("__times").alias("most_repeats"))
    every = spark.createDataFrame([(s, w, m, have.get(s, (0, 0))[1], quota.get(s, 0)) for s, (w, m) in sorted(wanted.items())], "source string, weight double, max_repeats int, available long, quota long")
    shares = every.join(given, "source", "left").fillna(0, ["tokens", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy())  # one row per target source
    shares = shares.withColumn("share", F.round(F.col("tokens") / F.nullif(whole, F.lit(0)), 6)).withColumn("target_share", F.round("weight", 6))
    return out, shares
