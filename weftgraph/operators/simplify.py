"""Near-duplicate nodes merged by vector similarity, without chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize


FEW = 100_000  # open pairs from which the driver ends the greedy order itself, so that long chains need no round a link


def merge_map(pairs: DataFrame, degrees: DataFrame, few: int = FEW) -> DataFrame:
    """(merged, keeper) from similar pairs (a, b, score): the strongest pairs first, the node of higher degree keeps (ties: the smaller), and no node is both kept and merged.

    The greedy order by (score, keeper, merged), found without sorting all pairs in one place: in a round a keeper takes every node whose best open pair leads to it, unless a better open pair merges the keeper
    itself; pairs of merged nodes, and those that would merge a keeper, then fall away. Rounds go on until no pair is open; at most ``few`` open pairs are put in order on the driver, with the same result.
    A keeper is never merged later, so every merged node is directly similar to its keeper.
    """
    d = degrees.select(F.col("node").alias("n"), "degree")
    p = pairs.select("a", "b", "score").where("a <> b").distinct()
    p = p.join(d, p.a == d.n, "left").select("a", "b", "score", F.coalesce("degree", F.lit(0)).alias("da"))
    p = p.join(d, p.b == d.n, "left").select("a", "b", "score", "da", F.coalesce("degree", F.lit(0)).alias("db"))
    keep_a = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") <= F.col("b")))
    keeper, merged = F.when(keep_a, F.col("a")).otherwise(F.col("b")), F.when(keep_a, F.col("b")).otherwise(F.col("a"))
    # least first; NULL scores come last, NaN first
    place = F.struct(F.col("score").isNull().alias("none"), (~F.isnan("score")).alias("number"), (-F.col("score")).alias("low"), keeper.alias("keeper"), merged.alias("merged"))
    open_ = materialize(p.select(place.alias("pair")), "pairs")
    done, i = None, 0
    while (n := open_.count()) > few:
        best = open_.select("pair", F.explode(F.array("pair.keeper", "pair.merged")).alias("n")).groupBy("n").agg(F.min("pair").alias("best"), F.min(F.when(F.col("pair.merged") == F.col("n"), F.col("pair"))).alias("falls"))
        best = materialize(best, f"best{i}")
        first = best.where("best.merged = n").select("best")
        falls = best.where("falls is not null").select(F.col("n").alias("k"), "falls")
        taken = materialize(first.join(falls, F.col("best.keeper") == F.col("k"), "left").where("falls is null or best < falls").select("best.merged", "best.keeper"), f"taken{i}")
        done = taken if done is None else done.unionByName(taken)
        gone = taken.select(F.col("merged").alias("x"))
        shut = gone.unionByName(taken.select(F.col("keeper").alias("x"))).distinct()
        open_ = materialize(open_.join(shut, F.col("pair.merged") == F.col("x"), "left_anti").join(gone, F.col("pair.keeper") == F.col("x"), "left_anti"), f"open{i}")
        i += 1
    if n:
        kept: set = set()
        to: dict = {}
        for r in open_.orderBy("pair").select("pair.keeper", "pair.merged").collect():
            if r.keeper not in to and r.merged not in to and r.merged not in kept:
                to[r.merged] = r.keeper
                kept.add(r.keeper)
        node = open_.schema["pair"].dataType["keeper"].dataType.simpleString()
        rest = materialize(open_.sparkSession.createDataFrame(list(to.items()), f"merged {node}, keeper {node}"), "rest")
        done = rest if done is None else done.unionByName(rest)
    return done if done is not None else open_.select("pair.merged", "pair.keeper")
