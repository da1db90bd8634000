"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

HOT_ROWS = 50_000


def inherits_links(edges: DataFrame, edge_type: str = "INHERITS") -> DataFrame:
    """(child, parent): child is the first source, parent the first target that is not NULL or blank, both normalised; others make no link."""
    from ..functions.names import clean_nodes, clean_type

    e = edges.where(clean_type(F.col("edge_type")) == edge_type)
    both = e.select(F.get(clean_nodes(F.col("sources")), F.lit(0)).alias("child"), F.get(clean_nodes(F.col("targets")), F.lit(0)).alias("parent"))
    return both.where(F.col("child").isNotNull() & F.col("parent").isNotNull())


def _jump(active: DataFrame, steps: DataFrame, with_path: bool, hot_rows: int) -> DataFrame:
    """Join each active pointer with the pointer of the node it reached.

    ``steps`` has one row per node. Nodes reached by more than ``hot_rows`` pointers are served by a broadcast:
    they are at most rows / hot_rows many, so with hot_rows growing with the input (see resolve_hierarchy) at most 1,000.
    """
    right = steps.select(F.col("node").alias("__n"), F.col("anc").alias("__anc"), F.col("dist").alias("__dist"), F.col("done").alias("__done"), *([F.col("path").alias("__path")] if with_path else []))
    hot = active.groupBy("anc").count().where(F.col("count") > hot_rows).select(F.col("anc").alias("__hot"))
    tagged = active.join(F.broadcast(hot), F.col("anc") == F.col("__hot"), "left")
    hot_right = right.join(F.broadcast(hot), F.col("__n") == F.col("__hot"), "left_semi")
    cold = tagged.where("__hot is null").join(right, F.col("anc") == F.col("__n"), "left")
    warm = tagged.where("__hot is not null").join(F.broadcast(hot_right), F.col("anc") == F.col("__n"), "left")
    both = cold.unionByName(warm)
    path = [F.when(F.col("__n").isNull(), F.col("path")).otherwise(F.concat("path", "__path")).alias("path")] if with_path else []
    return both.select(
        "node",
        F.coalesce("__anc", "anc").alias("anc"),
        (F.col("dist") + F.coalesce("__dist", F.lit(0))).alias("dist"),
        F.coalesce("__done", F.lit(True)).alias("done"),  # what was reached has no parent: it is a root
        *path,
    )


def resolve_hierarchy(links: DataFrame, with_path: bool = False, hot_rows: int | None = None) -> DataFrame:
    """One row per child: ``node``, ``root``, ``depth_from_root`` and, with ``with_path``, ``path`` (node first, root last).

    ``links`` has columns child and parent. Each round joins every unresolved pointer with the pointer of the node it
    reached, doubling the jump: after k rounds all nodes at depth 2^k or less are resolved. A deeper node has an
    ancestor at every depth between, so a round that resolves none leaves only nodes on cycles or leading into one:
    root '' and depth -1 (path NULL). Repeated links count once; of several parents of a child the alphabetically
    first counts; rows with a NULL child or parent are no links; a self-link is a cycle; no links, no rows.
    """
    clean = links.where(F.col("child").isNotNull() & F.col("parent").isNotNull())
    one = clean.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("anc"))
    start = one.select("node", "anc", F.lit(1).alias("dist"), F.lit(False).alias("done"), *([F.array("anc").alias("path")] if with_path else []))
    steps = materialize(start, "links")
    total = open_ = steps.count()
    resolved: list[DataFrame] = []
    active, round_ = steps, 0
    while open_:
        limit = hot_rows or max(HOT_ROWS, total // 1000)
        after = materialize(_jump(active, active, with_path, limit) if not resolved else _jump(active, _union([active, *resolved]), with_path, limit), f"round{round_}")
        left = after.where("not done").count()
        resolved.append(after.where("done"))
        active = after.where("not done")
        round_ += 1
        if left == open_:
            break
        open_ = left
    cols = ["node", F.col("anc").alias("root"), F.col("dist").alias("depth_from_root")] + ([F.concat(F.array("node"), F.col("path")).alias("path")] if with_path else [])
    cyclic = active.select("node", F.lit("").alias("root"), F.lit(-1).alias("depth_from_root"), *([F.lit(None).cast("array<string>").alias("path")] if with_path else []))
    if not resolved:
        return cyclic.limit(0)
    return _union([r.select(*cols) for r in resolved]).unionByName(cyclic)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every node with a path; spread by row, so a root with most nodes below it is no hot group."""
    return resolved.where(F.col("path").isNotNull()).select(F.col("node").alias("descendant"), F.posexplode("path").alias("distance", "ancestor")).where("distance > 0").select("ancestor", "descendant", "distance")
