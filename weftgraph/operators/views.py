"""Node and edge tables for drawing: tour subgraphs, groups, focus windows, and a force layout for what is shown."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name, last_segment, parent_dir, path_stem
from .graph import Hypergraph
from .traverse import first_files, hop_distances, pairwise

# Rest length and stiffness of an edge type's spring; languages by extension (fixed values).
SPRINGS = {"DEFINES": (40.0, 0.05), "INHERITS": (80.0, 0.03), "CALLS": (150.0, 0.015), "IMPORTS": (120.0, 0.01), "SIGNATURE": (60.0, 0.02), "RAISES": (100.0, 0.015), "DECORATES": (50.0, 0.03)}
LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "rb": "ruby", "php": "php"}
SHOWN = 5000


def language(path):
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))), F.lit("other"))


def group_of(node, path):
    """Folder of the file, else its stem; without a file the first segment of the name, else 'other'."""
    up = file_name(parent_dir(path))
    by_file = F.when((up != "") & ~up.startswith("."), up).otherwise(path_stem(path))
    return F.when(F.coalesce(path, F.lit("")) != "", by_file).when(F.contains(node, F.lit(".")), F.substring_index(node, ".", 1)).otherwise("other")


def expand_seeds(g: Hypergraph, seeds: DataFrame) -> DataFrame:
    """Nodes tied to the seeds: equal, a seed's member (seed.x), a qualified form (x.seed), or a dotted seed's last segment. The few dotted cuts of each name make it an equi-join."""
    names = g.degrees().select("node", F.split("node", r"\.").alias("p"))
    heads = F.expr("transform(sequence(1, size(p)), k -> array_join(slice(p, 1, k), '.'))")
    tails = F.expr("transform(sequence(1, size(p)), k -> array_join(slice(p, size(p) - k + 1, k), '.'))")
    cuts = names.select("node", F.explode(F.array_distinct(F.concat(heads, tails))).alias("key"))
    keys = seeds.select(F.col("node").alias("key")).distinct()
    last = seeds.where(F.contains("node", F.lit("."))).select(last_segment(F.col("node")).alias("node")).distinct()
    return cuts.join(keys, "key", "left_semi").select("node").unionByName(names.join(last, "node", "left_semi").select("node")).distinct()


def subgraph(g: Hypergraph, seeds: DataFrame, edge_types: Sequence[str] | None = None, max_hops: int = 2, shown: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the seeds: nodes with label, file, group, language, degree, importance (seeds at least 15), hops and focus (all seeds, then the nearest and most important up to ``shown``)."""
    hops = hop_distances(g, seeds, edge_types, max_hops)
    n = hops.join(pairwise(g), "node", "left").join(first_files(g), "node", "left").fillna(0, ["degree", "calls", "inherits", "importance"]).fillna("", ["source_path"])
    n = n.withColumn("importance", F.when(F.col("hops") == 0, F.greatest("importance", F.lit(15))).otherwise(F.col("importance")))
    order = Window.orderBy("hops", F.desc("importance"), "node")
    best = n.orderBy("hops", F.desc("importance"), "node").limit(shown).withColumn("focus", F.row_number().over(order)).select("node", "focus")  # at most ``shown`` rows
    n = n.join(F.broadcast(best), "node", "left")
    nodes = n.select("node", last_segment(F.col("node")).alias("label"), F.col("source_path").alias("file"), group_of(F.col("node"), F.col("source_path")).alias("grp"), language(F.col("source_path")).alias("language"), "degree", "importance", "hops", "focus")
    near = hops.select("node")
    arcs = g.arcs.where(F.col("edge_type").isin(*edge_types)) if edge_types else g.arcs
    edges = arcs.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, edges.groupBy(F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type").agg(F.min("source_path").alias("file"))


# Codes of edge types in a drawing (fixed values, in order).
TYPE_CODES = ("CALLS", "IMPORTS", "DEFINES", "INHERITS", "SIGNATURE", "RAISES", "DECORATES", "TEXT", "SUMMARY")


def radius(importance):
    """Size of a node's circle by its importance (fixed values)."""
    return F.when(importance >= 30, 10.0).when(importance >= 15, 7.0).when(importance >= 5, 4.5).otherwise(2.5)


def highlight(text, symbols: Sequence[str], generic: Sequence[str] = ()):
    """Text with the given symbols (and the last segments of dotted ones) set off, the longest first; those of 3 characters or fewer and ``generic`` ones are left alone. Symbols are a screen's worth."""
    names = {x for s in symbols for x in (s, s.rsplit(".", 1)[-1]) if len(x) > 3} - set(generic)
    if not names:
        return text
    quoted = "|".join("\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E" for x in sorted(names, key=lambda x: (-len(x), x)))
    return F.regexp_replace(text, rf"(?<![<\w.])(?:{quoted})(?![>\w])", "<strong class='tc'>$0</strong>")


def most_important(nodes: DataFrame, n: int = SHOWN) -> DataFrame:
    """The ``n`` nodes (node, importance) to lay out where there are more, ties by name."""
    return nodes.orderBy(F.desc("importance"), "node").limit(n)


def place_rest(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, x, y) of all nodes (node, grp): those of ``placed`` (node, x, y; at most SHOWN) stay, the others lie around the middle of their group's placed nodes (the origin where it has none), in a disc that grows with the group.

    Angle and distance come from hashes of the name, so a group with most of the nodes needs no order within it.
    """
    known = F.broadcast(placed.select("node", "x", "y"))
    x = nodes.select("node", "grp").join(known, "node", "left")
    per = x.groupBy("grp").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))
    part = lambda k: F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(1 << 30)) / float(1 << 30)
    angle, far = 2 * 3.141592653589793 * part(1), F.sqrt(part(2)) * (20 + 4 * F.sqrt("n"))
    y = x.join(per, "grp")
    return y.select("node", F.round(F.coalesce("x", F.coalesce("cx", F.lit(0.0)) + far * F.cos(angle)), 2).alias("x"), F.round(F.coalesce("y", F.coalesce("cy", F.lit(0.0)) + far * F.sin(angle)), 2).alias("y"))


def full_edges(g: Hypergraph) -> DataFrame:
    """(source, target, edge_type, file): every pair that an edge of any type ties, once per type, with the first file in order; no loops."""
    a = g.arcs.where("src <> dst")
    return a.groupBy(F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type").agg(F.min("source_path").alias("file"))


def top_nodes(g: Hypergraph, n: int) -> DataFrame:
    """The ``n`` nodes at the most arc ends, ties by name."""
    a = g.arcs
    return a.select(F.col("src").alias("node")).unionByName(a.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(n)


def compact(shown: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, files) of a drawing as numbers: nodes and files in order with their place (idx), edges as places of source, target and file (-1 for none) and the code of their type (0 for others). At most SHOWN nodes are shown, so the numbering is small."""
    few = shown.select("node").distinct().limit(SHOWN)
    nodes = few.select("node", (F.row_number().over(Window.orderBy("node")) - 1).alias("idx"))
    src, dst = nodes.select(F.col("node").alias("source"), F.col("idx").alias("s")), nodes.select(F.col("node").alias("target"), F.col("idx").alias("t"))
    kept = edges.join(F.broadcast(src), "source").join(F.broadcast(dst), "target")
    files = kept.where("file <> ''").select("file").distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("idx"))
    code = F.greatest(F.array_position(F.array(*map(F.lit, TYPE_CODES)), F.col("edge_type")) - 1, F.lit(0)).cast("int")
    out = kept.join(files.withColumnRenamed("idx", "f"), "file", "left").select(F.col("s").alias("source"), F.col("t").alias("target"), code.alias("type"), F.coalesce("f", F.lit(-1)).alias("file"))
    return nodes, out, files


def layout(nodes: list[str], edges: list[tuple[str, str, str]], steps: int = 150, seed: int = 42) -> dict[str, tuple[float, float]]:
    """Positions within ±1000 of at most SHOWN nodes: springs by edge type, repulsion in grid cells and between cell centres, damped steps. Drawing is for one screen, so this runs on the driver."""
    if len(nodes) > SHOWN:
        raise ValueError(f"choose at most {SHOWN} nodes to draw")
    if not nodes:
        return {}
    at = {n: i for i, n in enumerate(nodes)}
    r = np.random.default_rng(seed)
    pos, vel = r.uniform(-300, 300, (len(nodes), 2)), np.zeros((len(nodes), 2))
    known = [(at[a], at[b], *SPRINGS.get(t, (120.0, 0.015))) for a, b, t in edges if a in at and b in at and a != b]
    e = np.array(known, dtype=float).reshape(-1, 4)
    src, dst = e[:, 0].astype(int), e[:, 1].astype(int)
    for _ in range(steps):
        force = -0.002 * pos
        if len(e):
            d = pos[dst] - pos[src]
            far = np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-6)
            pull = d / far * (far - e[:, 2:3]) * e[:, 3:4]
            np.add.at(force, src, pull)
            np.add.at(force, dst, -pull)
        if len(nodes) <= 300:
            d = pos[:, None] - pos[None]
            q = (d**2).sum(2) + 1.0
            force += (800.0 * d / q[:, :, None]).sum(1)
        else:
            lo, hi = pos.min(0), pos.max(0)
            cell = np.minimum(((pos - lo) / np.maximum(hi - lo, 1e-9) * 32).astype(int), 31)
            key = cell[:, 0] * 32 + cell[:, 1]
            n = np.bincount(key, minlength=1024)
            mid = np.stack([np.bincount(key, pos[:, k], 1024) for k in (0, 1)], 1) / np.maximum(n, 1)[:, None]
            used = np.flatnonzero(n)
            d = pos[:, None] - mid[used][None]
            q = (d**2).sum(2) + 25.0
            force += (800.0 * n[used][None, :, None] * d / q[:, :, None]).sum(1)
        vel = (vel + force) * 0.85
        size = np.maximum(np.linalg.norm(vel, axis=1, keepdims=True), 1e-9)
        pos = pos + vel / size * np.minimum(size, 50.0)
    pos = pos - pos.mean(0)
    pos *= 1000.0 / max(np.abs(pos).max(), 1e-9)
    return {n: (round(float(pos[i, 0]), 2), round(float(pos[i, 1]), 2)) for n, i in at.items()}
