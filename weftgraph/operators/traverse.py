"""Level-wise traversals: typed breadth-first search, hop distances, edge paths. Each level is a join; state is cut into a table per level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .graph import Hypergraph


def bfs(g: Hypergraph, seeds: DataFrame, depth: int = 2, direction: str = "forward", edge_types: Sequence[str] | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """(edge_id, node, level): each edge once, with the frontier node it was first reached from.

    An edge touched by the frontier counts as visited before its direction is tested, so in forward mode an edge first met from its target side is not met again.
    Of several frontier nodes that meet an edge at a level the alphabetically first counts. Hubs are reported as reached but not gone on from.
    Seeds have a column node. Duplicate, unknown and NULL seeds do no harm.
    """
    if direction not in ("forward", "backward", "both"):
        raise ValueError(direction)
    edges = g.edges.where(F.col("edge_type").isin(*edge_types)) if edge_types else g.edges
    ends = edges.select("edge_id", "sources", "targets")
    inc = edges.select("edge_id", F.explode("all_nodes").alias("node"))
    frontier = materialize(seeds.select("node").where("node is not null").distinct(), "frontier")
    visited_nodes, visited_edges, found = frontier, None, None
    for level in range(1, depth + 1):
        cand = inc.join(frontier, "node")
        if visited_edges is not None:
            cand = cand.join(visited_edges, "edge_id", "left_anti")
        # the lists are fetched for edges met at this level only
        first = materialize(cand.groupBy("edge_id").agg(F.min("node").alias("node")).join(ends, "edge_id"), f"bfs{level}")
        from_source, from_target = F.array_contains("sources", F.col("node")), F.array_contains("targets", F.col("node"))
        passed = first.where(F.lit(True) if direction == "both" else from_source if direction == "forward" else from_target)
        emitted = passed.select("edge_id", "node", F.lit(level).alias("level"))
        found = emitted if found is None else found.unionByName(emitted)
        visited_edges = first.select("edge_id") if visited_edges is None else visited_edges.unionByName(first.select("edge_id"))
        other = F.when(from_source, F.col("targets")).otherwise(F.col("sources"))
        after = passed.select(F.explode(other).alias("node")).distinct().join(visited_nodes, "node", "left_anti")
        if hubs is not None:
            after = after.join(hubs.select("node"), "node", "left_anti")
        frontier = materialize(after, f"next{level}")
        visited_nodes = visited_nodes.unionByName(frontier)
        if frontier.isEmpty():
            break
    return found


def hop_distances(g: Hypergraph, seeds: DataFrame, edge_types: Sequence[str] | None = None, max_hops: int = 0) -> DataFrame:
    """(node, hops): any member of an edge reaches every other; 0 hops at the seeds that occur; max_hops 0 is no limit. Each edge is gone through once, so a hub costs one level."""
    edges = g.edges.where(F.col("edge_type").isin(*edge_types)) if edge_types else g.edges
    inc = materialize(edges.select("edge_id", F.explode(F.array_distinct(F.concat("sources", "targets"))).alias("node")), "hops")
    frontier = materialize(inc.join(seeds.select("node").distinct(), "node", "left_semi").select("node").distinct(), "hop0")
    done = frontier.select("node", F.lit(0).alias("hops"))
    seen_edges = None
    hop = 0
    while not frontier.isEmpty() and (not max_hops or hop < max_hops):
        hop += 1
        met = inc.join(frontier, "node", "left_semi").select("edge_id").distinct()
        if seen_edges is not None:
            met = met.join(seen_edges, "edge_id", "left_anti")
        met = materialize(met, f"met{hop}")
        frontier = materialize(inc.join(met, "edge_id", "left_semi").select("node").distinct().join(done, "node", "left_anti"), f"hop{hop}")
        seen_edges = met if seen_edges is None else seen_edges.unionByName(met)
        done = done.unionByName(frontier.select("node", F.lit(hop).alias("hops")))
    return done


def find_paths(g: Hypergraph, source: str, target: str, k: int = 3, max_depth: int = 10) -> DataFrame:
    """(path, length): up to ``k`` shortest edge paths whose neighbouring edges share a node, as edge ids joined by '>'. An edge that holds both ends is a path of its own; else each edge is reached once, from the first path in order."""
    inc = materialize(g.incidence.select("edge_id", "node"), "path")
    ends = inc.where(F.col("node") == target).select("edge_id").distinct()
    starts = inc.where(F.col("node") == source).select("edge_id").distinct()
    direct = starts.join(ends, "edge_id", "left_semi").select(F.col("edge_id").alias("path"), F.lit(1).alias("length"))
    if not direct.isEmpty():
        return direct.orderBy("path").limit(k)
    paths = materialize(starts.select("edge_id", F.col("edge_id").alias("path")), "path1")
    seen, found, n, length = paths.select("edge_id"), None, 0, 1
    while length < max_depth and not paths.isEmpty():
        length += 1
        over = paths.join(inc, "edge_id").groupBy("node").agg(F.min("path").alias("path"))  # one path a node is enough to reach its edges
        step = over.join(inc, "node").join(seen, "edge_id", "left_anti").groupBy("edge_id").agg(F.min("path").alias("path"))
        paths = materialize(step.select("edge_id", F.concat_ws(">", "path", "edge_id").alias("path")), f"path{length}")
        seen = seen.unionByName(paths.select("edge_id"))
        hit = paths.join(ends, "edge_id", "left_semi").select("path", F.lit(length).alias("length"))
        got = hit.count()
        if got:
            found = hit if found is None else found.unionByName(hit)
        n += got
        if n >= k or (n and not got):
            break
    if found is None:
        return direct.limit(0)
    return found.orderBy("length", "path").limit(k)


def path_report(g: Hypergraph, path: Sequence[str]) -> DataFrame:
    """(hop, from_edge, to_edge, shared, from_members, to_members) of an edge path; lists in order. The ends' co-members are the first row's from_members and the last row's to_members."""
    hops = g.edges.sparkSession.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(zip(path, path[1:]))], "hop int, from_edge string, to_edge string")  # a path's edges
    nodes = g.edges.join(F.broadcast(hops.select(F.col("from_edge").alias("edge_id")).union(hops.select("to_edge")).distinct()), "edge_id", "left_semi").select("edge_id", F.array_sort("all_nodes").alias("members"))
    x, y = nodes.select(F.col("edge_id").alias("from_edge"), F.col("members").alias("from_members")), nodes.select(F.col("edge_id").alias("to_edge"), F.col("members").alias("to_members"))
    return hops.join(x, "from_edge").join(y, "to_edge").select("hop", "from_edge", "to_edge", F.array_sort(F.array_intersect("from_members", "to_members")).alias("shared"), "from_members", "to_members")


SCORED = 5000  # edges a result may hold


def traversal_paths(g: Hypergraph, scored: DataFrame, thresholds: dict[str, int] | None = None, max_hops: int = 5, paths: int = 3, hubs: DataFrame | None = None) -> list[list[str]]:
    """Up to ``paths`` edge paths through a result (edge_id, edge_type, score, retrieval_source; at most SCORED rows): each begins at the best seed edge not used yet and goes on to the best unused edge that shares as many nodes (no hubs) as the edge's type asks for, 1 by default.

    Only pairs within the result are joined; the walk itself needs one edge after the other and runs on the driver over those pairs.
    """
    rows = scored.orderBy(F.desc("score"), "edge_id").select("edge_id", "edge_type", "score", "retrieval_source").limit(SCORED + 1).collect()
    if len(rows) > SCORED:
        raise ValueError(f"a result of at most {SCORED} edges")
    i = g.incidence.join(F.broadcast(scored.select("edge_id").distinct()), "edge_id", "left_semi").select("edge_id", "node")
    if hubs is not None:
        i = i.join(hubs.select("node"), "node", "left_anti")
    shared: dict[str, dict[str, int]] = {}
    both = i.select(F.col("edge_id").alias("a"), "node").join(i.select(F.col("edge_id").alias("b"), "node"), "node").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    for r in both.collect():  # pairs among a result's edges
        shared.setdefault(r.a, {})[r.b] = r.n
    place, kind = {r.edge_id: k for k, r in enumerate(rows)}, {r.edge_id: r.edge_type for r in rows}
    used: set[str] = set()
    out: list[list[str]] = []
    for r in rows:
        if r.edge_id in used or r.retrieval_source != "seed":
            continue
        path = [r.edge_id]
        used.add(r.edge_id)
        while len(path) <= max_hops:
            least = (thresholds or {}).get(kind[path[-1]], 1)
            near = [e for e, n in shared.get(path[-1], {}).items() if n >= least and e not in used]
            if not near:
                break
            path.append(min(near, key=place.get))
            used.add(path[-1])
        if len(path) > 1:
            out.append(path)
        if len(out) == paths:
            break
    return out


def call_adjacency(g: Hypergraph) -> DataFrame:
    """(src, callees): what each source calls, in order of first mention."""
    c = g.arcs.where("edge_type = 'CALLS'").groupBy("src", "dst").agg(F.min("seq").alias("at"))
    return c.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "dst"))), lambda x: x["dst"]), "|").alias("callees"))


def call_chains(g: Hypergraph, top: int = 20) -> DataFrame:
    """(chain, length): from every caller the walk to its first callee not met yet, that one's first, and so on until none is left; the longest chains first (ties by name), without those whose nodes all lie in a longer one kept before.

    The walks run as joins, a level a step. Candidates reach the driver in blocks of ten times ``top``, one a set of nodes, without those that lie in a kept one, until ``top`` chains are kept or none remain.
    """
    c = g.arcs.where("edge_type = 'CALLS' and src <> dst").groupBy("src", "dst").agg(F.min("seq").alias("at"))
    adj = materialize(c.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "dst"))), lambda x: x["dst"]).alias("callees")), "callees")
    walk = adj.select(F.array("src").alias("chain"), F.col("src").alias("last"))
    ended, step = None, 0
    while True:
        met = walk.join(adj.withColumnRenamed("src", "last"), "last", "left")
        after = F.get(F.filter("callees", lambda x: ~F.array_contains("chain", x)), F.lit(0))
        walked = materialize(met.select("chain", "last", after.alias("to")), f"chain{step}")
        stop = walked.where("to is null and size(chain) > 1").select("chain")
        ended = stop if ended is None else ended.unionByName(stop)
        walk = walked.where("to is not null").select(F.concat("chain", F.array("to")).alias("chain"), F.col("to").alias("last"))
        step += 1
        if walk.isEmpty():
            break
    text = F.array_join("chain", " -> ")
    left = ended.select("chain", text.alias("text")).groupBy(F.array_sort("chain").alias("nodes")).agg(F.min_by("chain", "text").alias("chain"), F.min("text").alias("text"))
    left = materialize(left, "chains")
    kept: list[list[str]] = []
    while len(kept) < top:
        block = left.orderBy(F.desc(F.size("chain")), "text").limit(10 * top).collect()
        if not block:
            break
        before = len(kept)
        for r in block:
            if len(kept) < top and not any(set(r.chain) <= set(k) for k in kept):
                kept.append(r.chain)
        if len(block) < 10 * top:
            break
        end = (len(block[-1].chain), block[-1].text)
        left = left.where((F.size("chain") < end[0]) | ((F.size("chain") == end[0]) & (F.col("text") > end[1])))
        for k in kept[before:]:
            left = left.where(F.size(F.array_except("chain", F.array(*map(F.lit, k)))) > 0)
    return g.edges.sparkSession.createDataFrame([(" -> ".join(k), len(k)) for k in kept], "chain string, length int")


def first_files(g: Hypergraph) -> DataFrame:
    """(node, source_path): where a node is defined: DEFINES targets first, then DEFINES sources, then any edge; the lowest seq of these."""
    d = g.edges.where("edge_type = 'DEFINES'")
    ranked = (
        d.select(F.explode("targets").alias("node"), F.lit(0).alias("rank"), "seq", "source_path")
        .unionByName(d.select(F.explode("sources").alias("node"), F.lit(1).alias("rank"), "seq", "source_path"))
        .unionByName(g.incidence.select("node", F.lit(2).alias("rank"), "seq", "source_path"))
    )
    return ranked.groupBy("node").agg(F.min_by("source_path", F.struct("rank", "seq", "source_path")).alias("source_path"))


def pairwise(g: Hypergraph) -> DataFrame:
    """(node, degree, calls, inherits, importance) over source-target arcs, both ends counted."""
    a = g.arcs
    ends = a.select(F.col("src").alias("node"), "edge_type").unionByName(a.select(F.col("dst").alias("node"), "edge_type"))
    d = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_if(F.col("edge_type") == "CALLS").alias("calls"), F.count_if(F.col("edge_type") == "INHERITS").alias("inherits"))
    return d.withColumn("importance", 2 * (F.col("calls") + F.col("inherits")) + F.col("degree"))


__all__ = ["bfs", "hop_distances", "find_paths", "call_adjacency", "first_files", "pairwise", "Window"]
