"""A directed, typed hypergraph as DataFrames: edges, incidence, arcs, node statistics, hubs, adjacency, edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import clean_nodes, clean_type, normalise_node

HUB_SHARE, HUB_FLOOR, HUB_LEAST = 0.03, 50, 50
TYPE_WEIGHTS = {"TEXT": 0.7, "SUMMARY": 0.3}  # all other types weigh 1


def canonical_edges(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Insert semantics: names normalised, blanks dropped, the first row of an edge_id wins (by seq, then loaded_at), edges with fewer than two nodes rejected.

    Columns edge_id, relation, edge_type, sources, targets, all_nodes, source_path ('' for none), chunk_id, line, seq and those of ``keep``.
    Where all_nodes is NULL it is sources and targets together.
    """
    s, t = clean_nodes(F.col("sources")), clean_nodes(F.col("targets"))
    nodes = F.when(F.col("all_nodes").isNull(), F.array_distinct(F.concat(s, t))).otherwise(F.array_distinct(clean_nodes(F.col("all_nodes"))))
    e = raw.select(
        "edge_id", "relation", clean_type(F.col("edge_type")).alias("edge_type"), s.alias("sources"), t.alias("targets"), nodes.alias("all_nodes"),
        F.coalesce("source_path", F.lit("")).alias("source_path"), F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), "line", "seq", "loaded_at", *keep,
    )
    first = Window.partitionBy("edge_id").orderBy("seq", "loaded_at")
    return e.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "loaded_at").where(F.size("all_nodes") >= 2)


class Hypergraph:
    """Frames over one canonical edge table. All are lazy; nothing is gathered."""

    def __init__(self, edges: DataFrame):
        self.edges = edges

    @property
    def incidence(self) -> DataFrame:
        """(edge_id, node, edge_type, seq, source_path), distinct."""
        return self.edges.select("edge_id", "edge_type", "seq", "source_path", F.explode("all_nodes").alias("node"))

    @property
    def arcs(self) -> DataFrame:
        """Every source with every target of an edge."""
        return self.edges.select("edge_id", "edge_type", "seq", "source_path", F.explode("sources").alias("src"), "targets").withColumn("dst", F.explode("targets")).drop("targets")

    def degrees(self, types: Sequence[str] | None = None) -> DataFrame:
        """(node, degree): edges that hold the node. Pre-aggregated before the shuffle."""
        i = self.incidence
        if types:
            i = i.where(F.col("edge_type").isin(*types))
        return i.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))

    def count(self, types: Sequence[str] | None = None) -> int:
        e = self.edges.where(F.col("edge_type").isin(*types)) if types else self.edges
        return e.count()

    def idf(self) -> DataFrame:
        """ln(1 + edges / degree), rounded to 4 places."""
        n = self.count()
        return self.degrees().withColumn("idf", F.round(F.log(1 + F.lit(float(n)) / F.col("degree")), 4))

    def hub_threshold(self, n: int, share: float = HUB_SHARE, floor: int = HUB_FLOOR) -> int:
        return min(max(2, int(n * share)), floor)

    def hubs(self, types: Sequence[str] | None = None, share: float = HUB_SHARE, floor: int = HUB_FLOOR) -> DataFrame:
        """Nodes whose degree is over the threshold (strictly)."""
        n = self.count(types)
        return self.degrees(types).where(F.col("degree") > self.hub_threshold(n, share, floor))

    def default_hubs(self, types: Sequence[str] | None = None) -> DataFrame:
        """What a search leaves out where nothing is said: no node in a graph of fewer than HUB_LEAST edges, else the hubs, of the types where some are asked for."""
        if self.edges.limit(HUB_LEAST).count() < HUB_LEAST:
            return self.degrees().limit(0)
        return self.hubs(types)

    def type_counts(self) -> DataFrame:
        return self.edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"))

    def stats(self) -> DataFrame:
        size = F.size("all_nodes")
        per = self.edges.agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg(size), 4).alias("avg_size"), F.max(size).alias("max_size"), F.min(size).alias("min_size"), F.countDistinct(F.nullif("chunk_id", F.lit(""))).alias("chunks"))
        nodes = self.incidence.agg(F.countDistinct("node").alias("nodes"))
        return per.join(nodes)  # one row each

    def adjacency(self, s: int = 1, exclude_hubs: bool = True) -> DataFrame:
        """Pairs of edges (a < b) sharing at least ``s`` nodes that are no hubs: (a, b, shared).

        Without hubs a node joins at most threshold² / 2 pairs, so no key of the self-join is hot; hubs are removed first by an anti-join.
        """
        i = self.incidence.select("edge_id", "node")
        if exclude_hubs:
            i = i.join(self.hubs().select("node"), "node", "left_anti")
        a, b = i.select(F.col("edge_id").alias("a"), "node"), i.select(F.col("edge_id").alias("b"), "node")
        return a.join(b, "node").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= s)

    def adjacent_to(self, edge_id: str, s: int = 1) -> DataFrame:
        """Edges sharing ``s`` nodes or more with one edge, and the shared nodes."""
        own = self.incidence.where(F.col("edge_id") == edge_id).select("node")
        near = self.incidence.join(F.broadcast(own), "node").where(F.col("edge_id") != edge_id)  # one edge's nodes
        return near.groupBy("edge_id").agg(F.array_join(F.sort_array(F.collect_set("node")), "|").alias("shared_nodes"), F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= s)

    def remove_file(self, path: str) -> Hypergraph:
        return Hypergraph(self.edges.where(F.col("source_path") != path))

    def remove_edges(self, ids: DataFrame) -> Hypergraph:
        return Hypergraph(self.edges.join(ids.select("edge_id").distinct(), "edge_id", "left_anti"))

    def merge_nodes(self, mapping: DataFrame) -> Hypergraph:
        """Replace nodes by their keepers (merged, keeper) in all three lists, order kept; edges left with fewer than two nodes are dropped."""

        def renamed(col: str) -> DataFrame:
            x = self.edges.select("edge_id", F.posexplode(col).alias("pos", "node")).join(mapping, F.col("node") == F.col("merged"), "left")
            items = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("keeper", "node").alias("n"))))
            return x.groupBy("edge_id").agg(F.transform(items, lambda i: i["n"]).alias(col))

        out = self.edges.drop("sources", "targets", "all_nodes")
        for col in ("sources", "targets", "all_nodes"):
            out = out.join(renamed(col), "edge_id", "left").withColumn(col, F.coalesce(col, F.array().cast("array<string>")))
        return Hypergraph(out.withColumn("all_nodes", F.array_distinct("all_nodes")).where(F.size("all_nodes") >= 2))

    def name_index(self) -> DataFrame:
        """(low, node): a node for each lower-cased name; on a clash the one of highest degree, then the greatest name."""
        return self.degrees().groupBy(F.lower("node").alias("low")).agg(F.max_by("node", F.struct("degree", "node")).alias("node"))


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows of a key the whole first one in order; reduced before the shuffle by its minimum."""
    cols = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__x"))
    return first.select(*key, *[F.col("__x")[c].alias(c) for c in cols]).select(*rows.columns)


def intersections(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, nodes): the nodes that both edges of each pair (a, b) hold, in order."""
    x, y = (edges.select(F.col("edge_id").alias(k), F.col("all_nodes").alias(f"n{k}")) for k in "ab")
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", F.array_sort(F.array_intersect("na", "nb")).alias("nodes"))


def specificity(degree: Column, total: Column, token: Column, node: Column) -> Column:
    """How much a name match tells: less for nodes on many edges and short tokens, more for qualified names."""
    r = degree / total
    by_degree = F.when(r > 0.05, 0.1).when(r > 0.02, 0.3).when(r > 0.005, 0.6).otherwise(1.0)
    short = F.length(token) <= 3
    by_length = F.when(short & (r > 0.005), 0.4).when(short & (r > 0.002), 0.7).otherwise(1.0)
    segments = F.size(F.split(node, r"\."))
    return by_degree * by_length * F.when(segments >= 3, 1.3).when(segments == 2, 1.1).otherwise(1.0)


def type_weight(edge_type: Column) -> Column:
    out = F.lit(1.0)
    for t, w in TYPE_WEIGHTS.items():
        out = F.when(edge_type == t, w).otherwise(out)
    return out


__all__ = ["Hypergraph", "canonical_edges", "specificity", "type_weight", "normalise_node"]
