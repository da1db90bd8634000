"""Retrieval plans as small frames, their merge, and the tiered dispatch of a query."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LOOKUP_STOP, SEARCH_STOP, is_test_segment, last_segment
from ..operators.graph import Hypergraph
from ..operators.retrieve import collapse_plan, grep_patterns, infer_edge_types, lookup, match_names, rank_seeds, relate, score_names, text_search
from ..operators.traverse import bfs

_SPLIT = r"""[\s,;:!?(){}\[\]"'`/\\]+"""


def tokens_of(query: str, stop=LOOKUP_STOP, least: int = 2, dotted: bool = True) -> list[str]:
    """The words of a single query on the driver, as functions.text does it for columns."""
    import re

    out: dict[str, None] = {}
    for w in filter(None, re.split(_SPLIT, query)):
        for t in ([w] if dotted and "." in w else []) + re.split(r"[._]", w):
            t = t.lower().strip()
            if len(t) >= least and t not in stop:
                out[t] = None
    return list(out)


@dataclass
class Plan:
    """files (source_path, priority), symbols (edge_id, node, edge_type, source_path, relationship, targets), ends (node, source_path: the other ends met in a file, kept when symbols are merged), and what was done."""

    query: str
    files: DataFrame
    symbols: DataFrame
    tiers: list[int] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    context: str = ""
    ends: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.ends is None:
            self.ends = self.symbols.where("source_path <> ''").select(F.explode("targets").alias("node"), "source_path")

    def merge(self, other: Plan) -> Plan:
        """Files by path and symbols by (node, edge_type), the first plan's first; tiers and classes in order without repeats."""
        files = self.files.withColumn("o", F.lit(0)).unionByName(other.files.withColumn("o", F.lit(1)))
        symbols = self.symbols.withColumn("o", F.lit(0)).unionByName(other.symbols.withColumn("o", F.lit(1)))
        return Plan(
            self.query,
            files.groupBy("source_path").agg(F.min_by("priority", F.struct("o", "priority")).alias("priority")),
            symbols.groupBy("node", "edge_type").agg(F.min_by(F.struct("edge_id", "source_path", "relationship", "targets"), F.struct("o", "edge_id")).alias("x")).select("x.edge_id", "node", "edge_type", "x.source_path", "x.relationship", "x.targets"),
            list(dict.fromkeys(self.tiers + other.tiers)), list(dict.fromkeys(self.classes + other.classes)), "\n".join(filter(None, (self.context, other.context))),
            self.ends.unionByName(other.ends),
        )

    def without_tests(self) -> Plan:
        keep = ~is_test_segment(F.col("source_path"))
        return Plan(self.query, self.files.where(keep), self.symbols.where(keep), self.tiers, self.classes, self.context, self.ends.where(keep))

    def greps(self, top: int = 15) -> list[str]:
        """Patterns to search for: last segments of the other ends of the plan's relations, the first ``top`` in order."""
        return [r[0] for r in grep_patterns(self.symbols).orderBy("pattern").limit(top).collect()]

    def test_counts(self) -> dict[str, int]:
        """How many files and symbols ``without_tests`` drops."""
        test = is_test_segment(F.col("source_path"))
        return {"files": self.files.where(test).count(), "symbols": self.symbols.where(test).count()}

    def is_empty(self) -> bool:
        return self.files.isEmpty() and self.symbols.isEmpty()

    def to_dict(self, top: int = 15) -> dict:
        files = [r.asDict() for r in self.files.orderBy("priority", "source_path").limit(top).collect()]
        symbols = [r.asDict() for r in self.symbols.orderBy("node", "edge_id").limit(top).collect()]
        return {"query": self.query, "classification": self.classes, "tiers_used": self.tiers, "primary_files": files, "related_symbols": symbols, "grep_suggestions": self.greps(top), "structural_context": self.context}

    def format_text(self, top: int = 15) -> str:
        d = self.to_dict(top)
        lines = [f"Query: {self.query}", "Files:"] + [f"  [{f['priority']}] {f['source_path']}" for f in d["primary_files"]]
        return "\n".join(lines + ["Symbols:"] + [f"  {s['node']} {s['relationship']} {', '.join(s['targets'][:5])} ({s['edge_type']}) {s['source_path']}" for s in d["related_symbols"]] + ["Search for:"] + [f"  {x}" for x in d["grep_suggestions"]])


def classify(g: Hypergraph, query: str) -> list[str]:
    """identifier (a word names a node), structural (a verb of an edge type), text_search (three words or more, or nothing else), broad (overview words)."""
    out = []
    words = tokens_of(query)
    if words and not match_names(g, query, words).isEmpty():
        out.append("identifier")
    if infer_edge_types(query):
        out.append("structural")
    if {"overview", "architecture", "structure", "codebase"} & set(words):
        out.append("broad")
    if len(query.split()) >= 3 or not out:
        out.append("text_search")
    return out


def walk(g: Hypergraph, query: str, seeds: DataFrame, depth: int, direction: str, types: list[str] | None, classes: list[str] | None = None) -> Plan:
    """The plan of a breadth-first search: files by the level they were met at, and what every met edge says of the node it was met from."""
    met = bfs(g, seeds, depth, direction, types, g.default_hubs(types))
    symbols = relate(g, met)
    files = met.select("edge_id", "level").join(symbols.where("source_path <> ''").select("edge_id", "source_path"), "edge_id").groupBy("source_path").agg(F.min("level").alias("priority"))
    return Plan(query, files, symbols, [2], classes or [])


def dispatch(g: Hypergraph, query: str, depth: int = 2, direction: str = "both", limit: int = 20) -> Plan:
    """Tier 1 lookup with the specificity filter (from 50 edges on), tier 2 search from at most 5 specific names, tier 3 text search where asked for or nothing was found, its best nodes looked up and, where no word names a node, at most 3 of them followed one step; folders collapsed, tests later by 2."""
    words, types = tokens_of(query), infer_edge_types(query)
    classes = classify(g, query)
    large = g.edges.limit(50).count() >= 50
    names = score_names(g, match_names(g, query, words))
    if large:
        names = names.where("specificity >= 0.25")
    files, symbols = lookup(g, names, types)
    plan = Plan(query, files, symbols, [1], classes)
    seeds = rank_seeds(g, names)
    if not seeds.isEmpty():
        plan = plan.merge(walk(g, query, seeds, depth, direction, types, classes))
    if "text_search" in classes or plan.is_empty():
        found = text_search(g, tokens_of(query, SEARCH_STOP, 3), limit)
        paths = found.where("kind = 'path'").select(F.col("entry").alias("source_path"), F.lit(3).alias("priority"))
        near = found.where("kind = 'node' and quality <= 2").select(F.col("entry").alias("node")).limit(5)
        n_files, n_symbols = lookup(g, near, types)
        plan = plan.merge(Plan(query, paths.unionByName(n_files), n_symbols, [3], classes))
        if "identifier" not in classes:  # what the text search found is followed one step
            token = last_segment(F.lower("node"))
            of = score_names(g, near.join(g.degrees(), "node").select("node", token.alias("token"), "degree"))
            starts = rank_seeds(g, of, 3)
            if not starts.isEmpty():
                plan = plan.merge(walk(g, query, starts, 1, direction, types, classes))
    late = collapse_plan(plan.files, tokens_of(query, SEARCH_STOP, 3, False)).drop("n")
    return Plan(query, late, plan.symbols, plan.tiers, classes, ends=plan.ends)
