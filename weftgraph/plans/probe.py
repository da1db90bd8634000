"""Questions to strategies, lookups and tours: blast radius, probe, scaffold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEARCH_STOP, is_test_probe
from ..operators.graph import Hypergraph
from ..operators.retrieve import lookup, match_names, text_search
from .plan import Plan, dispatch, tokens_of, walk

# Patterns that choose a strategy (fixed values).
STRATEGIES = {
    "blast-radius": r"\bimpact\b|\bblast.?radius\b|\bdepends?\s+on\b|\bwho\s+calls\b|\bwhat\s+calls\b|\bcallers?\b|\bwhat\s+would\s+break\b|\bchange\b|\bmodify\b|\baffect\b|\bripple\b",
    "inheritance": r"\bhierarch|\bsubclass|\binherit|\bimplement|\bextend|\bbase\s+class|\bmixin|\boverrid|\bchild\s+class|\bparent\s+class|\btype\s+hierarchy|\bclass\s+tree",
    "data-flow": r"\btrace\b|\bflow\b|\bpath\b|\bpipeline\b|\bexecution\b|\blifecycle\b|\breach\b|\bpass\w*\s+through\b|\bchain\b|\bsequence\b|\bstep.?by.?step\b|\bhow\s+does\s+\w+\s+(get|reach|flow|pass)",
    "exception-flow": r"\bexception|\berror\s+handl|\braise[sd]?\b|\bcatch\b|\btry\b|\bexcept\b|\bfail\b|\brecov|\berror\s+propagat",
    "api-surface": r"\bpublic\b|\bapi\b|\binterface\b|\bexport|\bmodule\s+surface\b|\bexposed\b|\bendpoint",
    "cross-cutting": r"\beverywhere\b|\ball\s+places\b|\bpattern\b|\bconvention\b|\bcross.?cutting\b|\bacross\b|\bconsistent|\bcommon\s+pattern",
}


def strategies(question: Column) -> Column:
    """Strategies whose pattern occurs, in fixed order; exploration if none."""
    low = F.lower(question)
    found = F.filter(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in STRATEGIES.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("exploration"))).otherwise(found)


def strategies_of(question: str) -> list[str]:
    import re

    return [n for n, p in STRATEGIES.items() if re.search(p, question.lower())] or ["exploration"]


def scaffold(plan: Plan) -> DataFrame:
    """Tour steps (node, text, file, edge_type): one per symbol, the first edge of each node counting, with what it says of the node; then the other ends of the plan's relations that are no step yet, with the first file in order."""
    s = plan.symbols.groupBy("node").agg(F.min_by(F.struct("edge_type", "source_path", "relationship", "targets"), "edge_id").alias("x"))
    text = F.concat_ws(" -> ", F.concat("node", F.lit(" ["), "x.relationship", F.lit("]")), F.nullif(F.array_join("x.targets", ", "), F.lit("")))
    own = s.select("node", text.alias("text"), F.col("x.source_path").alias("file"), "x.edge_type")
    others = plan.ends.join(s.select("node"), "node", "left_anti").groupBy("node").agg(F.min("source_path").alias("file"))
    return own.unionByName(others.select("node", F.concat_ws(" in ", "node", "file").alias("text"), "file", F.lit("").alias("edge_type")))


def question_for(symbol: str, task: str) -> Column:
    t = F.upper(F.coalesce("edge_type", F.lit("")))
    return (
        F.when(t == "RAISES", f"Does this place raise or handle {symbol}, and what does {task} mean for it?")
        .when(t == "CALLS", f"This code calls {symbol} or is called by it. Does it act differently with {task}?")
        .when(t == "INHERITS", f"This derives from {symbol} or is its base. Does {task} reach it?")
        .otherwise(f"How is this tied to {symbol}, and does {task} reach it?")
    )


def _around(g: Hypergraph, symbol: str, types: list[str] | None, direction: str, depth: int) -> Plan:
    names = match_names(g, symbol, tokens_of(symbol))
    files, symbols = lookup(g, names, types)
    return Plan(symbol, files, symbols, [1]).merge(walk(g, symbol, names.orderBy("node").limit(5), depth, direction, types))


def blast_radius(g: Hypergraph, symbol: str, depth: int = 2, task: str = "") -> DataFrame:
    """Steps for all that a change of ``symbol`` may touch: any edge, RAISES and INHERITS in both directions, each with its question."""
    plan = _around(g, symbol, None, "both", depth)
    for kind in ("RAISES", "INHERITS"):
        plan = plan.merge(_around(g, symbol, [kind], "both", depth))
    return scaffold(plan).withColumn("context_query", question_for(symbol, task or f"a change of {symbol}"))


def probe(g: Hypergraph, question: str, depth: int = 2, max_steps: int = 200) -> DataFrame:
    """Steps that answer a question: the plans of its strategies merged, most seed words first, tests last, then by file and node."""
    seeds = tokens_of(question, SEARCH_STOP, 3)
    plan = dispatch(g, question, depth)
    for s in strategies_of(question):
        kinds = {"blast-radius": (["CALLS", "IMPORTS"], "both"), "inheritance": (["INHERITS", "DEFINES"], "both"), "data-flow": (["CALLS"], "forward"), "exception-flow": (["RAISES", "CALLS"], "both"), "api-surface": (["DEFINES", "SIGNATURE"], "forward")}.get(s)
        if kinds is None:
            nodes = text_search(g, seeds, 20).where("kind = 'node'").select(F.col("entry").alias("node"))
            plan = plan.merge(Plan(question, *lookup(g, nodes), [3]))
        else:
            for word in seeds[:3]:
                plan = plan.merge(_around(g, word, *kinds, depth))
    steps = scaffold(plan)
    low = F.lower("node")
    matches = sum((F.when(low.contains(w), 1).otherwise(0) for w in seeds), F.lit(0))
    return steps.withColumn("seed_matches", matches).withColumn("is_test", is_test_probe(F.col("file"))).orderBy(F.desc("seed_matches"), "is_test", "file", "node").limit(max_steps)


def tour_origin(tags: Column, steps: Column) -> Column:
    """How a tour came about: by its tags, a text match in a step, edge types in steps."""
    return (
        F.when(F.array_contains(tags, "llm-authored"), "LLM-authored")
        .when(F.exists(steps, lambda s: F.contains(F.coalesce(s["text"], F.lit("")), F.lit("[text match]"))), "text-search")
        .when(F.exists(steps, lambda s: F.coalesce(s["edge_type"], F.lit("")) != ""), "auto-scaffolded")
        .otherwise("LLM-authored")
    )
