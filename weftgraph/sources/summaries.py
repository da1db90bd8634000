"""Summary edges: a text per file from a callable of the user's, and what it names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import EDGE_SCHEMA

FIRST_EDGES, ENTITIES = 30, 5


def named_entities(text: Column) -> Column:
    """What a summary names: the list after ``KEY ENTITIES:``, else the first ENTITIES CamelCase or dotted words; without repeats."""
    said = F.regexp_extract(text, r"(?im)^\s*key entities:\s*(.+)$", 1)
    listed = F.filter(F.transform(F.split(said, r"[,;]"), lambda x: F.trim(F.regexp_replace(x, r"[`*\[\]]", ""))), lambda x: x != "")
    words = F.regexp_extract_all(text, F.lit(r"\b(?:[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+)\b"), F.lit(0))
    return F.when(F.size(listed) > 0, F.array_distinct(listed)).otherwise(F.slice(F.array_distinct(words), 1, ENTITIES))


def file_prompts(edges: DataFrame) -> DataFrame:
    """(source_path, lines): the first FIRST_EDGES edges of each file, none of them a summary, as 'type: sources -> targets'. Never more than that many lines of a file are gathered."""
    w = Window.partitionBy("source_path").orderBy("seq", "edge_id")
    e = edges.where("source_path <> '' and edge_type <> 'SUMMARY'").select("source_path", "seq", "edge_id", F.concat("edge_type", F.lit(": "), F.array_join("sources", ", "), F.lit(" -> "), F.array_join("targets", ", ")).alias("line"))
    few = e.withColumn("n", F.row_number().over(w)).where(F.col("n") <= FIRST_EDGES)
    return few.groupBy("source_path").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))


def summarise(edges: DataFrame, model: Callable[[str, list[str]], str], force: bool = False) -> DataFrame:
    """SUMMARY edges (in the form of extracted edges) of files that have none yet, or of all with ``force``. ``model`` takes a path and its prompt lines, runs in the workers, and may raise or return '': such files get no edge, nor do those whose text names nothing."""
    todo = file_prompts(edges)
    if not force:
        todo = todo.join(edges.where("edge_type = 'SUMMARY'").select("source_path").distinct(), "source_path", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, lines in zip(f["source_path"], f["lines"]):
                try:
                    out.append((path, model(path, list(lines)) or ""))
                except Exception:  # noqa: BLE001 - one failed file must not end the others
                    out.append((path, ""))
            yield pd.DataFrame(out, columns=["source_path", "text"])

    said = todo.mapInPandas(run, "source_path string, text string").withColumn("targets", named_entities(F.col("text"))).where(F.size("targets") > 0)
    stem = F.regexp_extract("source_path", r"([^/\\]+?)(?:\.\w+)?$", 1)
    out = said.select(
        F.substring(F.md5(F.concat(F.lit("SUMMARY_"), "source_path")), 1, 16).alias("edge_id"), F.substring("text", 1, 200).alias("relation"), F.lit("SUMMARY").alias("edge_type"), F.array(stem).alias("sources"), "targets",
        F.array_distinct(F.concat(F.array(stem), "targets")).alias("all_nodes"), "source_path", F.lit("").alias("chunk_id"), F.lit(1).alias("line"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("timestamp").alias("loaded_at"),
    )
    assert out.columns == [c.split()[0] for c in EDGE_SCHEMA.split(", ")]
    return out
