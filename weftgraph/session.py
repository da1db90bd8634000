"""One graph, its tours and the query surface; and a registry of several."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.graph import Hypergraph, canonical_edges
from .operators.retrieve import lookup, match_names, text_search
from .plans.plan import Plan, dispatch, tokens_of
from .plans.probe import blast_radius, probe
from .runtime import children, exists, files
from .sources.extract import extract
from .sources.ingest import changes, scan_directory, split_errors
from .sources.tours import TourStore


DONE = "_DONE"  # marks a whole version


def _versions(spark: SparkSession, cache_dir: str) -> list[str]:
    return [n for n in children(spark, cache_dir) if re.fullmatch(r"v\d{6,}", n)]


def _newest(spark: SparkSession, cache_dir: str) -> str | None:
    """The last whole version."""
    for name in reversed(_versions(spark, cache_dir)):
        if exists(spark, f"{cache_dir}/{name}/{DONE}"):
            return name
    return None


CACHE, CACHE_VARIABLE = ".weftgraph", "WEFTGRAPH_CACHE"


def find_cache(start: str, levels: int = 5) -> str | None:
    """The cache folder in ``start`` or one of its ``levels`` parents."""
    here = os.path.abspath(start)
    for _ in range(levels + 1):
        if os.path.isdir(os.path.join(here, CACHE)):
            return os.path.join(here, CACHE)
        here = os.path.dirname(here)
    return None


class GraphSession:
    def __init__(self, spark: SparkSession, edges: DataFrame, cache_dir: str):
        self.spark, self.graph, self.cache_dir = spark, Hypergraph(edges), cache_dir
        self._tours: TourStore | None = None

    @classmethod
    def load(cls, spark: SparkSession, cache_dir: str) -> GraphSession:
        found = _newest(spark, cache_dir)
        if found is None:
            raise FileNotFoundError(f"no index below {cache_dir}")
        return cls(spark, spark.read.parquet(f"{cache_dir}/{found}/edges"), cache_dir)

    @classmethod
    def index(cls, spark: SparkSession, root: str, cache_dir: str) -> GraphSession:
        """Read a folder, extract edges of files that are new or changed since the last run, keep the others' edges, drop those of deleted files.

        Edges and manifest are written as one new version beside the old ones, which counts once its mark is there; so a crash between the writes leaves the last whole version in force. Older versions are then deleted, but for the last.
        Files that cannot be read keep no edges; see ``errors``.
        """
        docs, errors = split_errors(scan_directory(spark, root))
        last = _newest(spark, cache_dir)
        if last is not None:
            status = changes(spark.read.parquet(f"{cache_dir}/{last}/manifest"), docs)
            fresh = docs.join(status.where("status in ('added', 'modified')"), "source_path", "left_semi")
            kept = spark.read.parquet(f"{cache_dir}/{last}/edges").join(status.where("status = 'unchanged'"), "source_path", "left_semi")
            new = canonical_edges(extract(fresh))
            new = kept.unionByName(new.select(kept.columns))
        else:
            new = canonical_edges(extract(docs))
        own = f"v{int(last[1:]) + 1 if last else 1:06d}"
        for frame, name in ((new, "edges"), (docs.select("source_path", "markdown"), "manifest"), (errors, "errors")):
            frame.write.mode("overwrite").parquet(f"{cache_dir}/{own}/{name}")
        fs, path = files(spark, f"{cache_dir}/{own}/{DONE}")
        fs.create(path, True).close()
        for name in _versions(spark, cache_dir):
            if name < (last or own):
                old_fs, old = files(spark, f"{cache_dir}/{name}")
                old_fs.delete(old, True)
        return cls.load(spark, cache_dir)

    @property
    def errors(self) -> DataFrame:
        """(source_path, error) of files that could not be read."""
        return self.spark.read.parquet(f"{self.cache_dir}/{_newest(self.spark, self.cache_dir)}/errors")

    @property
    def tours(self) -> TourStore:
        if self._tours is None:
            self._tours = TourStore(os.path.join(self.cache_dir, "tours.json"))
        return self._tours

    def lookup(self, symbol: str, edge_types: list[str] | None = None) -> Plan:
        return Plan(symbol, *lookup(self.graph, match_names(self.graph, symbol, tokens_of(symbol)), edge_types), [1])

    def search(self, text: str, limit: int = 20) -> DataFrame:
        return text_search(self.graph, tokens_of(text, least=3), limit)

    def query(self, question: str, depth: int = 2) -> Plan:
        return dispatch(self.graph, question, depth)

    def stats(self) -> dict:
        row = self.graph.stats().head().asDict()
        by_type = {r.edge_type: r.edges for r in self.graph.type_counts().collect()}  # one row a type
        return row | {"hubs": self.graph.hubs().count(), "by_type": by_type}

    def overview(self, top: int = 10) -> dict:
        files = self.graph.edges.where("source_path <> ''").select("source_path").distinct().count()
        return {"files": files, "top": [tuple(r) for r in self.graph.degrees().orderBy(F.desc("degree"), "node").limit(top).collect()]}

    def blast_radius(self, symbol: str, depth: int = 2, task: str = "", tags: list[str] | None = None, max_steps: int = 200) -> dict:
        steps = [r.asDict() for r in blast_radius(self.graph, symbol, depth, task).orderBy("file", "node").limit(max_steps).collect()]
        return self.tours.add(f"Blast radius: {symbol}", steps, tags=["blast-radius", *(tags or [])], keywords=[symbol])

    def probe(self, question: str, depth: int = 2, max_steps: int = 200) -> dict:
        steps = [r.asDict() for r in probe(self.graph, question, depth, max_steps).collect()]
        return self.tours.add(question, steps, tags=["probe"], status="active" if len(steps) > 3 else "draft", created_from_query=question)


class Registry:
    """Sessions by name; the first added is active until another is chosen."""

    def __init__(self):
        self.sessions: dict[str, GraphSession] = {}
        self.active: str | None = None

    def add(self, name: str, session: GraphSession) -> None:
        self.sessions[name] = session
        self.active = self.active or name

    def use(self, name: str) -> GraphSession:
        self.active = name if name in self.sessions else self.active
        return self.sessions[name]

    def get(self, name: str | None = None) -> GraphSession | None:
        return self.sessions.get(name or self.active or "")

    def listing(self) -> list[dict]:
        return [{"name": n, "active": n == self.active, **{k: s.stats()[k] for k in ("nodes", "edges")}} for n, s in self.sessions.items()]

    def resolve(self, spark: SparkSession, path: str | None = None) -> GraphSession | None:
        """The session for a call: that of an explicit path, else the active one, else that of the folder the environment names, else that of the working folder or a parent, else None. Sessions opened by path are kept."""
        if path is None and self.active:
            return self.sessions[self.active]
        found = find_cache(path) if path else os.environ.get(CACHE_VARIABLE) or find_cache(os.getcwd())
        if path and found is None and _newest(spark, path):
            found = path
        if not found or _newest(spark, found) is None:
            return None
        known = next((s for s in self.sessions.values() if s.cache_dir == found), None)
        if known is None:
            known = GraphSession.load(spark, found)
            self.add(os.path.basename(os.path.dirname(found)) or found, known)
        return known
