"""Extraction from braced languages, the scan, the index, chunk dispatch, paths, vectors, tours, seeds of questions."""

import os
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.text import SEED_STOP, seed_terms
from weftgraph.operators import retrieve as rt
from weftgraph.operators import traverse as tv
from weftgraph.operators import views
from weftgraph.operators.graph import Hypergraph, canonical_edges, first_wins, intersections
from weftgraph.session import DONE, GraphSession, Registry, find_cache
from weftgraph.sources import ingest as ing
from weftgraph.sources.extract import source_edges
from weftgraph.sources.tours import TourStore, select_tours

JS = """import express, { Router as R } from "express";
const fs = require('fs');
class UserService extends BaseService {
  constructor() { super(); this.x = 1; }
  async getUser(id) { if (!id) { throw new Error("no {"); } return this.db.find(id).then(f); }
}
function helper(a) { return util.format(a); }  // not(called)
const go = async (x) => { await run(x); };
"""
TS = """import { Injectable } from '@angular/core';
interface Serializable { serialize(): string; }
class DataService extends BaseService implements Serializable, X<Y> {
    private cache: Map<string, any>;
    constructor() { super(); this.cache = new Map(); }
    getData(key: string): any { return this.cache.get(key); }
}
"""
GO = """package main
import (
    "fmt"
    "net/http"
)
type Server struct {
    Addr string
    port int
}
type Handler interface {
    Serve(w int) error
}
func (s *Server) Start(n int) error { fmt.Println("x"); return http.Serve(s.Addr) }
func main() { s := &Server{}; s.Start(1); for i := 0; i < 3; i++ { run(i) } }
"""
RUST = """use std::collections::{HashMap, hash_map::{self, Entry}};
pub struct Config { pub name: String, size: usize }
enum Kind { A, B(u8), C { x: i32 } }
impl Run for Config { fn run(&self) -> u8 { println!("x"); Config::make(2) } }
"""
JAVA = """import java.util.List;
import static java.lang.Math.max;
public class App extends Base<String> implements Runnable {
  public App(int n) { this.n = n; }
  public void run() throws IOException { if (n > 0) { throw new IllegalStateException("x"); } list.add(max(1, 2)); }
  abstract int size();
}
"""


def _of(path, text):
    out = {}
    for kind, s, t, _ in source_edges(path, text):
        out.setdefault((kind, s[0]), []).extend(t)
    return out


def test_javascript_and_typescript():
    e = _of("src/service.js", JS)
    assert e["DEFINES", "service"] == ["service.UserService", "service.helper", "service.go"] and e["DEFINES", "service.UserService"] == ["service.UserService.constructor", "service.UserService.getUser"]
    assert e["INHERITS", "service.UserService"] == ["BaseService"] and e["IMPORTS", "service"] == ["express", "Router", "fs"]
    assert e["CALLS", "service.UserService.getUser"] == ["Error", "this.db.find"] and e["RAISES", "service.UserService.getUser"] == ["Error"] and e["CALLS", "service.helper"] == ["util.format"] and e["CALLS", "service.go"] == ["run"]
    e = _of("data.ts", TS)
    assert e["INHERITS", "data.DataService"] == ["BaseService", "Serializable", "X"] and e["DEFINES", "data.Serializable"] == ["data.Serializable.serialize"] and e["IMPORTS", "data"] == ["@angular/core", "Injectable"]
    assert e["CALLS", "data.DataService.getData"] == ["this.cache.get"]


def test_go_rust_java():
    e = _of("main.go", GO)
    assert e["DEFINES", "main"] == ["main.Server", "main.Handler", "main.main"] and set(e["DEFINES", "main.Server"]) == {"main.Server.Addr", "main.Server.port", "main.Server.Start"} and e["DEFINES", "main.Handler"] == ["main.Handler.Serve"]
    assert e["IMPORTS", "main"] == ["fmt", "net/http"] and e["CALLS", "main.Server.Start"] == ["fmt.Println", "http.Serve"] and e["CALLS", "main.main"] == ["s.Start", "run"]
    e = _of("lib.rs", RUST)
    assert e["IMPORTS", "lib"] == ["std::collections::HashMap", "std::collections::hash_map", "std::collections::hash_map::Entry"] and e["INHERITS", "lib.Config"] == ["Run"]
    assert set(e["DEFINES", "lib.Kind"]) == {"lib.Kind.A", "lib.Kind.B", "lib.Kind.C"} and e["CALLS", "lib.Config.run"] == ["println!", "Config::make"]
    e = _of("App.java", JAVA)
    assert e["INHERITS", "App.App"] == ["Base", "Runnable"] and e["RAISES", "App.App.run"] == ["IllegalStateException"] and e["IMPORTS", "App"] == ["java.util.List", "java.lang.Math.max"]
    assert set(e["DEFINES", "App.App"]) == {"App.App.App", "App.App.run", "App.App.size"}


def test_other_families_and_odd_texts():
    assert _of("x.c", '#include <stdio.h>\nstruct point { int x; };\nstatic int add(const char *a, int n) { return helper(a) + n; }\n')["CALLS", "x.add"] == ["helper"]
    assert _of("x.cpp", "class Foo : public Bar, private ns::Baz { int run() const { return go(1); } };\n")["INHERITS", "x.Foo"] == ["Bar", "ns::Baz"]
    assert _of("x.php", "<?php\nuse App\\User;\nclass A extends B { function run($x) { return helper($x); } }\n")["CALLS", "x.A.run"] == ["helper"]
    for text in ("", "   ", "}}}{{{", "class A {", 'function f( { "', "/* ", "\x00", "é" * 3000):
        for ext in ("js", "ts", "go", "rs", "java", "c", "cpp", "php"):
            source_edges(f"a.{ext}", text)
    assert source_edges("a.md", "class A { }") == []


def test_scan_replaces_and_reports(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "ok.py").write_text("x = 1\n")
    (tmp_path / "a" / "latin.py").write_bytes("# caf\xe9\nclass K:\n    pass\n".encode("latin-1"))
    (tmp_path / "a" / "bom.md").write_bytes(b"\xef\xbb\xbf# T\n")
    (tmp_path / "a" / "big.txt").write_text("x" * 200)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text("x")
    docs = ing.scan_directory(spark, str(tmp_path), most_bytes=100)
    got = {r.source_path: (r.markdown, r.error) for r in docs.collect()}
    assert got == {"a/ok.py": ("x = 1\n", None), "a/latin.py": ("# caf\ufffd\nclass K:\n    pass\n", None), "a/bom.md": ("# T\n", None), "a/big.txt": (None, "too large")}
    good, bad = ing.split_errors(docs)
    assert good.count() == 3 and [tuple(r) for r in bad.collect()] == [("a/big.txt", "too large")]


def test_index_survives_a_crash(spark, tmp_path):
    root, cache = tmp_path / "repo", tmp_path / "cache"
    root.mkdir()
    (root / "a.py").write_text("def f():\n    g()\n")
    (root / "b.js").write_text(JS)
    (root / "c.rb").write_text("class Foo\n  def bar\n  end\nend\n")
    s = GraphSession.index(spark, str(root), str(cache))
    kinds = {(r.edge_type, r.source_path) for r in s.graph.edges.select("edge_type", "source_path").collect()}
    assert {("CALLS", "a.py"), ("INHERITS", "b.js"), ("DEFINES", "c.rb")} <= kinds and s.errors.count() == 0
    n = s.graph.edges.count()
    half = cache / "v000002" / "edges"  # a crash after the edges, before manifest and mark
    half.parent.mkdir()
    spark.range(1).write.parquet(str(half))
    assert GraphSession.load(spark, str(cache)).graph.edges.count() == n
    (root / "a.py").unlink()
    again = GraphSession.index(spark, str(root), str(cache))
    assert {r.source_path for r in again.graph.edges.select("source_path").collect()} == {"b.js", "c.rb"} and os.path.exists(cache / "v000002" / DONE)
    assert {k: v for k, v in again.stats()["by_type"].items()}["INHERITS"] == 1
    with pytest.raises(FileNotFoundError):
        GraphSession.load(spark, str(tmp_path / "none"))


def test_cache_discovery_and_registry(spark, tmp_path, monkeypatch):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert find_cache(str(deep)) is None
    (tmp_path / ".weftgraph").mkdir()
    assert find_cache(str(deep)) == str(tmp_path / ".weftgraph") and find_cache(str(deep), levels=1) is None
    r = Registry()
    monkeypatch.chdir(deep)
    assert r.resolve(spark) is None  # a folder without an index
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f():\n    g()\n")
    GraphSession.index(spark, str(tmp_path / "src"), str(tmp_path / ".weftgraph"))
    s = r.resolve(spark)
    assert s is not None and r.resolve(spark) is s and r.resolve(spark, str(deep)) is s


def _brute_pack(text, limit):
    if len(text) <= limit:
        return [text]
    out = []
    for p in (p for p in re.split(r"\n\s*\n", text) if p.strip()):
        if out and len(out[-1]) + len(p) + 2 <= limit:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def test_chunk_dispatch(spark):
    long = "# A\n\n" + "\n\n".join(f"Paragraph {i} " + "word " * (i % 7 * 20) for i in range(40)) + "\n\n## B\n\nshort"
    rows = [("r/a.py", "import x\n\ndef f():\n    return 1\n"), ("r/b.py", "x = 1\n"), ("r/bad.py", "def f(:\n"), ("r/c.md", long), ("r/d.go", "package a\n" * 300), ("r/e.txt", "plain text"), ("r/f.md", None), ("r/g.py", "")]
    got = ing.chunk_documents(spark.createDataFrame(rows, "source_path string, markdown string")).collect()
    per = {}
    for r in sorted(got, key=lambda r: (r.source_path, r.start)):
        per.setdefault(r.source_path, []).append(r)
    assert [r.symbol for r in per["r/a.py"]] == ["__preamble__", "f"] and per["r/a.py"][1].text == "def f():\n    return 1"
    assert [r.kind for r in per["r/b.py"]] == ["window"] and per["r/bad.py"][0].text == "def f(:\n" and len(per["r/d.go"]) == 2 and per["r/e.txt"][0].symbol == "__top__"
    assert set(per) == {"r/a.py", "r/b.py", "r/bad.py", "r/c.md", "r/d.go", "r/e.txt"} and {r.symbol for r in per["r/c.md"]} == {"A", "B"}
    df = spark.createDataFrame([(long,), ("x" * 5000,), ("a\n\n" * 2000,), ("",)], "t string")
    for r in df.select("t", ing.packed_paragraphs(F.col("t"), 500).alias("p")).collect():
        assert r.p == _brute_pack(r.t, 500)


def _edges(spark, rows):
    raw = spark.createDataFrame([(f"e{i}", k, s, t, f"f{i % 3}.py", i) for i, (k, s, t) in enumerate(rows)], "edge_id string, edge_type string, sources array<string>, targets array<string>, source_path string, seq long")
    nothing = lambda t: F.lit(None).cast(t)
    return Hypergraph(canonical_edges(raw.withColumns({"relation": F.lit("r"), "all_nodes": nothing("array<string>"), "chunk_id": nothing("string"), "line": nothing("int"), "loaded_at": nothing("timestamp")})))


def test_relations_and_default_hubs(spark):
    g = _edges(spark, [("CALLS", ["a"], ["b", "c"]), ("INHERITS", ["c"], ["a"]), ("ODD", ["x"], ["a"])] + [("CALLS", ["a"], [f"n{i}"]) for i in range(30)])
    names = spark.createDataFrame([("a",)], "node string")
    got = {(r.edge_id, r.relationship, tuple(r.targets)) for r in rt.lookup(g, names)[1].collect()}
    assert {("e0", "calls", ("b", "c")), ("e1", "inherited by", ("c",)), ("e2", "related to", ("x",))} <= got
    assert g.default_hubs().count() == 0 and g.hubs().count() > 0  # too few edges for hubs to mean anything
    assert rt.flags_to_types(calls=True) == (["CALLS"], "forward") and rt.flags_to_types(callers=True, raises=True) == (["CALLS", "RAISES"], "backward") and rt.flags_to_types() == (None, "both")


def test_blast_radius_reaches_the_other_ends(spark):
    from weftgraph.plans.probe import blast_radius

    g = _edges(spark, [("CALLS", ["m.f"], ["m.g"]), ("CALLS", ["m.h"], ["m.f"]), ("RAISES", ["m.f"], ["ValueError"])])
    steps = {r.node: r for r in blast_radius(g, "m.f", 1).collect()}
    assert set(steps) == {"m.f", "m.g", "m.h", "ValueError"} and "m.f [" in steps["m.f"].text and " -> " in steps["m.f"].text


def test_greedy_paths(spark):
    g = _edges(spark, [("CALLS", ["a"], ["b"]), ("CALLS", ["b"], ["c"]), ("CALLS", ["c"], ["d"]), ("CALLS", ["x"], ["y"]), ("CALLS", ["b"], ["z"])])
    s = spark.createDataFrame([("e0", "CALLS", 0.9, "seed"), ("e1", "CALLS", 0.5, "intersection"), ("e2", "CALLS", 0.4, "seed"), ("e3", "CALLS", 0.95, "seed"), ("e4", "CALLS", 0.6, "intersection")], "edge_id string, edge_type string, score double, retrieval_source string")
    assert tv.traversal_paths(g, s) == [["e0", "e4", "e1", "e2"]] and tv.traversal_paths(g, s, max_hops=1) == [["e0", "e4"], ["e2", "e1"]] and tv.traversal_paths(g, s, {"CALLS": 2}) == []
    r = tv.path_report(g, ["e0", "e1", "e2"]).orderBy("hop").collect()
    assert [x.shared for x in r] == [["b"], ["c"]] and r[0].from_members == ["a", "b"] and r[-1].to_members == ["c", "d"]


def test_density_of_one_hot_node(spark):
    g = _edges(spark, [("CALLS", ["hot"], [f"n{i}"]) for i in range(300)])
    got = rt.density(g, g.edges.select("edge_id")).head()
    assert (got.n_edges, got.n_pairs, got.density) == (300, 300 * 299 // 2, 1.0)
    assert rt.density(g, g.edges.select("edge_id").limit(1)).head().density == 0.0


def test_first_row_and_intersections(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, None), ("b", 3, "x")], "k string, n int, v string")
    assert sorted(map(tuple, first_wins(rows, ["k"], ["n"]).collect())) == [("a", 1, None), ("b", 3, "x")]
    g = _edges(spark, [("CALLS", ["a"], ["b", "c"]), ("CALLS", ["c"], ["b"])])
    assert intersections(g.edges, spark.createDataFrame([("e0", "e1"), ("e0", "gone")], "a string, b string")).head().nodes == ["b", "c"]


def test_vectors(spark):
    v = spark.createDataFrame([("cache", [1.0, 0.0]), ("disk_cache", [0.0, 1.0]), ("other", [0.6, 0.8])], "node string, embedding array<double>")
    assert [(r.node, r.score) for r in rt.hybrid_top(v, [0.0, 1.0], ["cache"]).collect()] == [("cache", 1.0), ("disk_cache", 1.0), ("other", 0.8)]
    assert [r.node for r in rt.hybrid_top(v, [-1.0, 0.0], ["zzz"], floor=0.1).collect()] == []
    new = spark.createDataFrame([("cache", [9.0, 9.0]), ("n", [2.0, 2.0]), ("n", [1.0, 1.0])], v.schema)
    assert {(r.node, r.embedding[0]) for r in rt.put_vectors(v, new).collect()} == {("cache", 1.0), ("disk_cache", 0.0), ("other", 0.6), ("n", 1.0)}
    mapping = spark.createDataFrame([("disk_cache", "cache"), ("other", "fresh")], "merged string, keeper string")
    assert {(r.node, r.embedding[0]) for r in rt.rename_vectors(v, mapping).collect()} == {("cache", 1.0), ("fresh", 0.6)}


def test_tours(spark, tmp_path):
    t = spark.createDataFrame([("a", ["x", "y"], "active"), ("b", ["y"], "active"), ("c", ["x"], "archived"), ("d", None, "active")], "id string, tags array<string>, status string")
    of = lambda **k: {(r.id, r.pos) for r in select_tours(t, **k).collect()}
    assert of(tags=["y", "x"]) == {("a", 0), ("b", 0)} and of(ids=["c", "a"], tags=["y"]) == {("c", 0), ("a", 1)} and of() == {("a", 0), ("b", 0), ("d", 0)}
    store = TourStore(str(tmp_path / "t.json"))
    one = store.add("n", [{"node": "a", "text": ""}])
    assert store.annotate(one["id"], "a", "seen") == 1 and TourStore(store.path).get(one["id"])["steps"][0]["text"] == "seen" and os.listdir(tmp_path) == ["t.json"]
    assert store.clear() == 1 and TourStore(store.path).tours == {}


def _brute_seeds(question):
    def singular(w):
        low = w.lower()
        if low.endswith("ies") and len(w) > 4:
            return w[:-3] + "y"
        if low.endswith(("ses", "xes", "zes")) and len(w) > 3:
            return w[:-2]
        return w[:-1] if low.endswith("s") and not low.endswith("ss") and len(w) > 3 else None

    words = []
    for d in re.findall(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", question):
        words += [d, *d.split(".")]
    words += re.findall(r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", question)
    words += [p.strip() for w in re.split(r"[\s,;:!?(){}\[\]\"'`/\\]+", question) if w for p in re.split(r"[._]", w)]
    out = {}
    for w in words:
        for x in (w, singular(w)):
            if x and len(x) >= 3 and x.lower() not in SEED_STOP:
                out.setdefault(x.lower(), x)
    return list(out.values())


def test_seed_terms(spark):
    questions = ["How does Pipeline.fit reach the ValueErrors class?", "what calls validators in forms.ValidationError (entries)", "", "the and for", "SessionManager.open_all boxes_misses buses", "é à caché naïve names"]
    for r in spark.createDataFrame([(x,) for x in questions], "q string").select("q", seed_terms(F.col("q")).alias("t")).collect():
        assert r.t == _brute_seeds(r.q), r.q


def test_compact_drawing(spark):
    g = _edges(spark, [("CALLS", ["a"], ["b"]), ("ODD", ["b"], ["c"]), ("INHERITS", ["z"], ["a"])])
    nodes, edges, files = views.compact(spark.createDataFrame([("a",), ("b",), ("c",)], "node string"), views.full_edges(g))
    assert {(r.node, r.idx) for r in nodes.collect()} == {("a", 0), ("b", 1), ("c", 2)} and {tuple(r) for r in edges.collect()} == {(0, 1, 0, 0), (1, 2, 0, 1)} and files.count() == 2


def test_context_text(spark):
    g = _edges(spark, [("CALLS", ["a"], ["b"]), ("CALLS", ["b"], ["c"]), ("CALLS", ["x"], ["y"])])
    s = spark.createDataFrame([("e0", 0.9, "seed"), ("e1", 0.5, "intersection"), ("e2", 0.1, "seed")], "edge_id string, score double, retrieval_source string")
    t = rt.assemble_context(g, "q", s, [["e0", "e1"]], 0.5)
    assert "Coverage: 0.50" in t and "2 seed, 1 intersection" in t and "through b" in t and "HIGH" in t and t.index("MED") < t.index("Other edges") < t.index("LOW")


def test_hashed_vectors_and_encoders(spark):
    n = spark.createDataFrame([("open_ledger",), ("ledger.open",), ("zebra",), ("--",)], "node string")
    v = {r.node: r.embedding for r in rt.hashed_vectors(n, 128).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    assert abs(cos("zebra", "zebra") - 1) < 1e-9 and cos("open_ledger", "ledger.open") > 0.99 > 0.5 > cos("open_ledger", "zebra") and not any(v["--"])
    assert {r.node: r.embedding for r in rt.hashed_vectors(n, encoder=lambda texts: [[3.0, 4.0] for _ in texts]).collect()}["zebra"] == [0.6, 0.8]


def test_highlight_and_places(spark):
    df = spark.createDataFrame([("call core.open_all then open_all, not reopen_all or get",)], "t string")
    assert df.select(views.highlight(F.col("t"), ["core.open_all", "get"])).head()[0] == "call <strong class='tc'>core.open_all</strong> then <strong class='tc'>open_all</strong>, not reopen_all or get"
    assert df.select(views.highlight(F.col("t"), ["get"])).head()[0] == df.head()[0]
    nodes = spark.createDataFrame([(f"n{i}", "hot" if i % 3 else "few") for i in range(300)], "node string, grp string")
    placed = spark.createDataFrame([("n1", 100.0, 0.0), ("n2", 300.0, 0.0)], "node string, x double, y double")
    got = {r.node: (r.x, r.y) for r in views.place_rest(nodes, placed).collect()}
    assert len(got) == 300 and got["n1"] == (100.0, 0.0) and all(abs(x - 200) <= 90 and abs(y) <= 90 for n, (x, y) in got.items() if int(n[1:]) % 3 and n not in ("n1", "n2"))
    assert [r.node for r in views.most_important(spark.createDataFrame([("a", 1), ("b", 5), ("c", 5)], "node string, importance int"), 2).collect()] == ["b", "c"]


def test_summaries(spark):
    from weftgraph.sources.summaries import file_prompts, named_entities, summarise

    g = _edges(spark, [("CALLS", [f"a{i}"], ["b"]) for i in range(120)] + [("SUMMARY", ["f1"], ["x"])])
    assert {(r.source_path, len(r.lines)) for r in file_prompts(g.edges).collect()} == {("f0.py", 30), ("f1.py", 30), ("f2.py", 30)}

    def model(path, lines):
        if path == "f2.py":
            raise RuntimeError("no answer")
        return "It does things.\nKEY ENTITIES: `Alpha`, beta.run, Alpha"

    got = [(r.source_path, r.targets, r.edge_type) for r in summarise(g.edges, model).collect()]
    done = g.edges.where("edge_type = 'SUMMARY'").head().source_path
    assert sorted(got) == sorted((p, ["Alpha", "beta.run"], "SUMMARY") for p in {"f0.py", "f1.py"} - {done})
    assert {r.source_path for r in summarise(g.edges, model, force=True).collect()} == {"f0.py", "f1.py"}
    texts = spark.createDataFrame([("Uses SessionPool and core.open, then SessionPool.",), ("nothing here",), (None,)], "t string")
    assert [r[0] for r in texts.select(named_entities(F.col("t"))).collect()] == [["SessionPool", "core.open"], [], None]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from weftgraph.__main__ import main

    (tmp_path / "a.py").write_text("def f():\n    g()\n")
    assert main(["index", str(tmp_path)], spark) == 0 and '"edges": 2' in capsys.readouterr().out
    monkeypatch.chdir(tmp_path)
    assert main(["lookup", "a.f", "--calls"], spark) == 0 and "a.f calls g" in capsys.readouterr().out
    assert main(["search", "g", "--json"], spark) == 0 and main(["stats"], spark) == 0 and "by_type" in capsys.readouterr().out
    monkeypatch.chdir("/")
    assert main(["stats"], spark) == 1


def test_plan_folding_and_seeds(spark):
    files = [(f"a/core/f{i}.py", 2) for i in range(5)] + [(f"a/misc/f{i}.py", 1 + i % 2) for i in range(3)] + [("a/tests/x.py", 1), ("b/", 2), ("b/in.py", 1), ("b/deep/in.py", 1), ("top.py", 1), (None, 1)]
    got = {r.source_path: (r.priority, r.n) for r in rt.collapse_plan(spark.createDataFrame(files, "source_path string, priority int"), ["core"]).collect()}
    assert got == {"a/core/": (1, 5), "a/misc/": (3, 3), "a/tests/x.py": (3, 1), "b/": (2, 1), "b/deep/in.py": (1, 1), "top.py": (1, 1)}
    g = _edges(spark, [("CALLS", ["a"], ["b"]), ("CALLS", ["t"], ["u"])])
    g.edges = g.edges.withColumn("source_path", F.when(F.array_contains("all_nodes", "t"), "tests/t.py").otherwise("src/a.py"))
    names = spark.createDataFrame([("t", 0.9), ("a", 0.5), ("b", 0.1)], "node string, specificity double")
    assert [r.node for r in rt.rank_seeds(g, names, 2).collect()] == ["a", "b"] and [r.node for r in rt.rank_seeds(g, names).collect()] == ["a", "b", "t"]
