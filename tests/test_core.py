"""Operators of the core against brute force and hand-made graphs."""

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as tx
from weftgraph.operators import retrieve as rt
from weftgraph.operators import traverse as tv
from weftgraph.operators.graph import Hypergraph, canonical_edges
from weftgraph.operators.hierarchy import descendants, inherits_links, resolve_hierarchy
from weftgraph.operators.numbering import chunked_key_stats, number_rows, with_distinct
from weftgraph.sources import ingest as ing
from weftgraph.sources.tours import TourStore

EDGE = "edge_id string, relation string, edge_type string, sources array<string>, targets array<string>, all_nodes array<string>, source_path string, chunk_id string, line int, seq long, loaded_at timestamp"
FX1 = [("e1", "Session", ["HTTPAdapter", "poolmanager", "send"]), ("e2", "HTTPAdapter", ["poolmanager", "send_request"]), ("e3", "Session", ["PreparedRequest", "send"]), ("e4", "poolmanager", ["ConnectionPool", "urlopen"]), ("e5", "send", ["HTTPAdapter", "timeout"])]


def make(spark, rows, kind="CALLS"):
    return Hypergraph(canonical_edges(spark.createDataFrame([(i, f"{i} relation", kind, [s], t, None, "test.py", None, 1, n, datetime(2025, 1, 1)) for n, (i, s, t) in enumerate(rows)], EDGE)))


# numbering


def test_numbers_are_exact_per_key(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None, ""]), i, r.randint(0, 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, w long").repartition(7)
    got = number_rows(df, ["k"], ["i"], weight="w", sort_globally=True).collect()
    assert len(got) == len(rows)
    for k in {x[0] for x in rows}:
        own = sorted((x.i, x["__rank"], x["__before"], x.w) for x in got if x.k == k)
        assert [x[1] for x in own] == list(range(len(own)))
        total = 0
        for _, _, before, w in own:
            assert before == total
            total += w


def test_chunked_stats_match_counts(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", datetime(2025, 1, 1 + i % 28)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t timestamp").repartition(5)
    got = {r.k: (r.n_rows, r.latest_t) for r in chunked_key_stats(df, ["k"], latest="t", order=["t"], chunk_rows=100).collect()}
    want = Counter(k for k, _ in rows)
    assert {k: v[0] for k, v in got.items()} == want
    assert got["hot"][1] == max(t for k, t in rows if k == "hot")
    assert chunked_key_stats(df.limit(0), ["k"]).count() == 0


def test_numbering_null_keys_and_clashing_names(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, i int")
    assert sorted((r.k or "", r.n_rows) for r in chunked_key_stats(df, ["k"]).collect()) == [("", 2), ("a", 1)]
    with pytest.raises(ValueError):
        number_rows(df.withColumn("__rank", F.lit(1)), ["k"])
    with pytest.raises(ValueError):
        chunked_key_stats(df, ["k"], chunk_rows=0)
    assert with_distinct(df.select("k").distinct(), df.union(df), ["k"], "i", "n").where("k is null").head().n == 2


# hierarchies


def brute(links):
    up = {}
    for c, p in links:
        up[c] = min(up.get(c, p), p)
    out = {}
    for c in up:
        seen, x, path = {c}, c, [c]
        while x in up:
            x = up[x]
            path.append(x)
            if x in seen:
                path = None
                break
            seen.add(x)
        out[c] = (path[-1], len(path) - 1, path) if path else ("", -1, None)
    return out


@pytest.mark.parametrize("hot", [None, 2])
def test_hierarchy_matches_brute_force(spark, hot):
    r = random.Random(3)
    links = [(f"n{i}", f"n{r.randint(max(0, i - 3), i - 1)}") for i in range(1, 60)] + [(f"s{i}", "n5") for i in range(20)]
    links += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("t1", "c1"), ("t2", "t1"), ("self", "self")] + links[:5]
    df = spark.createDataFrame(links, "child string, parent string")
    full = resolve_hierarchy(df, with_path=True, hot_rows=hot)
    assert {x.node: (x.root, x.depth_from_root, x.path) for x in full.collect()} == brute(links)
    pairs = {(x.ancestor, x.descendant, x.distance) for x in descendants(full).collect()}
    assert pairs == {(a, n, d) for n, (_, _, p) in brute(links).items() if p for d, a in enumerate(p) if d}


def test_hierarchy_edges(spark):
    empty = spark.createDataFrame([], "child string, parent string")
    assert resolve_hierarchy(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a"), ("b", None), ("x", "y"), ("x", "y")], "child string, parent string")
    assert [tuple(x) for x in resolve_hierarchy(nulls).collect()] == [("x", "y", 1)]
    rows = [(["A "], [None, " ", "B\n\tC"], " inherits "), (["D"], None, "INHERITS"), (["E"], ["F"], "CALLS")]
    e = spark.createDataFrame(rows, "sources array<string>, targets array<string>, edge_type string")
    assert [tuple(x) for x in inherits_links(e).collect()] == [("A", "B C")]


# graph


def test_spec_graph_adjacency(spark):
    g = make(spark, FX1)
    assert g.adjacency(1, False).count() == 7
    assert g.adjacency(2, False).count() == 3
    assert g.adjacency(3, False).count() == 0
    assert g.adjacent_to("e1").where("edge_id = 'e2'").head().shared_nodes == "HTTPAdapter|poolmanager"


def test_insert_rules(spark):
    rows = [("a", "x", ["y"]), ("a", "x", ["z"]), ("b", "x", ["x", " x "]), ("c", " p\tq ", ["r", None, ""])]
    g = make(spark, rows)
    assert {r.edge_id: sorted(r.all_nodes) for r in g.edges.collect()} == {"a": ["x", "y"], "c": ["p q", "r"]}
    assert make(spark, FX1).remove_file("test.py").edges.count() == 0


def test_hub_thresholds(spark):
    g = make(spark, FX1)
    assert (g.hub_threshold(30), g.hub_threshold(2000), g.hub_threshold(100)) == (2, 50, 3)


def test_bfs_depth_and_direction(spark):
    g = make(spark, [("c1", "A", ["B", "X"]), ("c2", "B", ["C", "Y"]), ("c3", "C", ["D"])])
    seeds = spark.createDataFrame([("A",), ("A",), (None,), ("none",)], "node string")
    assert {(r.edge_id, r.level) for r in tv.bfs(g, seeds, 1).collect()} == {("c1", 1)}
    assert {(r.edge_id, r.level) for r in tv.bfs(g, seeds, 2).collect()} == {("c1", 1), ("c2", 2)}
    back = tv.bfs(g, spark.createDataFrame([("C",)], "node string"), 2, "backward")
    assert {r.edge_id for r in back.collect()} == {"c2"} | {r.edge_id for r in back.where("level = 2").collect()}
    hops = {r.node: r.hops for r in tv.hop_distances(g, spark.createDataFrame([("A",)], "node string")).collect()}
    assert hops == {"A": 0, "B": 1, "X": 1, "C": 2, "Y": 2, "D": 3}


def test_paths(spark):
    g = make(spark, FX1)
    found = tv.find_paths(g, "PreparedRequest", "ConnectionPool").collect()
    assert found and all(r.length >= 2 for r in found)
    assert tv.find_paths(g, "Session", "HTTPAdapter").head().path == "e1"
    assert tv.find_paths(g, "Session", "nowhere").count() == 0


def test_merge_nodes(spark):
    g = make(spark, FX1).merge_nodes(spark.createDataFrame([("HTTPAdapter", "poolmanager")], "merged string, keeper string"))
    assert {r.edge_id: r.targets for r in g.edges.collect()}["e1"] == ["poolmanager", "poolmanager", "send"]


def test_lookup_and_text_search(spark):
    g = make(spark, [("e1", "sessions.Session", ["sessions.Session.send", "sessions.Session.get"]), ("e2", "sessions.Session.send", ["get_adapter", "adapter.send"])], "DEFINES")
    names = rt.match_names(g, "send", ["send"])
    assert {r.node for r in names.collect()} == {"sessions.Session.send", "adapter.send"}
    assert rt.text_search(g, ["session"]).head().quality == 1
    assert rt.infer_edge_types("who calls and extends this?") == ["CALLS", "INHERITS"]


def test_dispatch(spark):
    from weftgraph.plans.plan import dispatch

    p = dispatch(make(spark, FX1), "what calls send_request")
    assert p.to_dict()["primary_files"] and 1 in p.tiers
    assert "Symbols:" in p.format_text()
    assert p.without_tests().files.count() <= p.files.count()


def test_similar_pairs_match_brute_force(spark):
    r = random.Random(5)
    vs = []
    for i in range(120):
        v = [r.gauss(0, 1) for _ in range(6)]
        n = sum(x * x for x in v) ** 0.5
        vs.append((i, [x / n for x in v]))
    got = {(x.a, x.b) for x in rt.similar_pairs(spark.createDataFrame(vs, "vec_id long, embedding array<double>"), 0.8).collect()}
    want = {(a, b) for a, x in vs for b, y in vs if a < b and sum(p * q for p, q in zip(x, y)) >= 0.8}
    assert got == want


# text and sources


def test_tokens(spark):
    d = spark.createDataFrame([("How does Session.send use my_func?",)], "q string")
    r = d.select(tx.lookup_tokens(F.col("q")).alias("a"), tx.search_terms(F.col("q")).alias("b")).head()
    assert r.a == ["session.send", "session", "send", "my", "func"]
    assert r.b == ["session", "send", "session.send", "func"]


def test_python_extraction():
    src = "import os\nfrom a import b as c\nclass R(Base):\n    @wrap\n    def read(self, x: int) -> str:\n        if x: raise ValueError('n')\n        return self.open(x)\n"
    got = {(k, s[0], tuple(t)) for k, s, t, _ in ing.python_edges("lib/reader.py", src)}
    assert ("INHERITS", "reader.R", ("Base",)) in got and ("RAISES", "reader.R.read", ("ValueError",)) in got
    assert ("SIGNATURE", "reader.R.read", ("int", "str")) in got and ("IMPORTS", "reader", ("a", "c")) in got
    assert ("DECORATES", "wrap", ("reader.R.read",)) in got
    assert ing.python_edges("x.py", "def (") == []
    assert [c[:2] for c in ing.python_chunks(src)] == [("__preamble__", "preamble"), ("R", "class"), ("R.read", "method")]


def test_scan_and_changes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text("1")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    d = ing.scan_directory(spark, str(tmp_path))
    assert [(r.source_path, r.is_code) for r in d.collect()] == [("src/a.py", True)]
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("n", None)], "source_path string, markdown string")
    new = spark.createDataFrame([("a", "2"), ("c", "1"), ("n", None)], "source_path string, markdown string")
    assert {tuple(r) for r in ing.changes(old, new).collect()} == {("a", "modified"), ("b", "deleted"), ("c", "added"), ("n", "unchanged")}


def test_windows_and_sections(spark):
    d = spark.createDataFrame([(1, "x" * 4000), (2, ""), (3, None), (4, "# A\ntext\n## B\nmore")], "id long, t string")
    assert [r.start for r in ing.fixed_windows(d, "id", "t").where("id = 1").orderBy("start").collect()] == [0, 1800, 3600]
    assert [r.heading for r in ing.markdown_sections(d.where("id = 4"), "id", "t").orderBy("pos").collect()] == ["A", "B"]


def test_tour_store(tmp_path):
    s = TourStore(str(tmp_path / "t.json"))
    t = s.add("one", [{"node": "a", "text": ""}], tags=["x"])
    assert s.append(t["id"], [{"node": "a"}, {"node": "b"}]) == (1, 1)
    s.start(t["id"])
    with pytest.raises(ValueError):
        s.set_status(t["id"], "nonsense")
    again = TourStore(s.path)
    assert again.active == t["id"] and again.get(t["id"])["step_count"] == 2
    assert TourStore(str(tmp_path / "u.json")).load(again.export()) == 1


def test_stream_ingest_is_idempotent(spark, tmp_path):
    from weftgraph.streaming.incremental import edge_stream, ingest

    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    raw = spark.createDataFrame([(i, "r", "CALLS", [s], t, None, "p", None, 1, n, datetime(2025, 1, 1)) for n, (i, s, t) in enumerate(FX1)], EDGE)
    raw.write.parquet(src)
    ingest(edge_stream(spark, src, raw), out, chk).awaitTermination()
    raw.write.mode("append").parquet(src)
    ingest(edge_stream(spark, src, raw), out, chk).awaitTermination()
    assert spark.read.parquet(out).count() == len(FX1)


def test_call_chains(spark):
    g = make(spark, [("c1", "A", ["B", "X"]), ("c2", "B", ["C", "Y"]), ("c3", "C", ["A", "D"]), ("c4", "P", ["Q"]), ("c5", "R", ["R"])])
    got = {r.chain: r.length for r in tv.call_chains(g).collect()}
    assert got["A -> B -> C -> D"] == 4 and got["P -> Q"] == 2
    assert all(not c.startswith("R") for c in got)


def test_call_chains_are_whole(spark):
    deep = [(f"d{i}", f"d{i:02d}", [f"d{i + 1:02d}"]) for i in range(14)]
    got = [(r.chain, r.length) for r in tv.call_chains(make(spark, deep)).collect()]
    assert got == [(" -> ".join(f"d{i:02d}" for i in range(15)), 15)]
    ring = [(f"r{i}", f"r{i}", [f"r{(i + 1) % 6}"]) for i in range(6)]  # six walks over the same nodes
    pairs = [(f"p{i}", f"p{i}", [f"q{i}"]) for i in range(3)]
    got = [r.chain for r in tv.call_chains(make(spark, ring + pairs), top=4).collect()]
    assert got == ["r0 -> r1 -> r2 -> r3 -> r4 -> r5", "p0 -> q0", "p1 -> q1", "p2 -> q2"]
    tails = [(f"t{i}", f"t{i}", [f"t{i + 1}"]) for i in range(45)]  # 45 walks, each within the one before
    got = [(r.chain, r.length) for r in tv.call_chains(make(spark, tails + pairs), top=2).collect()]
    assert got[0][1] == 46 and got[1] == ("p0 -> q0", 2)


def test_expand_seeds(spark):
    from weftgraph.operators.views import expand_seeds

    g = make(spark, [("e1", "a.b.Run", ["Run", "Run.stop"]), ("e2", "Running", ["x.y"])])
    of = lambda *s: {r.node for r in expand_seeds(g, spark.createDataFrame([(x,) for x in s], "node string")).collect()}
    assert of("Run") == {"a.b.Run", "Run", "Run.stop"} and of("z.Run") == {"Run"} and of("none") == set()
