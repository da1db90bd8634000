"""Sessions over a folder of files, probes, node merging and drawing."""

import random

from pyspark.sql import functions as F

from weftgraph.operators.simplify import merge_map
from weftgraph.operators.views import layout, subgraph
from weftgraph.plans.probe import strategies, strategies_of
from weftgraph.session import GraphSession, Registry

CODE = "import os\n\nclass Base:\n    def send(self, x: int) -> str:\n        return os.path.join(self.root, x)\n\nclass Child(Base):\n    def run(self):\n        raise ValueError(self.send(1))\n"


def test_index_query_and_reindex(spark, tmp_path):
    root, cache = tmp_path / "repo", str(tmp_path / "cache")
    (root / "lib").mkdir(parents=True)
    (root / "lib" / "net.py").write_text(CODE)
    (root / "lib" / "other.py").write_text("def helper():\n    print(1)\n    return open(2)\n")
    s = GraphSession.index(spark, str(root), cache)
    n = s.graph.edges.count()
    assert n > 5 and s.stats()["edges"] == n
    assert [r["source_path"] for r in s.lookup("send").to_dict()["primary_files"]] == ["lib/net.py"]
    assert s.search("child").where("quality = 1").count() == 1
    assert s.query("what does Child inherit").symbols.where("edge_type = 'INHERITS'").count() == 1
    assert s.overview()["files"] == 2
    (root / "lib" / "other.py").unlink()
    (root / "lib" / "new.py").write_text("import json\nimport re\n")
    again = GraphSession.index(spark, str(root), cache)
    assert {r.source_path for r in again.graph.edges.select("source_path").distinct().collect()} == {"lib/net.py", "lib/new.py"}
    tour = again.blast_radius("send", 1)
    assert tour["steps"] and again.tours.get(tour["id"])["tags"] == ["blast-radius"]
    assert again.probe("which subclass hierarchy has Base")["steps"]
    reg = Registry()
    reg.add("a", again)
    assert reg.get() is again and reg.listing()[0]["active"]
    nodes, edges = subgraph(again.graph, spark.createDataFrame([("net.Child",)], "node string"))
    assert nodes.where("hops = 0").head().importance >= 15 and edges.count() > 0


def test_strategies(spark):
    assert strategies_of("who calls this and what does it raise") == ["blast-radius", "exception-flow"] or strategies_of("who calls it") == ["blast-radius"]
    assert strategies_of("hello") == ["exploration"]
    d = spark.createDataFrame([("class hierarchy of X",), ("hello",)], "q string").select(F.array_join(strategies(F.col("q")), "|").alias("s"))
    assert [r.s for r in d.collect()] == ["inheritance", "exploration"]


def test_merge_map_has_no_chains(spark):
    pairs = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.985), ("a", "c", 0.98), ("d", "e", 0.97), ("a", "b", 0.99)], "a string, b string, score double")
    deg = spark.createDataFrame([("a", 5), ("b", 2), ("c", 9), ("e", 3)], "node string, degree long")
    got = {r.merged: r.keeper for r in merge_map(pairs, deg).collect()}
    assert got["b"] == "a" and got["d"] == "e" and not set(got) & set(got.values())
    assert merge_map(pairs.limit(0), deg).count() == 0


def test_merge_map_ends_the_greedy_order(spark):
    r = random.Random(5)
    star = [("hub", f"m{i:03d}", 0.99 - i / 1000) for i in range(120)]
    chain = [(f"c{i:03d}", f"c{i + 1:03d}", 0.5 + i / 1000) for i in range(150)]
    loose = list({(f"x{a}", f"x{b}"): (f"x{a}", f"x{b}", r.randint(1, 9) / 10) for a, b in (sorted(r.sample(range(40), 2)) for _ in range(150))}.values())
    rows, degree = star + chain + loose, {"hub": 500} | {f"x{i}": r.randint(0, 3) for i in range(40)}
    want: dict = {}
    order = []
    for a, b, score in rows:
        keep = a if (-degree.get(a, 0), a) < (-degree.get(b, 0), b) else b
        order.append((-score, keep, b if keep == a else a))
    for _, k, m in sorted(order):
        if k not in want and m not in want and m not in want.values():
            want[m] = k
    deg = spark.createDataFrame(list(degree.items()), "node string, degree long")
    f = lambda x, **k: {r.merged: r.keeper for r in merge_map(spark.createDataFrame(x, "a string, b string, score double"), deg, **k).collect()}
    assert sum(v == "hub" for v in want.values()) == 120 and sum(k[0] == "c" for k in want) == 75
    assert f(rows) == want
    assert f(star + loose, few=0) == {m: k for m, k in want.items() if m[0] != "c"}


def test_layout():
    pos = layout(["a", "b", "c"], [("a", "b", "CALLS"), ("x", "b", "CALLS")])
    assert set(pos) == {"a", "b", "c"} and max(abs(v) for p in pos.values() for v in p) <= 1000.01
    many = layout([str(i) for i in range(400)], [(str(i), str(i + 1), "DEFINES") for i in range(399)], steps=5)
    assert len(many) == 400 and layout([], []) == {}
