"""More graph operators as named queries with SQL twins: relations, paths, hybrid and semantic search, coverage, tours, drawing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import NODE, _query_vector, _some_retrieved, base, graph, q, words
from .functions import text as tx
from .operators import retrieve as rt
from .operators import traverse as tv
from .operators import views
from .operators.graph import first_wins, intersections
from .runtime import table
from .sources import tours as to

_FWD = "CASE edge_type " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in rt.LABELS.items()) + " ELSE 'related to' END"
_REV = "CASE edge_type " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in rt.LABELS.items()) + " ELSE 'related to' END"
_REL = f"CASE WHEN list_contains(s, node) THEN {_FWD} ELSE {_REV} END AS relationship, array_to_string(CASE WHEN list_contains(s, node) THEN t ELSE s END, '|') AS targets"
_RESOLVE = "m AS (SELECT node FROM d WHERE lower(node) = 'resolve' OR list_last(string_split(lower(node), '.')) = 'resolve')"


def _flat(x: DataFrame) -> DataFrame:
    return x.withColumn("targets", F.array_join("targets", "|"))


@q(base(f", {_RESOLVE} SELECT i.edge_id, i.node, e.edge_type, e.path AS source_path, {_REL.replace('edge_type', 'e.edge_type').replace('node', 'i.node')} FROM i JOIN e USING (edge_id) WHERE i.node IN (SELECT node FROM m)"))
def r1_lookup_relations(spark, sf):
    """What every edge on a matched node says of it."""
    g = graph(spark, sf)
    return _flat(rt.lookup(g, rt.match_names(g, "resolve", ["resolve"]))[1])


@q(base(f", {_RESOLVE}, x AS (SELECT unnest(CASE WHEN list_contains(s, i.node) THEN t ELSE s END) AS o FROM i JOIN e USING (edge_id) WHERE i.node IN (SELECT node FROM m)) SELECT DISTINCT list_last(string_split(o, '.')) AS pattern FROM x WHERE length(list_last(string_split(o, '.'))) >= 3"))
def r1_lookup_greps(spark, sf):
    g = graph(spark, sf)
    return rt.grep_patterns(rt.lookup(g, rt.match_names(g, "resolve", ["resolve"]))[1])


_CALLER = "registry.rotate_filter"


@q(base(f""", c1 AS (SELECT edge_id, min(node) AS node FROM i WHERE node = '{_CALLER}' GROUP BY 1), l1 AS (SELECT c1.*, e.s, e.t, e.edge_type FROM c1 JOIN e USING (edge_id)), p1 AS (SELECT * FROM l1 WHERE list_contains(s, node)),
f2 AS (SELECT DISTINCT x AS node FROM (SELECT unnest(t) AS x FROM p1) WHERE x <> '{_CALLER}' AND x NOT IN (SELECT node FROM hub)),
c2 AS (SELECT edge_id, min(node) AS node FROM i WHERE node IN (SELECT node FROM f2) AND edge_id NOT IN (SELECT edge_id FROM l1) GROUP BY 1), l2 AS (SELECT c2.*, e.s, e.t, e.edge_type FROM c2 JOIN e USING (edge_id)), p2 AS (SELECT * FROM l2 WHERE list_contains(s, node)),
x AS (SELECT *, 1 AS level FROM p1 UNION ALL SELECT *, 2 FROM p2) SELECT edge_id, node, level, {_FWD} AS relationship, array_to_string(t, '|') AS targets FROM x"""))
def g1_bfs_relations(spark, sf):
    """A forward search from a caller, and what each met edge says."""
    g = graph(spark, sf)
    met = tv.bfs(g, words(spark, _CALLER), 2, "forward", hubs=g.default_hubs())
    return met.join(_flat(rt.relate(g, met)), ["edge_id", "node"]).select("edge_id", "node", "level", "relationship", "targets")


@q(base(f", o AS (SELECT DISTINCT edge_id FROM i WHERE node = '{NODE}' ORDER BY edge_id LIMIT 4), p AS (SELECT edge_id AS a, lead(edge_id) OVER (ORDER BY edge_id) AS b, CAST(row_number() OVER (ORDER BY edge_id) AS INT) AS hop FROM o) SELECT hop, a AS from_edge, b AS to_edge, array_to_string(list_sort(list_intersect(x.nodes, y.nodes)), '|') AS shared, array_to_string(list_sort(x.nodes), '|') AS from_members, array_to_string(list_sort(y.nodes), '|') AS to_members FROM p JOIN e x ON x.edge_id = a JOIN e y ON y.edge_id = b"))
def g5_path_report(spark, sf):
    """The path along the first four edges of a node."""
    g = graph(spark, sf)
    path = [r[0] for r in g.incidence.where(F.col("node") == NODE).select("edge_id").distinct().orderBy("edge_id").limit(4).collect()]
    x = tv.path_report(g, path)
    return x.select("hop", "from_edge", "to_edge", *[F.array_join(c, "|").alias(c) for c in ("shared", "from_members", "to_members")])


@q()
def g6_traversal_paths(spark, sf):
    """Greedy paths through the 300 best edges of the retrieved ones; the best third are seeds."""
    g = graph(spark, sf)
    best = table(spark, sf, "scored_edges").where("score is not null").groupBy("edge_id").agg(F.max("score").alias("score")).join(g.edges.select("edge_id", "edge_type"), "edge_id").orderBy(F.desc("score"), "edge_id").limit(300)
    ranked = best.withColumn("retrieval_source", F.when(F.col("score") >= 0.9, "seed").otherwise("intersection"))
    paths = tv.traversal_paths(g, ranked, hubs=g.default_hubs())
    return spark.createDataFrame([(k, " > ".join(p), len(p)) for k, p in enumerate(paths, 1)], "place int, path string, length int")


@q(base(", x AS (SELECT path, min(edge_id) AS a, max(edge_id) AS b FROM e GROUP BY path HAVING count(*) > 1), p AS (SELECT DISTINCT a, b FROM x) SELECT a, b, array_to_string(list_sort(list_intersect(x.nodes, y.nodes)), '|') AS nodes FROM p JOIN e x ON x.edge_id = a JOIN e y ON y.edge_id = b"))
def join_intersections(spark, sf):
    """What the first and the last edge of every file share."""
    e = graph(spark, sf).edges
    pairs = e.groupBy("source_path").agg(F.min("edge_id").alias("a"), F.max("edge_id").alias("b")).where("a <> b")
    return intersections(e, pairs).withColumn("nodes", F.array_join("nodes", "|"))


@q("SELECT query, edge_id, result_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query, edge_id ORDER BY result_id, scored_at, score) AS n FROM scored_edges) WHERE n = 1")
def w3_first_row_wins(spark, sf):
    """The whole first row of every query and edge."""
    x = table(spark, sf, "scored_edges").select("query", "edge_id", "result_id", "score", "scored_at")
    return first_wins(x, ["query", "edge_id"], ["result_id", "scored_at", "score"]).drop("scored_at")


@q(base("SELECT edge_type, count(*) AS edges FROM e GROUP BY 1"))
def agg_stats_by_type(spark, sf):
    return graph(spark, sf).type_counts()


@q(base(", r AS (SELECT DISTINCT edge_id FROM scored_edges WHERE score >= 0.9), h AS (SELECT DISTINCT node FROM i WHERE edge_id IN (SELECT edge_id FROM r)) SELECT count(*) AS seeds, count(*) FILTER (node IN (SELECT node FROM h)) AS covered, round(count(*) FILTER (node IN (SELECT node FROM h)) / count(*), 4) AS score FROM d"))
def r17_coverage_score(spark, sf):
    """How many of all nodes the well scored edges hold."""
    g = graph(spark, sf)
    return rt.coverage_score(g, _some_retrieved(spark, sf), g.degrees())


@q("SELECT coalesce(retrieval_source, '') AS source, CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MED' ELSE 'LOW' END AS tier, count(*) AS n FROM scored_edges WHERE score IS NOT NULL GROUP BY ALL")
def r18_confidence_tiers(spark, sf):
    x = table(spark, sf, "scored_edges").where("score is not null")
    return x.groupBy(F.coalesce("retrieval_source", F.lit("")).alias("source"), rt.confidence(F.col("score")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def _vectors(spark, sf):
    """The test vectors given to nodes: the n-th vector to the n-th name in order."""
    names = graph(spark, sf).degrees().select("node", (F.row_number().over(Window.orderBy("node")) - 1).cast("long").alias("vec_id"))
    return names.join(table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "vec_id").select("node", "embedding")


_VEC = ", nv AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS vec_id FROM d), ev AS (SELECT node, embedding::DOUBLE[] AS v FROM nv JOIN embeddings USING (vec_id)), qv AS (SELECT embedding::DOUBLE[] AS w FROM embeddings ORDER BY vec_id LIMIT 1), hy AS (SELECT node, round(greatest(list_inner_product(v, w), CASE WHEN lower(node) IN ('cache', 'cursor') THEN 1.0::DOUBLE WHEN contains(lower(node), 'cache') OR contains(lower(node), 'cursor') THEN 0.85 ELSE 0 END), 6) AS score FROM ev, qv ORDER BY score DESC, node LIMIT 40)"


@q(base(_VEC + " SELECT node, score FROM hy"))
def v1_hybrid_top(spark, sf):
    """Cosine or keyword, whichever is greater."""
    return rt.hybrid_top(_vectors(spark, sf), _query_vector(spark, sf), ["cache", "cursor"], 40)


@q(base(_VEC + " SELECT path AS source_path, max(score) AS score, 2 AS priority FROM i JOIN hy USING (node) WHERE score >= 0.1 AND path <> '' GROUP BY 1"))
def r14_semantic_files(spark, sf):
    return rt.semantic_search(graph(spark, sf), v1_hybrid_top(spark, sf))[0]


@q(base(_VEC.split(", qv AS")[0] + ", mp AS (SELECT node AS merged, lower(node) AS keeper FROM ev WHERE node <> lower(node)), mv AS (SELECT keeper AS node, min(merged) AS was FROM mp GROUP BY 1), kept AS (SELECT node FROM ev WHERE node NOT IN (SELECT merged FROM mp)) SELECT node, node AS was FROM kept UNION ALL SELECT node, was FROM mv WHERE node NOT IN (SELECT node FROM kept)"))
def m9_rename_vectors(spark, sf):
    """Vectors moved to the lower-cased name; ``was`` tells whose vector it is."""
    v = _vectors(spark, sf).select("node", F.col("node").alias("embedding"))
    mapping = v.select(F.col("node").alias("merged"), F.lower("node").alias("keeper")).where("merged <> keeper")
    return rt.rename_vectors(v, mapping).select("node", F.col("embedding").alias("was"))


@q(base(", st AS (SELECT node FROM d WHERE degree >= 3) SELECT node, CASE WHEN node IN (SELECT node FROM st) THEN 'stored' ELSE 'new' END AS v FROM d WHERE node <> 'str'"))
def m9_put_and_remove_vectors(spark, sf):
    d = graph(spark, sf).degrees()
    stored, new = d.where("degree >= 3").select("node", F.lit("stored").alias("embedding")), d.select("node", F.lit("new").alias("embedding"))
    return rt.remove_vectors(rt.put_vectors(stored, new), words(spark, "str")).select("node", F.col("embedding").alias("v"))


@q("WITH w AS (SELECT tag, min(pos) AS pos FROM (VALUES ('signed', 0), ('partial', 1), ('nested', 2)) AS v(tag, pos) GROUP BY 1), x AS (SELECT id, min(pos) AS pos FROM (SELECT DISTINCT id, status, unnest(tags) AS tag FROM tours) JOIN w USING (tag) WHERE status = 'active' GROUP BY 1) SELECT id, CAST(pos AS INT) AS pos FROM x")
def t_select_by_tags(spark, sf):
    return to.select_tours(table(spark, sf, "tours"), tags=["signed", "partial", "nested"]).select("id", "pos").distinct()


@q("WITH t AS (SELECT DISTINCT id FROM tours ORDER BY id LIMIT 3) SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS pos FROM t")
def t_select_by_ids(spark, sf):
    """Three tours by id, whatever their status."""
    t = table(spark, sf, "tours")
    ids = [r[0] for r in t.select("id").distinct().orderBy("id").limit(3).collect()]
    return to.select_tours(t, tags=["signed"], ids=ids).select("id", "pos").distinct()


@q(base(", x AS (SELECT src AS source, dst AS target, edge_type, min(path) AS file FROM a WHERE src <> dst GROUP BY 1, 2, 3) SELECT * FROM x"))
def z2_full_edges(spark, sf):
    """All edges of a drawing of the whole graph, of every type."""
    return views.full_edges(graph(spark, sf))


@q(base(", x AS (SELECT src AS node FROM a UNION ALL SELECT dst FROM a) SELECT node, count(*) AS degree FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def z2_hub_nodes(spark, sf):
    return views.top_nodes(graph(spark, sf), 20)


@q(base(", x AS (SELECT src AS node FROM a UNION ALL SELECT dst FROM a), t AS (SELECT node FROM x GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 200), nx AS (SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS INT) AS idx FROM t), y AS (SELECT src, dst, edge_type, min(path) AS file FROM a WHERE src <> dst AND src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t) GROUP BY 1, 2, 3), f AS (SELECT file, CAST(row_number() OVER (ORDER BY file) - 1 AS INT) AS idx FROM (SELECT DISTINCT file FROM y WHERE file <> '')) SELECT p.idx AS source, r.idx AS target, CAST(coalesce(list_position(" + str(list(views.TYPE_CODES)) + ", edge_type) - 1, 0) AS INT) AS type, coalesce(f.idx, -1) AS file FROM y JOIN nx p ON p.node = src JOIN nx r ON r.node = dst LEFT JOIN f ON f.file = y.file"))
def z6_compact_edges(spark, sf):
    """The edges among the 200 most connected nodes as numbers."""
    g = graph(spark, sf)
    top = views.top_nodes(g, 200).select("node")
    return views.compact(top, views.full_edges(g))[1]


@q(base(", x AS (SELECT src AS node, edge_type FROM a UNION ALL SELECT dst, edge_type FROM a), p AS (SELECT node, 2 * (count(*) FILTER (edge_type IN ('CALLS', 'INHERITS'))) + count(*) AS importance FROM x GROUP BY 1) SELECT node, CASE WHEN importance >= 30 THEN 10.0::DOUBLE WHEN importance >= 15 THEN 7 WHEN importance >= 5 THEN 4.5 ELSE 2.5 END AS radius FROM p"))
def f16_node_radius(spark, sf):
    return tv.pairwise(graph(spark, sf)).select("node", views.radius(F.col("importance")).alias("radius"))


@q()
def f5_seed_terms(spark, sf):
    x = table(spark, sf, "scored_edges").where("query is not null").select("query").distinct()
    return x.select("query", F.array_join(tx.seed_terms(F.col("query")), "|").alias("terms"))


@q(base(f""", m AS (SELECT edge_id, node FROM i WHERE node = '{_CALLER}'), x AS (SELECT m.node, e.edge_type, e.path, s, t, m.edge_id FROM m JOIN e USING (edge_id)), o AS (SELECT DISTINCT unnest(CASE WHEN list_contains(s, node) THEN t ELSE s END) AS node FROM x WHERE path <> '')
SELECT node FROM (SELECT node FROM x UNION SELECT node FROM o)"""))
def t6_scaffold_nodes(spark, sf):
    """Steps of a look-up: the symbol and the other ends of its edges."""
    from .plans.plan import Plan
    from .plans.probe import scaffold

    g = graph(spark, sf)
    return scaffold(Plan(_CALLER, *rt.lookup(g, words(spark, _CALLER)))).select("node")


@q(base(r""", f AS (SELECT path, min(CASE WHEN edge_type IN ('DEFINES', 'CALLS') THEN 1 ELSE 2 END) AS priority FROM e WHERE path <> '' GROUP BY 1), g AS (SELECT CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS dir, path, priority FROM f),
c AS (SELECT dir, count(*) AS n, min(priority) AS best FROM g GROUP BY 1 HAVING count(*) >= 3),
x AS (SELECT dir || '/' AS source_path, CASE WHEN contains(lower(list_last(string_split(dir, '/'))), 'core') AND n >= 5 THEN 1 WHEN contains(lower(list_last(string_split(dir, '/'))), 'core') OR n >= 7 THEN 2 ELSE greatest(best, 3) END AS priority, n FROM c UNION ALL SELECT path, priority, 1 FROM g WHERE dir NOT IN (SELECT dir FROM c))
SELECT source_path, n, CAST(priority + CASE WHEN len(list_filter(string_split(lower(source_path), '/'), lambda v: v IN ('tests', 'test') OR starts_with(v, 'test_'))) > 0 OR ends_with(lower(source_path), '_test.py') OR list_last(string_split(lower(source_path), '/')) IN ('conftest.py', 'testing.py') THEN 2 ELSE 0 END AS INT) AS priority FROM x"""))
def r8_collapse_plan(spark, sf):
    """All files of the graph folded as a plan's files are."""
    e = graph(spark, sf).edges.where("source_path <> ''")
    files = e.groupBy("source_path").agg(F.min(F.when(F.col("edge_type").isin("DEFINES", "CALLS"), 1).otherwise(2)).alias("priority"))
    return rt.collapse_plan(files, ["core"])


@q(base(", x AS (SELECT path, dst, min(seq) AS mn FROM a WHERE edge_type = 'DEFINES' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mn, dst) AS k, count(*) OVER (PARTITION BY path) AS n FROM x), d5 AS (SELECT path, string_agg(string_split(dst, '.')[-1], ', ' ORDER BY k) || CASE WHEN max(n) > 5 THEN ' (+' || (max(n) - 5) || ' more)' ELSE '' END AS description FROM r WHERE k <= 5 GROUP BY 1), sm AS (SELECT path, arg_min(relation, (seq, edge_id)) AS relation FROM e WHERE edge_type = 'SUMMARY' AND path <> '' GROUP BY 1) SELECT coalesce(sm.path, d5.path) AS source_path, coalesce(sm.relation, d5.description) AS description FROM d5 FULL JOIN sm ON d5.path = sm.path"))
def a10_module_descriptions(spark, sf):
    """What a file's summary says, else the names that it defines."""
    from .catalog import agg_module_descriptions

    sm = graph(spark, sf).edges.where("edge_type = 'SUMMARY' and source_path <> ''").groupBy("source_path").agg(F.min_by("relation", F.struct("seq", "edge_id")).alias("relation"))
    return agg_module_descriptions(spark, sf).join(sm, "source_path", "full").select("source_path", F.coalesce("relation", "description").alias("description"))


@q("WITH t AS (SELECT DISTINCT id, promoted, tags, steps FROM tours), s AS (SELECT id, unnest(steps) AS s FROM t) SELECT (SELECT count(DISTINCT id) FROM t) AS tours, (SELECT count(DISTINCT id) FROM t WHERE promoted) AS promoted, (SELECT count(*) FROM s) AS steps, (SELECT count(DISTINCT s.file) FROM s WHERE s.file <> '') AS files, (SELECT count(DISTINCT tag) FROM (SELECT unnest(tags) AS tag FROM t)) AS tags")
def a14_tour_totals(spark, sf):
    """One row: tours, promoted ones, steps, files that steps name, tags."""
    t = table(spark, sf, "tours").select("id", "promoted", "tags", "steps").distinct()
    per = t.agg(F.countDistinct("id").alias("tours"), F.countDistinct(F.when(F.col("promoted"), F.col("id"))).alias("promoted"))
    s = t.select(F.explode("steps").alias("s")).agg(F.count(F.lit(1)).alias("steps"), F.countDistinct(F.nullif("s.file", F.lit(""))).alias("files"))
    return per.join(s).join(t.select(F.explode("tags").alias("tag")).agg(F.countDistinct("tag").alias("tags")))  # one row each
