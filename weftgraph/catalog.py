"""The graph operators as named queries over the test tables, with SQL twins. Names begin with the operator family: m (edits), s and k (sources, chunks), proj, join, agg, w (ranking), u (sets), g (traversal), r (retrieval), f (functions), v (vectors), t (tours), z (views)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.names import clean_nodes, clean_type, normalise_node
from .operators import retrieve as rt
from .operators import traverse as tv
from .operators.graph import Hypergraph, canonical_edges, specificity, type_weight
from .runtime import exists, materialize, stamp, table
from .sources import ingest as ing
from .sources import tours as to

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NODE = "self.registry.resolve"
SEEDS = ("self.registry.resolve", "dict.get")
FILE = "harborline/src/core/registry.py"


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _norm(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\x00-\x1f\x7f\s]+', ' ', 'g'))"


def _clean(x: str) -> str:
    return f"coalesce(list_filter(list_transform({x}, lambda n: {_norm('n')}), lambda n: n IS NOT NULL AND n <> ''), [])"


BASE = f"""e0 AS (SELECT edge_id, relation, upper(trim(edge_type)) AS edge_type, {_clean('sources')} AS s, {_clean('targets')} AS t, CASE WHEN all_nodes IS NULL THEN list_distinct(list_concat({_clean('sources')}, {_clean('targets')})) ELSE list_distinct({_clean('all_nodes')}) END AS nodes,
  coalesce(source_path, '') AS path, coalesce(chunk_id, '') AS chunk_id, line, seq, row_number() OVER (PARTITION BY edge_id ORDER BY seq, loaded_at) AS rn FROM hyperedges),
e AS (SELECT * FROM e0 WHERE rn = 1 AND len(nodes) >= 2),
i AS (SELECT edge_id, edge_type, seq, path, unnest(nodes) AS node FROM e),
d AS (SELECT node, count(*) AS degree FROM i GROUP BY node),
n AS (SELECT count(*) AS n FROM e),
hub AS (SELECT node FROM d, n WHERE degree > least(greatest(2, CAST(floor(n * 0.03::DOUBLE) AS INT)), 50)),
a AS (SELECT edge_id, edge_type, seq, path, src, unnest(t) AS dst FROM (SELECT edge_id, edge_type, seq, path, t, unnest(s) AS src FROM e))"""


def base(rest: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{BASE}{rest if rest.startswith(',') else ' ' + rest}"


_graphs: dict[tuple, Hypergraph] = {}


def graph(spark: SparkSession, sf: str) -> Hypergraph:
    """The graph of a folder's table: the canonical edges are written once per application and version of the table, and every query reads that."""
    key = (spark.sparkContext.applicationId, stamp(spark, f"{sf}/hyperedges.parquet"))
    if key not in _graphs or not exists(spark, _graphs[key].edges._weft_path):
        _graphs[key] = Hypergraph(materialize(canonical_edges(table(spark, sf, "hyperedges")), "edges"))
    return _graphs[key]


def words(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in names], "node string")


# edits


@q(base("SELECT edge_type, count(*) AS n, sum(len(nodes)) AS members FROM e GROUP BY 1"))
def m1_insert(spark, sf):
    return graph(spark, sf).edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("all_nodes")).alias("members"))


@q(f"SELECT DISTINCT {_norm('x')} AS node FROM (SELECT unnest(targets) AS x FROM hyperedges) WHERE x IS NOT NULL AND {_norm('x')} <> ''")
def m2_normalise(spark, sf):
    return table(spark, sf, "hyperedges").select(F.explode("targets").alias("x")).select(normalise_node(F.col("x")).alias("node")).where("node <> ''").distinct()


@q(base(f"SELECT path AS source_path, count(*) AS n FROM e WHERE path <> '{FILE}' GROUP BY 1"))
def m3_delete_by_file(spark, sf):
    return graph(spark, sf).remove_file(FILE).edges.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))


@q(base("SELECT edge_type, count(*) AS n FROM e WHERE edge_id NOT IN (SELECT edge_id FROM scored_edges WHERE edge_id IS NOT NULL) GROUP BY 1"))
def m4_delete_by_id(spark, sf):
    g = graph(spark, sf)
    return g.remove_edges(table(spark, sf, "scored_edges")).edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def _versions(spark, sf):
    d = table(spark, sf, "converted_documents").select("source_path", "markdown", "converted_at", "loaded_at")
    rank = F.struct("converted_at", "loaded_at", F.md5("markdown"))
    pick = lambda f: d.groupBy("source_path").agg(f("markdown", rank).alias("markdown"))
    return pick(F.min_by), pick(F.max_by)


@q("""WITH r AS (SELECT source_path, sha256(markdown) AS h, row_number() OVER (PARTITION BY source_path ORDER BY converted_at, loaded_at, md5(markdown)) AS lo, row_number() OVER (PARTITION BY source_path ORDER BY converted_at DESC, loaded_at DESC, md5(markdown) DESC) AS hi FROM converted_documents)
SELECT a.source_path, CASE WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS status FROM r a JOIN r b ON a.source_path = b.source_path AND a.lo = 1 AND b.hi = 1""")
def m5_changes(spark, sf):
    return ing.changes(*_versions(spark, sf))


@q(base(""", mp AS (SELECT DISTINCT node AS merged, lower(node) AS keeper FROM i WHERE node <> lower(node)),
x AS (SELECT e.edge_id, list_distinct(list_transform(nodes, lambda v: lower(v))) AS nodes FROM e) SELECT edge_id, array_to_string(list_sort(nodes), '|') AS nodes FROM x WHERE len(nodes) >= 2"""))
def m6_merge_nodes(spark, sf):
    g = graph(spark, sf)
    mapping = g.incidence.select(F.col("node").alias("merged")).distinct().withColumn("keeper", F.lower("merged")).where("merged <> keeper")
    return g.merge_nodes(mapping).edges.select("edge_id", F.array_join(F.sort_array("all_nodes"), "|").alias("nodes"))


# sources and chunks


@q("SELECT source_path, CASE WHEN regexp_matches(lower(source_path), '\\.(py|js|jsx|ts|tsx|java|go|rs|c|cc|cpp|cxx|h|hpp|hxx|cs|rb|php|swift|kt|scala|lua|r|jl|sh|mjs|cjs)$') THEN true ELSE false END AS is_code, lower(regexp_extract(source_path, '\\.(\\w+)$', 1)) AS file_type FROM (SELECT DISTINCT source_path FROM converted_documents)")
def s4_classify_files(spark, sf):
    d = table(spark, sf, "converted_documents").select("source_path").distinct()
    ext = ing.extension(F.col("source_path"))
    return d.select("source_path", ext.isin(*ing.CODE_EXTENSIONS).alias("is_code"), ext.alias("file_type"))


@q("SELECT DISTINCT source_path FROM converted_documents WHERE NOT list_has_any(string_split(source_path, '/'), ['__pycache__','node_modules','venv','env','dist','build','target']) AND len(list_filter(string_split(source_path, '/'), lambda x: starts_with(x, '.') AND x <> '.' AND x <> '..')) = 0")
def s2_pruned_scan(spark, sf):
    return table(spark, sf, "converted_documents").select("source_path").distinct().where(~ing.skipped(F.col("source_path")))


@q("SELECT lower(regexp_extract(source_path, '\\.(\\w+)$', 1)) AS file_type, count(DISTINCT source_path) AS files FROM converted_documents WHERE lower(regexp_extract(source_path, '\\.(\\w+)$', 1)) IN ('py','md') GROUP BY 1")
def s3_extension_filter(spark, sf):
    ext = ing.extension(F.col("source_path"))
    return table(spark, sf, "converted_documents").where(ext.isin("py", "md")).groupBy(ext.alias("file_type")).agg(F.countDistinct("source_path").alias("files"))


@q("SELECT doc_id, CAST(st AS INT) AS start, substring(text, st + 1, 2000) AS text, substring(md5(doc_id || ':' || st), 1, 16) AS chunk_id FROM (SELECT doc_id, text, unnest(range(0, length(text), 1800)) AS st FROM documents WHERE length(text) > 0)")
def k4_fixed_windows(spark, sf):
    return ing.fixed_windows(table(spark, sf, "documents"), "doc_id", "text")


@q()
def k3_markdown_sections(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return ing.markdown_sections(d, "doc_id", "text")


@q()
def k2_python_chunks(spark, sf):
    import pandas as pd

    _, newest = _versions(spark, sf)

    def run(frames):
        for f in frames:
            rows = [(p, *c) for p, t in zip(f["source_path"], f["markdown"]) for c in ing.python_chunks(t or "")]
            yield pd.DataFrame(rows, columns=["source_path", "symbol", "kind", "start_line", "end_line"])

    return newest.where("source_path like '%.py'").mapInPandas(run, "source_path string, symbol string, kind string, start_line int, end_line int").distinct()


@q()
def x3_extract_python(spark, sf):
    _, newest = _versions(spark, sf)
    return ing.extract_python(newest).drop("loaded_at", "all_nodes").withColumns({"sources": F.array_join("sources", "|"), "targets": F.array_join("targets", "|")})


_NEWEST = "nw AS (SELECT source_path, markdown FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY converted_at DESC, loaded_at DESC, md5(markdown) DESC) AS rn FROM converted_documents) WHERE rn = 1)"


@q(rf"""WITH {_NEWEST}, p AS (SELECT source_path, list_concat(regexp_extract_all(markdown, '(?m)\b(?:def|function|func|fn)\s+(\w+)', 1), regexp_extract_all(markdown, '(?m)\b(?:class|struct|interface|trait)\s+(\w+)', 1)) AS d, regexp_extract_all(markdown, '(?m)^\s*(?:import|from|use|require)\s+([\w.:/]+)', 1) AS m FROM nw WHERE source_path NOT LIKE '%.py' AND markdown IS NOT NULL),
x AS (SELECT source_path, 'DEFINES' AS edge_type, d AS l FROM p UNION ALL SELECT source_path, 'IMPORTS', m FROM p) SELECT source_path, edge_type, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS targets FROM x WHERE len(l) > 0""")
def x18_extract_by_pattern(spark, sf):
    _, newest = _versions(spark, sf)
    return ing.extract_by_pattern(newest.where("source_path not like '%.py'")).withColumn("targets", F.array_join("targets", "|"))


@q(base(""", c AS (SELECT DISTINCT source_path, chunk_id AS chunk, coalesce(least(start_line, end_line), 1) AS lo, coalesce(greatest(start_line, end_line), 999999) AS hi FROM chunks WHERE chunk_id IS NOT NULL),
x AS (SELECT edge_id, chunk, coalesce(line, 0) > 0 AND coalesce(line, 0) BETWEEN lo AND hi AS ok, lo, hi FROM e JOIN c ON path = source_path AND path <> '')
SELECT edge_id, chunk AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok THEN hi - lo ELSE 0 END, lo, chunk) AS r FROM x) WHERE r = 1"""))
def x16_associate_chunks(spark, sf):
    return ing.associate_chunks(graph(spark, sf).edges, table(spark, sf, "chunks").where("chunk_id is not null"))


@q()
def x4_extract_braced(spark, sf):
    from .sources.extract import extract_braced

    _, newest = _versions(spark, sf)
    return extract_braced(newest).drop("loaded_at", "all_nodes").withColumns({"sources": F.array_join("sources", "|"), "targets": F.array_join("targets", "|")})


@q()
def k1_chunk_documents(spark, sf):
    _, newest = _versions(spark, sf)
    return ing.chunk_documents(newest)


# projections and look-ups


@q(base(f", x AS (SELECT edge_id FROM i WHERE node = '{NODE}') SELECT edge_id, edge_type, path AS source_path FROM e WHERE edge_id IN (SELECT edge_id FROM x)"))
def proj_incident_edges(spark, sf):
    return graph(spark, sf).edges.where(F.array_contains("all_nodes", NODE)).select("edge_id", "edge_type", "source_path")


@q(base("SELECT edge_id, relation, edge_type FROM e WHERE edge_id = (SELECT min(edge_id) FROM e)"))
def proj_edge_by_id(spark, sf):
    g = graph(spark, sf)
    first = g.edges.agg(F.min("edge_id").alias("edge_id"))
    return g.edges.join(F.broadcast(first), "edge_id").select("edge_id", "relation", "edge_type")  # one row


@q(base("SELECT DISTINCT node FROM i"))
def proj_all_nodes(spark, sf):
    return graph(spark, sf).incidence.select("node").distinct()


@q(base("SELECT edge_id, edge_type FROM e WHERE edge_type IN ('INHERITS', 'RAISES')"))
def proj_by_type(spark, sf):
    return graph(spark, sf).edges.where(F.col("edge_type").isin("INHERITS", "RAISES")).select("edge_id", "edge_type")


@q(base("SELECT * FROM (SELECT node, degree FROM d ORDER BY node LIMIT 100)"))
def proj_list_nodes(spark, sf):
    return graph(spark, sf).degrees().orderBy("node").limit(100).orderBy(F.desc("degree"), "node")


@q(base("SELECT edge_id, seq FROM e WHERE edge_type = 'CALLS' ORDER BY seq, edge_id LIMIT 100"))
def proj_list_edges(spark, sf):
    return graph(spark, sf).edges.where("edge_type = 'CALLS'").select("edge_id", "seq").orderBy("seq", "edge_id").limit(100)


@q(r"""WITH p AS (SELECT DISTINCT source_path AS path FROM converted_documents), l AS (SELECT path, lower(replace(path, '\', '/')) AS low FROM p), x AS (SELECT *, string_split(low, '/') AS parts FROM l)
SELECT path, regexp_matches(path, '(?i)[\\/](tests?|conftest|benchmarks|asv_benchmarks|examples)[\\/]|[\\/]test_[^\\/]*\.py$|_test\.py$') AS by_pattern,
 len(list_filter(parts, lambda v: v IN ('tests','test') OR starts_with(v, 'test_'))) > 0 OR ends_with(parts[-1], '_test.py') OR parts[-1] IN ('conftest.py','testing.py') AS by_segment,
 len(list_filter(parts, lambda v: v IN ('tests','test','testing','conftest.py') OR starts_with(v, 'test_') OR ends_with(v, '_test') OR ends_with(v, '_test.py'))) > 0 AS by_probe FROM x""")
def proj_is_test(spark, sf):
    p = table(spark, sf, "converted_documents").select(F.col("source_path").alias("path")).distinct()
    c = F.col("path")
    return p.select("path", tx.is_test_regex(c).alias("by_pattern"), tx.is_test_segment(c).alias("by_segment"), tx.is_test_probe(c).alias("by_probe"))


@q(base(""", own AS (SELECT edge_id FROM i WHERE node = 'operator new'), near AS (SELECT DISTINCT b.edge_id FROM own JOIN i x USING (edge_id) JOIN i b ON x.node = b.node WHERE x.node NOT IN (SELECT node FROM hub) AND b.edge_id NOT IN (SELECT edge_id FROM own))
SELECT edge_id, 'incident' AS how FROM own UNION ALL SELECT edge_id, 'adjacent' FROM near"""))
def proj_neighbours(spark, sf):
    g = graph(spark, sf)
    inc = g.incidence.select("edge_id", "node")
    own = inc.where("node = 'operator new'").select("edge_id")
    over = inc.join(own, "edge_id", "left_semi").select("node").distinct().join(g.hubs().select("node"), "node", "left_anti")
    near = inc.join(over, "node", "left_semi").select("edge_id").distinct().join(own, "edge_id", "left_anti")
    return own.withColumn("how", F.lit("incident")).unionByName(near.withColumn("how", F.lit("adjacent")))


_LABELS = rt.LABELS


@q(base(", l AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in _LABELS.items()) + ") AS v(edge_type, fwd, rev)) SELECT edge_id, coalesce(fwd, 'related to') AS forward, coalesce(rev, 'related to') AS reverse FROM e LEFT JOIN l USING (edge_type)"))
def proj_labels(spark, sf):
    dim = spark.createDataFrame([(k, *v) for k, v in _LABELS.items()], "edge_type string, fwd string, rev string")  # one row a type
    e = graph(spark, sf).edges.join(F.broadcast(dim), "edge_type", "left")
    return e.select("edge_id", F.coalesce("fwd", F.lit("related to")).alias("forward"), F.coalesce("rev", F.lit("related to")).alias("reverse"))


# joins


@q(base(", x AS (SELECT edge_id, node FROM i WHERE node NOT IN (SELECT node FROM hub)) SELECT p.edge_id AS a, r.edge_id AS b, count(*) AS shared FROM x p JOIN x r ON p.node = r.node AND p.edge_id < r.edge_id GROUP BY 1, 2 HAVING count(*) >= 2"))
def join_adjacency(spark, sf):
    return graph(spark, sf).adjacency(2)


@q(base(", m AS (SELECT min(edge_id) AS id FROM e WHERE edge_type = 'CALLS'), o AS (SELECT node FROM i, m WHERE edge_id = id) SELECT edge_id, string_agg(node, '|' ORDER BY node) AS shared_nodes, count(*) AS shared FROM i WHERE node IN (SELECT node FROM o) AND edge_id <> (SELECT id FROM m) GROUP BY edge_id"))
def join_adjacent_to(spark, sf):
    g = graph(spark, sf)
    return g.adjacent_to(g.edges.where("edge_type = 'CALLS'").agg(F.min("edge_id")).head()[0])


@q(base(", x AS (SELECT min(edge_id) AS lo, max(edge_id) AS hi, node FROM i GROUP BY node HAVING count(*) = 2) SELECT lo, hi, string_agg(node, '|' ORDER BY node) AS nodes FROM x GROUP BY lo, hi"))
def join_pair_intersection(spark, sf):
    """Pairs of edges that alone share a node, and these nodes."""
    x = graph(spark, sf).incidence.groupBy("node").agg(F.min("edge_id").alias("lo"), F.max("edge_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("n = 2")
    return x.groupBy("lo", "hi").agg(F.array_join(F.sort_array(F.collect_set("node")), "|").alias("nodes"))


@q(base(", r AS (SELECT DISTINCT edge_id FROM i WHERE node = 'operator new'), p AS (SELECT DISTINCT x.edge_id AS a, y.edge_id AS b FROM i x JOIN i y ON x.node = y.node AND x.edge_id < y.edge_id WHERE x.edge_id IN (SELECT * FROM r) AND y.edge_id IN (SELECT * FROM r)), c AS (SELECT (SELECT count(*) FROM r) AS n_edges, (SELECT count(*) FROM p) AS n_pairs) SELECT *, CASE WHEN n_edges < 2 THEN 0.0::DOUBLE ELSE round(n_pairs / (n_edges * (n_edges - 1) / 2), 4) END AS density FROM c"))
def join_density(spark, sf):
    g = graph(spark, sf)
    return rt.density(g, g.incidence.where("node = 'operator new'").select("edge_id").distinct())


@q(base("SELECT edge_type, src, dst, count(*) AS n FROM a GROUP BY ALL"))
def join_cross_expansion(spark, sf):
    return graph(spark, sf).arcs.groupBy("edge_type", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@q(base("SELECT DISTINCT edge_id FROM i WHERE node IN (SELECT node FROM hub)"))
def join_semi(spark, sf):
    g = graph(spark, sf)
    return g.incidence.join(g.hubs(), "node", "left_semi").select("edge_id").distinct()


@q(base("SELECT node, degree FROM d WHERE node NOT IN (SELECT node FROM hub)"))
def join_anti(spark, sf):
    g = graph(spark, sf)
    return g.degrees().join(g.hubs().select("node"), "node", "left_anti")


@q(base(", s AS (SELECT * FROM (VALUES ('registry'), ('Optional'), ('storage.page_cache'), ('flush')) AS v(seed)) SELECT DISTINCT seed, node FROM d JOIN s ON node = seed OR starts_with(node, seed || '.') OR ends_with(node, '.' || seed) OR node = string_split(seed, '.')[-1]"))
def join_suffix(spark, sf):
    """Seeds meet nodes by any dotted prefix or suffix, as an equi-join over the few cuts of each name."""
    seeds = spark.createDataFrame([("registry",), ("Optional",), ("storage.page_cache",), ("flush",)], "seed string")
    cuts = F.expr("transform(sequence(1, size(p)), k -> array_join(slice(p, 1, k), '.'))")
    tails = F.expr("transform(sequence(1, size(p)), k -> array_join(slice(p, size(p) - k + 1, k), '.'))")
    n = graph(spark, sf).degrees().select("node", F.split("node", r"\.").alias("p")).select("node", F.explode(F.array_distinct(F.concat(cuts, tails))).alias("key"))
    last = seeds.select("seed", tx.last_segment(F.col("seed")).alias("node"))
    return n.join(F.broadcast(seeds), F.col("key") == F.col("seed")).select("seed", "node").unionByName(graph(spark, sf).degrees().join(F.broadcast(last), "node").select("seed", "node")).distinct()


@q(base("SELECT lower(node) AS low, arg_max(node, (degree, node)) AS node FROM d GROUP BY 1"))
def join_name_index(spark, sf):
    return graph(spark, sf).name_index()


@q("SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4")
def join_cosine_pairs(spark, sf):
    return rt.similar_pairs(table(spark, sf, "embeddings"), 0.4)


@q(base(", r AS (SELECT unnest(t) AS node, 0 AS k, seq, path FROM e WHERE edge_type = 'DEFINES' UNION ALL SELECT unnest(s), 1, seq, path FROM e WHERE edge_type = 'DEFINES' UNION ALL SELECT node, 2, seq, path FROM i) SELECT node, arg_min(path, (k, seq, path)) AS source_path FROM r GROUP BY node"))
def join_symbol_file(spark, sf):
    return tv.first_files(graph(spark, sf))


# aggregates


@q(base("SELECT node, degree FROM d"))
def agg_degree(spark, sf):
    return graph(spark, sf).degrees()


@q(base("SELECT node, degree, round(ln(1 + n / degree), 4) AS idf FROM d, n"))
def agg_idf(spark, sf):
    return graph(spark, sf).idf()


@q(base("SELECT node, degree FROM d WHERE node IN (SELECT node FROM hub)"))
def agg_hubs(spark, sf):
    return graph(spark, sf).hubs()


@q(base(", x AS (SELECT node, count(*) AS degree FROM i WHERE edge_type IN ('CALLS', 'RAISES') GROUP BY 1), m AS (SELECT count(*) AS n FROM e WHERE edge_type IN ('CALLS', 'RAISES')) SELECT node, degree FROM x, m WHERE degree > least(greatest(2, CAST(floor(n * 0.03::DOUBLE) AS INT)), 50)"))
def agg_hubs_by_type(spark, sf):
    return graph(spark, sf).hubs(["CALLS", "RAISES"])


@q(base("SELECT count(*) AS edges, round(avg(len(nodes)), 4) AS avg_size, CAST(max(len(nodes)) AS INT) AS max_size, CAST(min(len(nodes)) AS INT) AS min_size, count(DISTINCT nullif(chunk_id, '')) AS chunks, (SELECT count(*) FROM d) AS nodes FROM e"))
def agg_stats(spark, sf):
    return graph(spark, sf).stats()


@q(base("SELECT path AS source_path, count(*) AS edges, count(DISTINCT edge_type) AS types FROM e GROUP BY 1"))
def agg_overview_files(spark, sf):
    return graph(spark, sf).edges.groupBy("source_path").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("edge_type").alias("types"))


@q(base(r""", x AS (SELECT i.node, count(*) AS degree FROM i WHERE NOT regexp_matches(path, '(?i)[\\/](tests?|conftest|benchmarks|asv_benchmarks|examples)[\\/]|[\\/]test_[^\\/]*\.py$|_test\.py$') GROUP BY 1) SELECT node, degree FROM x ORDER BY degree DESC, node LIMIT 10"""))
def agg_overview_no_tests(spark, sf):
    i = graph(spark, sf).incidence.where(~tx.is_test_regex(F.col("source_path")))
    return i.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(10)


@q(base("SELECT dst AS base, count(DISTINCT src) AS children, string_agg(DISTINCT src, '|' ORDER BY src) AS names FROM a WHERE edge_type = 'INHERITS' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def agg_inheritance_trees(spark, sf):
    a = graph(spark, sf).arcs.where("edge_type = 'INHERITS'").select("src", "dst").distinct()
    top = a.groupBy("dst").agg(F.count(F.lit(1)).alias("children")).orderBy(F.desc("children"), "dst").limit(10)
    named = a.join(F.broadcast(top), "dst").groupBy(F.col("dst").alias("base"), "children")  # ten rows
    return named.agg(F.array_join(F.sort_array(F.collect_set("src")), "|").alias("names"))


@q(base(", x AS (SELECT path, dst, min(seq) AS mn FROM a WHERE edge_type = 'DEFINES' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mn, dst) AS k, count(*) OVER (PARTITION BY path) AS n FROM x) SELECT path AS source_path, string_agg(string_split(dst, '.')[-1], ', ' ORDER BY k) || CASE WHEN max(n) > 5 THEN ' (+' || (max(n) - 5) || ' more)' ELSE '' END AS description FROM r WHERE k <= 5 GROUP BY 1"))
def agg_module_descriptions(spark, sf):
    x = graph(spark, sf).arcs.where("edge_type = 'DEFINES'").groupBy("source_path", "dst").agg(F.min("seq").alias("at"))
    rows = x.withColumn("k", F.row_number().over(Window.partitionBy("source_path").orderBy("at", "dst")))
    per = rows.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", tx.last_segment(F.col("dst")).alias("s"))))).alias("x"))
    more = F.when(F.col("n") > 5, F.concat(F.lit(" (+"), (F.col("n") - 5).cast("string"), F.lit(" more)"))).otherwise("")
    return per.select("source_path", F.concat(F.array_join(F.transform("x", lambda v: v["s"]), ", "), more).alias("description"))


@q(base(", c AS (SELECT src, dst, min(seq) AS mn FROM a WHERE edge_type = 'CALLS' GROUP BY 1, 2) SELECT src, string_agg(dst, '|' ORDER BY mn, dst) AS callees FROM c GROUP BY 1"))
def agg_call_adjacency(spark, sf):
    return tv.call_adjacency(graph(spark, sf))


@q(base(", x AS (SELECT src AS node, edge_type FROM a UNION ALL SELECT dst, edge_type FROM a), p AS (SELECT node, count(*) AS degree, count(*) FILTER (edge_type = 'CALLS') AS calls, count(*) FILTER (edge_type = 'INHERITS') AS inherits FROM x GROUP BY 1) SELECT *, 2 * (calls + inherits) + degree AS importance FROM p"))
def agg_importance(spark, sf):
    return tv.pairwise(graph(spark, sf))


@q("SELECT coalesce(retrieval_source, '') AS source, count(*) AS n, count(score) AS scored FROM scored_edges GROUP BY 1")
def agg_source_breakdown(spark, sf):
    return table(spark, sf, "scored_edges").groupBy(F.coalesce("retrieval_source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"))


def _some_retrieved(spark, sf):
    return table(spark, sf, "scored_edges").where("score >= 0.9").select("edge_id").distinct()


@q(base(", r AS (SELECT DISTINCT edge_id FROM scored_edges WHERE score >= 0.9), h AS (SELECT DISTINCT node FROM i WHERE edge_id IN (SELECT edge_id FROM r)), s AS (SELECT node FROM d ORDER BY degree DESC, node LIMIT 200) SELECT node, node IN (SELECT node FROM h) AS covered FROM s"))
def agg_coverage(spark, sf):
    g = graph(spark, sf)
    seeds = g.degrees().orderBy(F.desc("degree"), "node").limit(200)
    return rt.coverage(g, _some_retrieved(spark, sf), seeds)[0]


@q(base(", r AS (SELECT DISTINCT edge_id FROM scored_edges WHERE score >= 0.9), h AS (SELECT DISTINCT node FROM i WHERE edge_id IN (SELECT edge_id FROM r)), nr AS (SELECT DISTINCT edge_id FROM i WHERE node IN (SELECT node FROM h)) SELECT node, degree FROM d WHERE node IN (SELECT node FROM i WHERE edge_id IN (SELECT edge_id FROM nr)) AND node NOT IN (SELECT node FROM h) ORDER BY degree DESC, node LIMIT 20"))
def agg_frontier(spark, sf):
    g = graph(spark, sf)
    return rt.coverage(g, _some_retrieved(spark, sf), words(spark, NODE))[1]


# ranking


@q(base("SELECT node, degree FROM d WHERE node NOT IN (SELECT node FROM hub) ORDER BY degree DESC, node LIMIT 20"))
def w2_top_symbols(spark, sf):
    """The most connected nodes that are no hubs."""
    g = graph(spark, sf)
    return g.degrees().join(g.hubs().select("node"), "node", "left_anti").orderBy(F.desc("degree"), "node").limit(20)


@q("WITH x AS (SELECT DISTINCT * EXCLUDE (matched_nodes) FROM scored_edges WHERE score IS NOT NULL), r AS (SELECT query, edge_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, result_id) AS place FROM x) SELECT query, edge_id, score, CAST(place AS INT) AS place FROM r WHERE place <= 3")
def w1_top_edges_per_query(spark, sf):
    x = table(spark, sf, "scored_edges").where("score is not null").drop("matched_nodes").distinct()
    w = Window.partitionBy("query").orderBy(F.desc("score"), "result_id")
    return x.withColumn("place", F.row_number().over(w)).where("place <= 3").select("query", "edge_id", "score", "place")


@q("SELECT result_id, min(scored_at) AS scored_at FROM scored_edges GROUP BY 1")
def w3_first_wins(spark, sf):
    return table(spark, sf, "scored_edges").groupBy("result_id").agg(F.min("scored_at").alias("scored_at"))


# sets


@q(f"SELECT DISTINCT edge_id, seq, array_to_string(list_sort(list_distinct(list_concat({_clean('sources')}, {_clean('targets')}))), '|') AS both, array_to_string(list_sort(list_distinct(list_filter({_clean('sources')}, lambda x: list_contains({_clean('targets')}, x)))), '|') AS shared, array_to_string(list_sort(list_distinct(list_filter({_clean('sources')}, lambda x: NOT list_contains({_clean('targets')}, x)))), '|') AS only_sources FROM hyperedges")
def u_node_sets(spark, sf):
    s, t = clean_nodes(F.col("sources")), clean_nodes(F.col("targets"))
    j = lambda c: F.array_join(F.sort_array(c), "|")
    return table(spark, sf, "hyperedges").select("edge_id", "seq", j(F.array_union(s, t)).alias("both"), j(F.array_intersect(s, t)).alias("shared"), j(F.array_except(s, t)).alias("only_sources")).distinct()


@q("SELECT source_path FROM converted_documents INTERSECT SELECT source_path FROM hyperedges")
def u_path_intersection(spark, sf):
    return table(spark, sf, "converted_documents").select("source_path").intersect(table(spark, sf, "hyperedges").select("source_path"))


@q("SELECT source_path FROM converted_documents EXCEPT SELECT source_path FROM chunks")
def u_path_difference(spark, sf):
    return table(spark, sf, "converted_documents").select("source_path").subtract(table(spark, sf, "chunks").select("source_path"))


# traversal

_SEEDS_SQL = "(" + ", ".join(f"'{x}'" for x in SEEDS) + ")"


def _bfs_sql(direction: str) -> str:
    ok1, ok2 = {"forward": ("list_contains(s, node)", "list_contains(s, node)"), "backward": ("list_contains(t, node)", "list_contains(t, node)"), "both": ("true", "true")}[direction]
    return base(f""", c1 AS (SELECT edge_id, min(node) AS node FROM i WHERE node IN {_SEEDS_SQL} GROUP BY 1), l1 AS (SELECT c1.*, e.s, e.t FROM c1 JOIN e USING (edge_id)), p1 AS (SELECT * FROM l1 WHERE {ok1}),
f2 AS (SELECT DISTINCT x AS node FROM (SELECT unnest(CASE WHEN list_contains(s, node) THEN t ELSE s END) AS x FROM p1) WHERE x NOT IN {_SEEDS_SQL} AND x NOT IN (SELECT node FROM hub)),
c2 AS (SELECT edge_id, min(node) AS node FROM i WHERE node IN (SELECT node FROM f2) AND edge_id NOT IN (SELECT edge_id FROM l1) GROUP BY 1), l2 AS (SELECT c2.*, e.s, e.t FROM c2 JOIN e USING (edge_id)), p2 AS (SELECT * FROM l2 WHERE {ok2})
SELECT edge_id, node, 1 AS level FROM p1 UNION ALL SELECT edge_id, node, 2 FROM p2""")


@q(_bfs_sql("forward"))
def g1_bfs_forward(spark, sf):
    g = graph(spark, sf)
    return tv.bfs(g, words(spark, *SEEDS), 2, "forward", hubs=g.hubs())


@q(_bfs_sql("backward"))
def g1_bfs_backward(spark, sf):
    g = graph(spark, sf)
    return tv.bfs(g, words(spark, *SEEDS), 2, "backward", hubs=g.hubs())


@q(_bfs_sql("both"))
def g1_bfs_both(spark, sf):
    g = graph(spark, sf)
    return tv.bfs(g, words(spark, *SEEDS), 2, "both", hubs=g.hubs())


@q(base(""", m AS (SELECT DISTINCT edge_id, unnest(list_concat(s, t)) AS node FROM e WHERE edge_type IN ('CALLS', 'INHERITS')), h0 AS (SELECT DISTINCT node FROM m WHERE node = 'operator new'),
h1 AS (SELECT DISTINCT node FROM m WHERE edge_id IN (SELECT edge_id FROM m WHERE node IN (SELECT node FROM h0)) AND node NOT IN (SELECT node FROM h0)),
h2 AS (SELECT DISTINCT node FROM m WHERE edge_id IN (SELECT edge_id FROM m WHERE node IN (SELECT node FROM h1)) AND node NOT IN (SELECT node FROM h0) AND node NOT IN (SELECT node FROM h1))
SELECT node, 0 AS hops FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2"""))
def g3_hop_distances(spark, sf):
    return tv.hop_distances(graph(spark, sf), words(spark, "operator new"), ["CALLS", "INHERITS"], 2)


@q(base("SELECT edge_id AS path, 1 AS length FROM e WHERE list_contains(nodes, 'str') AND list_contains(nodes, 'Optional') ORDER BY edge_id LIMIT 3"))
def g4_direct_paths(spark, sf):
    return tv.find_paths(graph(spark, sf), "str", "Optional")


@q()
def g4_paths(spark, sf):
    return tv.find_paths(graph(spark, sf), "operator new", "Optional")


@q(base(", k AS (SELECT DISTINCT src, dst FROM a WHERE edge_type = 'DEFINES') SELECT k.src AS owner, k.dst AS member, count(DISTINCT i.edge_id) AS edges FROM k JOIN i ON i.node = k.dst GROUP BY 1, 2"))
def g8_class_expansion(spark, sf):
    g = graph(spark, sf)
    k = g.arcs.where("edge_type = 'DEFINES'").select(F.col("src").alias("owner"), F.col("dst").alias("member")).distinct()
    return k.join(g.degrees(), F.col("member") == F.col("node")).select("owner", "member", F.col("degree").alias("edges"))


@q(base(f"SELECT DISTINCT CASE WHEN src = '{NODE}' THEN dst ELSE src END AS node FROM a WHERE edge_type <> 'DEFINES' AND (src = '{NODE}' OR dst = '{NODE}')"))
def g9_one_hop(spark, sf):
    a = graph(spark, sf).arcs.where(f"edge_type <> 'DEFINES' and (src = '{NODE}' or dst = '{NODE}')")
    return a.select(F.when(F.col("src") == NODE, F.col("dst")).otherwise(F.col("src")).alias("node")).distinct()


# retrieval


@q(base(", m AS (SELECT node FROM d WHERE lower(node) = 'resolve' OR list_last(string_split(lower(node), '.')) = 'resolve') SELECT path AS source_path, min(CASE WHEN edge_type IN ('DEFINES', 'CALLS') THEN 1 ELSE 2 END) AS priority FROM i WHERE node IN (SELECT node FROM m) AND path <> '' GROUP BY 1"))
def r1_lookup_files(spark, sf):
    g = graph(spark, sf)
    return rt.lookup(g, rt.match_names(g, "resolve", ["resolve"]))[0]


@q(base(", m AS (SELECT node FROM d WHERE lower(node) = 'resolve' OR list_last(string_split(lower(node), '.')) = 'resolve') SELECT edge_id, min(node) AS node, any_value(edge_type) AS edge_type, any_value(path) AS source_path FROM i WHERE node IN (SELECT node FROM m) GROUP BY 1"))
def r1_lookup_symbols(spark, sf):
    g = graph(spark, sf)
    x = rt.lookup(g, rt.match_names(g, "resolve", ["resolve"]))[1]
    return x.groupBy("edge_id").agg(F.min("node").alias("node"), F.first("edge_type").alias("edge_type"), F.first("source_path").alias("source_path"))


@q(base(", x AS (SELECT node, string_split(lower(node), '.')[-1] AS token, degree, degree / n AS r FROM d, n) SELECT node, degree, round((CASE WHEN r > 0.05 THEN 0.1::DOUBLE WHEN r > 0.02 THEN 0.3 WHEN r > 0.005 THEN 0.6 ELSE 1.0 END) * (CASE WHEN length(token) <= 3 AND r > 0.005 THEN 0.4::DOUBLE WHEN length(token) <= 3 AND r > 0.002 THEN 0.7 ELSE 1.0 END) * (CASE WHEN len(string_split(node, '.')) >= 3 THEN 1.3::DOUBLE WHEN len(string_split(node, '.')) = 2 THEN 1.1 ELSE 1.0 END), 4) AS specificity FROM x"))
def r3_specificity(spark, sf):
    g = graph(spark, sf)
    n = g.count()
    token = tx.last_segment(F.lower("node"))
    return g.degrees().select("node", "degree", F.round(specificity(F.col("degree"), F.lit(float(n)), token, F.col("node")), 4).alias("specificity"))


_TERMS = ("cache", "registry")


def _best(low: str, stem: str) -> str:
    return "least(" + ", ".join(f"CASE WHEN {stem} = '{t}' THEN 1 WHEN starts_with({low}, '{t}') THEN 2 WHEN contains({low}, '{t}') THEN 3 ELSE 99 END" for t in _TERMS) + ")"


_PATH_BEST = "least(" + ", ".join(f"CASE WHEN lower(regexp_replace(list_last(string_split(path, '/')), '(.)\\.[^.]*$', '\\1')) = '{t}' THEN 1 WHEN contains(lower(path), '{t}') THEN 6 ELSE 99 END" for t in _TERMS) + ")"


@q(base(f", x AS (SELECT node AS entry, 'node' AS kind, {_best('lower(node)', 'list_last(string_split(lower(node), chr(46)))')} AS quality FROM d UNION ALL SELECT path, 'path', {_PATH_BEST} FROM (SELECT DISTINCT path FROM e WHERE path <> '')) SELECT * FROM x WHERE quality < 99 ORDER BY quality, kind, entry LIMIT 20"))
def r4_text_search(spark, sf):
    return rt.text_search(graph(spark, sf), _TERMS)


@q(base(""", f AS (SELECT DISTINCT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM e WHERE path <> ''), g AS (SELECT CASE WHEN dir = '' THEN '.' ELSE dir END AS dir, path FROM f), c AS (SELECT dir, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 3)
SELECT dir || '/' AS source_path, CASE WHEN contains(lower(dir), 'core') AND n >= 5 THEN 1 WHEN contains(lower(dir), 'core') OR n >= 7 THEN 2 ELSE 3 END AS priority, n FROM c UNION ALL SELECT path, 2, 1 FROM g WHERE dir NOT IN (SELECT dir FROM c)"""))
def r7_collapse(spark, sf):
    files = graph(spark, sf).edges.where("source_path <> ''").select("source_path").distinct().withColumn("priority", F.lit(2))
    return rt.collapse_directories(files, ["core"])


_QUERY_TOKENS = r"""string_split_regex(query, '[\s,;:!?(){}\[\]"''`/\\]+')"""


@q(f"""WITH w AS (SELECT DISTINCT query, unnest({_QUERY_TOKENS}) AS w FROM scored_edges WHERE query IS NOT NULL), p AS (SELECT query, trim(lower(unnest(list_concat(CASE WHEN contains(w, '.') THEN [w] ELSE [] END, string_split_regex(w, '[._]'))))) AS t FROM w WHERE w <> '')
SELECT query, string_agg(DISTINCT t, '|' ORDER BY t) AS tokens FROM p WHERE length(t) >= 2 AND t NOT IN ({', '.join(f"'{x}'" for x in tx.LOOKUP_STOP)}) GROUP BY 1""")
def f1_lookup_tokens(spark, sf):
    x = table(spark, sf, "scored_edges").where("query is not null").select("query").distinct()
    return x.select("query", F.array_join(F.sort_array(tx.lookup_tokens(F.col("query"))), "|").alias("tokens")).where("tokens <> ''")


@q(f"""WITH w AS (SELECT DISTINCT query, unnest({_QUERY_TOKENS}) AS w FROM scored_edges WHERE query IS NOT NULL), p AS (SELECT query, trim(lower(unnest(list_concat(CASE WHEN contains(w, '.') THEN [w] ELSE [] END, string_split_regex(w, '[._]'))))) AS t FROM w WHERE w <> '')
SELECT query, string_agg(DISTINCT t, '|' ORDER BY t) AS tokens FROM p WHERE length(t) >= 3 AND t NOT IN ({', '.join(f"'{x}'" for x in tx.SEARCH_STOP)}) GROUP BY 1""")
def f2_search_terms(spark, sf):
    x = table(spark, sf, "scored_edges").where("query is not null").select("query").distinct()
    return x.select("query", F.array_join(F.sort_array(tx.search_terms(F.col("query"))), "|").alias("tokens")).where("tokens <> ''")


@q(f"""WITH w AS (SELECT DISTINCT query, unnest({_QUERY_TOKENS}) AS w FROM scored_edges WHERE query IS NOT NULL), p AS (SELECT query, trim(lower(unnest(string_split_regex(w, '[._]')))) AS t FROM w WHERE w <> '')
SELECT query, string_agg(DISTINCT t, '|' ORDER BY t) AS tokens FROM p WHERE length(t) >= 3 AND t NOT IN ({', '.join(f"'{x}'" for x in tx.SEARCH_STOP)}) GROUP BY 1""")
def f3_dispatch_terms(spark, sf):
    x = table(spark, sf, "scored_edges").where("query is not null").select("query").distinct()
    return x.select("query", F.array_join(F.sort_array(tx.search_terms(F.col("query"), dotted=False)), "|").alias("tokens")).where("tokens <> ''")


@q(base(", x AS (SELECT DISTINCT list_last(string_split(node, '.')) AS w FROM d) SELECT w, CASE WHEN ends_with(lower(w), 'ies') AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN (ends_with(lower(w), 'ses') OR ends_with(lower(w), 'xes') OR ends_with(lower(w), 'zes')) AND length(w) > 3 THEN left(w, length(w) - 2) WHEN ends_with(lower(w), 's') AND NOT ends_with(lower(w), 'ss') AND length(w) > 3 THEN left(w, length(w) - 1) END AS singular FROM x"))
def f6_depluralise(spark, sf):
    x = graph(spark, sf).degrees().select(tx.last_segment(F.col("node")).alias("w")).distinct()
    return x.select("w", tx.depluralise(F.col("w")).alias("singular"))


@q("SELECT DISTINCT source_path, list_last(string_split(source_path, '/')) AS name, regexp_replace(list_last(string_split(source_path, '/')), '(.)\\.[^.]*$', '\\1') AS stem, regexp_extract(source_path, '^(.*)/[^/]*$', 1) AS parent FROM converted_documents")
def f8_path_parts(spark, sf):
    c = F.col("source_path")
    return table(spark, sf, "converted_documents").select("source_path", tx.file_name(c).alias("name"), tx.path_stem(c).alias("stem"), tx.parent_dir(c).alias("parent")).distinct()


@q("SELECT source_path, converted_at, loaded_at, sha256(markdown) AS sha, substring(md5(source_path), 1, 16) AS short FROM converted_documents")
def f9_hashes(spark, sf):
    return table(spark, sf, "converted_documents").select("source_path", "converted_at", "loaded_at", F.sha2("markdown", 256).alias("sha"), tx.md5_id(F.col("source_path")).alias("short"))


@q("SELECT DISTINCT source_path, CASE WHEN p IN ('', '.') OR starts_with(p, '.') THEN CASE WHEN stem = '' THEN 'other' ELSE stem END ELSE p END AS grp, CAST(('0x' || substring(md5(source_path), 1, 8)) AS BIGINT) % 360 AS hue FROM (SELECT source_path, list_last(string_split(regexp_extract(source_path, '^(.*)/[^/]*$', 1), '/')) AS p, regexp_replace(list_last(string_split(source_path, '/')), '(.)\\.[^.]*$', '\\1') AS stem FROM converted_documents)")
def f10_groups(spark, sf):
    c = F.col("source_path")
    p, stem = tx.file_name(tx.parent_dir(c)), tx.path_stem(c)
    grp = F.when(p.isin("", ".") | p.startswith("."), F.when(stem == "", "other").otherwise(stem)).otherwise(p)
    return table(spark, sf, "converted_documents").select("source_path", grp.alias("grp"), tx.hue(c).alias("hue")).distinct()


# vectors


def _query_vector(spark, sf):
    return table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").head()[0]


@q("WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 20")
def v1_vector_top(spark, sf):
    return rt.vector_top(table(spark, sf, "embeddings"), _query_vector(spark, sf))


def _scored_nodes(g: Hypergraph) -> DataFrame:
    """Stand-in similarities: the 20 most connected nodes that are no hubs, scored by their place."""
    top = g.degrees().join(g.hubs().select("node"), "node", "left_anti").orderBy(F.desc("degree"), "node").limit(20)
    return top.select("node", (1.0 - (F.row_number().over(Window.orderBy(F.desc("degree"), "node")) - 1) * 0.03).alias("score"))  # 20 rows


_SCORED = ", t20 AS (SELECT node, degree FROM d WHERE node NOT IN (SELECT node FROM hub) ORDER BY degree DESC, node LIMIT 20), ns AS (SELECT node, 1.0::DOUBLE - (row_number() OVER (ORDER BY degree DESC, node) - 1) * 0.03::DOUBLE AS score FROM t20), sc AS (SELECT i.edge_id, avg(score) AS mean, count(*) AS matched FROM i JOIN ns USING (node) GROUP BY 1), es AS (SELECT edge_id, edge_type, mean * sqrt(matched / len(nodes)) AS wp, matched / 20 AS cov, CASE edge_type WHEN 'TEXT' THEN 0.7::DOUBLE WHEN 'SUMMARY' THEN 0.3 ELSE 1.0 END AS w FROM sc JOIN e USING (edge_id))"


@q(base(_SCORED + " SELECT edge_id, edge_type, round(wp, 4) AS weighted_precision, round(cov, 4) AS coverage, round((0.6 * wp + 0.4 * cov) * w, 4) AS score FROM es"))
def r15_edge_scores(spark, sf):
    g = graph(spark, sf)
    return rt.edge_scores(g, _scored_nodes(g), 20)


@q()
def r16_expansion(spark, sf):
    g = graph(spark, sf)
    ns = _scored_nodes(g)
    return rt.expand_scores(g, rt.edge_scores(g, ns, 20), ns)


# tours


def _tours(spark, sf):
    return to.newest_tours(table(spark, sf, "tours"))


@q("SELECT DISTINCT id, name, status, promoted FROM tours WHERE promoted AND status = 'active'")
def t1_list_tours(spark, sf):
    return to.list_tours(table(spark, sf, "tours"), promoted=True, status="active").select("id", "name", "status", "promoted").distinct()


@q("WITH x AS (SELECT DISTINCT id, tags FROM tours) SELECT tag, count(DISTINCT id) AS tours FROM (SELECT id, unnest(tags) AS tag FROM x) GROUP BY 1")
def agg_tour_tags(spark, sf):
    return table(spark, sf, "tours").select("id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.countDistinct("id").alias("tours"))


@q("WITH x AS (SELECT DISTINCT id, unnest(steps) AS s FROM tours) SELECT coalesce(s.edge_type, '') AS edge_type, count(*) AS steps, count(DISTINCT s.file) AS files FROM x GROUP BY 1")
def agg_tour_report(spark, sf):
    x = table(spark, sf, "tours").select("id", F.explode("steps").alias("s")).distinct()
    return x.groupBy(F.coalesce("s.edge_type", F.lit("")).alias("edge_type")).agg(F.count(F.lit(1)).alias("steps"), F.countDistinct("s.file").alias("files"))


@q()
def t3_append_steps(spark, sf):
    """Nodes of the best results that each promoted tour lacks; candidates come with the tour's own keywords."""
    t = table(spark, sf, "tours")
    have = t.select("id", F.explode("steps.node").alias("node"))
    new = t.where("promoted").select("id", F.posexplode("keywords").alias("pos", "node"))
    return to.append_steps(have, new)


# views


@q(base(", x AS (SELECT src AS source, dst AS target, edge_type, min(path) AS file FROM a WHERE edge_type IN ('CALLS','DEFINES','INHERITS','RAISES','DECORATES') AND src <> dst GROUP BY 1, 2, 3) SELECT * FROM x"))
def z2_view_edges(spark, sf):
    a = graph(spark, sf).arcs.where(F.col("edge_type").isin("CALLS", "DEFINES", "INHERITS", "RAISES", "DECORATES") & (F.col("src") != F.col("dst")))
    return a.groupBy(F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type").agg(F.min("source_path").alias("file"))


@q()
def r10_dispatch_files(spark, sf):
    from .plans.plan import dispatch

    return dispatch(graph(spark, sf), "what calls self.registry.resolve", depth=1).files.distinct()


__all__ = ["QUERIES", "SQL", "clean_type", "type_weight"]


# probes and drawing

_STRATEGY_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(query), '{p}') THEN '{n}' END" for n, p in __import__("weftgraph.plans.probe", fromlist=["STRATEGIES"]).STRATEGIES.items()) + "], lambda x: x IS NOT NULL)"


@q(f"SELECT DISTINCT query, CASE WHEN len({_STRATEGY_SQL}) = 0 THEN 'exploration' ELSE array_to_string({_STRATEGY_SQL}, '|') END AS strategies FROM scored_edges WHERE query IS NOT NULL")
def f14_strategies(spark, sf):
    from .plans.probe import strategies

    x = table(spark, sf, "scored_edges").where("query is not null").select("query").distinct()
    return x.select("query", F.array_join(strategies(F.col("query")), "|").alias("strategies"))


@q("SELECT DISTINCT id, CASE WHEN list_contains(tags, 'llm-authored') THEN 'LLM-authored' WHEN len(list_filter(steps, lambda s: contains(coalesce(s.text, ''), '[text match]'))) > 0 THEN 'text-search' WHEN len(list_filter(steps, lambda s: coalesce(s.edge_type, '') <> '')) > 0 THEN 'auto-scaffolded' ELSE 'LLM-authored' END AS origin FROM tours")
def f15_tour_origin(spark, sf):
    from .plans.probe import tour_origin

    return table(spark, sf, "tours").select("id", tour_origin(F.col("tags"), F.col("steps")).alias("origin")).distinct()


_LANGUAGE_SQL = "CASE lower(regexp_extract(source_path, '\\.(\\w+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' ELSE 'other' END"


@q(f"SELECT {_LANGUAGE_SQL} AS language, count(DISTINCT source_path) AS files FROM converted_documents GROUP BY 1")
def f12_languages(spark, sf):
    from .operators.views import language

    return table(spark, sf, "converted_documents").groupBy(language(F.col("source_path")).alias("language")).agg(F.countDistinct("source_path").alias("files"))


@q()
def z1_tour_subgraph(spark, sf):
    """What lies within one hop of the nodes tied to the tours' steps and keywords."""
    from .operators.views import expand_seeds, subgraph

    t = table(spark, sf, "tours")
    seeds = t.select(F.explode(F.concat("steps.node", "keywords")).alias("node")).select(normalise_node(F.col("node")).alias("node")).where("node <> ''").distinct()
    g = graph(spark, sf)
    return subgraph(g, expand_seeds(g, seeds), ["CALLS", "INHERITS", "DEFINES"], 1)[0]


@q()
def v4_merge_map(spark, sf):
    """Vectors alike by 0.4 or more (no pair of the test vectors reaches the usual 0.97)."""
    from .operators.simplify import merge_map

    v = table(spark, sf, "embeddings")
    return merge_map(rt.similar_pairs(v, 0.4), v.select(F.col("vec_id").alias("node"), F.lit(0).alias("degree")))


@q()
def t9_blast_radius(spark, sf):
    from .plans.probe import blast_radius

    return blast_radius(graph(spark, sf), "operator new", 1)


@q()
def t10_probe(spark, sf):
    from .plans.probe import probe

    return probe(graph(spark, sf), "what calls cursor.execute", 1)


@q(r"""WITH w AS (SELECT DISTINCT query, unnest(string_split_regex(query, '[\s.,;:!?(){}\[\]"''`/\\]+')) AS w FROM scored_edges WHERE query IS NOT NULL), p AS (SELECT query, trim(lower(unnest(string_split(w, '_')))) AS t FROM w WHERE w <> '')
SELECT query, string_agg(DISTINCT t, '|' ORDER BY t) AS tokens FROM p WHERE length(t) >= 3 AND t NOT IN (""" + ", ".join(f"'{x}'" for x in tx.KEYWORD_STOP) + ") GROUP BY 1")
def f4_keyword_terms(spark, sf):
    x = table(spark, sf, "scored_edges").where("query is not null").select("query").distinct()
    return x.select("query", F.array_join(F.sort_array(tx.keyword_terms(F.col("query"))), "|").alias("tokens")).where("tokens <> ''")


@q(base(""", m AS (SELECT DISTINCT edge_id, unnest(list_concat(s, t)) AS node FROM e WHERE edge_type IN ('CALLS', 'INHERITS')), h0 AS (SELECT DISTINCT node FROM m WHERE node = 'operator new'),
h1 AS (SELECT DISTINCT node FROM m WHERE edge_id IN (SELECT edge_id FROM m WHERE node IN (SELECT node FROM h0))), h2 AS (SELECT DISTINCT node FROM m WHERE edge_id IN (SELECT edge_id FROM m WHERE node IN (SELECT node FROM h1)))
SELECT (SELECT count(*) FROM h0) AS at_seed, (SELECT count(*) FROM h2) - (SELECT count(*) FROM h0) AS near, (SELECT count(*) FROM d) - (SELECT count(*) FROM h2) AS far"""))
def agg_fog_counts(spark, sf):
    """Nodes at a seed, within two hops, and farther or out of reach."""
    g = graph(spark, sf)
    hops = tv.hop_distances(g, words(spark, "operator new"), ["CALLS", "INHERITS"], 2)
    h = g.degrees().select("node").join(hops, "node", "left")
    return h.agg(F.count_if(F.col("hops") == 0).alias("at_seed"), F.count_if(F.col("hops").between(1, 2)).alias("near"), F.count_if(F.col("hops").isNull()).alias("far"))


@q()
def g7_call_chains(spark, sf):
    return tv.call_chains(graph(spark, sf))
