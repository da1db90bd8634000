"""Core queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import QUERIES as CATALOG
from .catalog import SQL
from . import catalog_more  # noqa: F401  registers its queries
from .functions.names import clean_nodes
from .operators.hierarchy import descendants, inherits_links, resolve_hierarchy
from .operators.numbering import chunked_key_stats, with_distinct
from .runtime import table

HEAVY = 0.05


def key_rows(edges: DataFrame, *extra: str) -> DataFrame:
    """(field, key_value, …): a row per stored source_path that is not NULL or '', and one per distinct normalised target name of a row."""
    names = F.transform(F.array_distinct(clean_nodes(F.col("targets"))), lambda x: F.struct(F.lit("targets").alias("field"), x.alias("key_value")))
    path = F.when(F.coalesce("source_path", F.lit("")) != "", F.array(F.struct(F.lit("source_path").alias("field"), F.col("source_path").alias("key_value"))))
    keys = F.concat(F.coalesce(path, F.array().cast("array<struct<field:string,key_value:string>>")), names)
    return edges.select(F.explode(keys).alias("k"), *extra).select("k.field", "k.key_value", *extra)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "hyperedges")
    stats = chunked_key_stats(key_rows(edges, "loaded_at"), ["field", "key_value"], latest="loaded_at", order=["loaded_at"])
    return stats.where(F.col("n_rows") >= HEAVY * edges.count()).select("field", "key_value")


def p2_key_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per file and per target node: rows, distinct edges, distinct neighbours (other nodes of the key's edges), latest load."""
    edges = table(spark, sf, "hyperedges").select("edge_id", "source_path", "sources", "targets", "loaded_at")
    keys = ["field", "key_value"]
    rows = key_rows(edges.withColumn("nodes", F.array_distinct(F.concat(clean_nodes(F.col("sources")), clean_nodes(F.col("targets"))))), "edge_id", "nodes", "loaded_at")
    stats = chunked_key_stats(rows.drop("nodes"), keys, latest="loaded_at", order=["loaded_at", "edge_id"])
    near = rows.select(*keys, F.explode("nodes").alias("near")).where("field <> 'targets' or near <> key_value")
    out = with_distinct(with_distinct(stats, rows, keys, "edge_id", "n_edges"), near, keys, "near", "n_neighbours")
    return out.select(*keys, "n_rows", "n_edges", "n_neighbours", F.col("latest_loaded_at").alias("latest_load"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return resolve_hierarchy(inherits_links(table(spark, sf, "hyperedges")))


def p6_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Path, depth and root of each class, and how many classes lie below it (roots included as nodes of depth 0)."""
    full = resolve_hierarchy(inherits_links(table(spark, sf, "hyperedges")), with_path=True)
    below = descendants(full).groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))
    roots = full.where("root <> ''").select(F.col("root").alias("node")).distinct()
    every = full.unionByName(roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth_from_root"), F.array("node").alias("path")))
    return every.join(below, "node", "left").select("node", "root", "depth_from_root", F.array_join("path", " > ").alias("path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def p6_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return descendants(resolve_hierarchy(inherits_links(table(spark, sf, "hyperedges")), with_path=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (p2_found, p2_key_stats, p6_found, p6_hierarchy, p6_descendants)}
    return CATALOG | own


def _norm(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\x00-\x1f\x7f\s]+', ' ', 'g'))"


def _clean(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda n: {_norm('n')}), lambda n: n IS NOT NULL AND n <> '')"


def oracle_sql() -> dict[str, str]:
    keys = f"""
        k AS (SELECT 'source_path' AS field, source_path AS key_value, edge_id, loaded_at, sources, targets FROM hyperedges WHERE source_path <> ''
              UNION ALL SELECT 'targets', unnest(list_distinct({_clean('targets')})), edge_id, loaded_at, sources, targets FROM hyperedges)"""
    links = f"""
        l AS (SELECT DISTINCT {_clean('sources')}[1] AS node, {_clean('targets')}[1] AS parent FROM hyperedges WHERE upper(trim(edge_type)) = 'INHERITS'),
        one AS (SELECT node, min(parent) AS parent FROM l WHERE node IS NOT NULL AND parent IS NOT NULL GROUP BY node),
        up AS (SELECT node, parent AS anc, 1 AS d, [node, parent] AS path FROM one
               UNION ALL SELECT u.node, o.parent, u.d + 1, list_append(u.path, o.parent) FROM up u JOIN one o ON u.anc = o.node WHERE NOT list_contains(u.path, o.parent)),
        ends AS (SELECT u.node, u.anc AS root, u.d, u.path FROM up u WHERE u.anc NOT IN (SELECT node FROM one))"""
    return SQL | {
        "p2_found": f"WITH {keys} SELECT field, key_value FROM k GROUP BY ALL HAVING count(*) >= 0.05 * (SELECT count(*) FROM hyperedges)",
        "p2_key_stats": f"""
            WITH {keys},
            n AS (SELECT field, key_value, count(DISTINCT x) AS n FROM (SELECT field, key_value, unnest(list_concat({_clean('sources')}, {_clean('targets')})) AS x FROM k) WHERE field <> 'targets' OR x <> key_value GROUP BY ALL)
            SELECT field, key_value, count(*) AS n_rows, count(DISTINCT edge_id) AS n_edges, coalesce(any_value(n.n), 0) AS n_neighbours, max(loaded_at) AS latest_load
            FROM k LEFT JOIN n USING (field, key_value) GROUP BY field, key_value""",
        "p6_found": f"""
            WITH RECURSIVE {links}
            SELECT o.node, coalesce(e.root, '') AS root, CAST(coalesce(e.d, -1) AS INT) AS depth_from_root FROM one o LEFT JOIN ends e USING (node)""",
        "p6_hierarchy": f"""
            WITH RECURSIVE {links},
            every AS (SELECT o.node, coalesce(e.root, '') AS root, CAST(coalesce(e.d, -1) AS INT) AS depth_from_root, array_to_string(e.path, ' > ') AS path FROM one o LEFT JOIN ends e USING (node)
                      UNION ALL SELECT DISTINCT root, root, 0, root FROM ends),
            below AS (SELECT a AS node, count(*) AS n FROM (SELECT unnest(path[2:]) AS a FROM ends) GROUP BY a)
            SELECT every.*, coalesce(below.n, 0) AS n_descendants FROM every LEFT JOIN below USING (node)""",
        "p6_descendants": f"""
            WITH RECURSIVE {links}
            SELECT path[i + 1] AS ancestor, node AS descendant, CAST(i AS INT) AS distance FROM (SELECT node, path, unnest(range(1, len(path))) AS i FROM ends)""",
    }
