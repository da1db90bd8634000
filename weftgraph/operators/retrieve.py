"""Query operators: exact and suffix lookup, ranked text search, vector search, intersection retrieval, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import VERB_TYPES, last_segment, path_stem
from .graph import Hypergraph, specificity, type_weight


# What an edge's source is to its targets, and the other way round (fixed values).
LABELS = {
    "CALLS": ("calls", "called by"), "IMPORTS": ("imports", "imported by"), "DEFINES": ("defines", "defined in"), "INHERITS": ("inherits from", "inherited by"), "SIGNATURE": ("has signature", "parameter of"),
    "RAISES": ("raises", "raised by"), "DECORATES": ("decorates", "decorated by"), "TEXT": ("related to", "related to"), "SUMMARY": ("summarised as", "summary of"),
}


def relation(edge_type: Column, forward: Column) -> Column:
    """The verb between a node and the other end of its edge; 'related to' for unknown types."""
    ahead, back = (F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v[i])]) for i in (0, 1))
    return F.coalesce(F.when(forward, F.try_element_at(ahead, edge_type)).otherwise(F.try_element_at(back, edge_type)), F.lit("related to"))


def relate(g: Hypergraph, hits: DataFrame) -> DataFrame:
    """(edge_id, node, edge_type, source_path, relationship, targets): what each met edge (edge_id, node) says of the node; targets are the nodes at the other end. Arrays are fetched for met edges only."""
    e = g.edges.select("edge_id", "edge_type", "source_path", "sources", "targets")
    x = hits.select("edge_id", "node").join(e, "edge_id")
    ahead = F.array_contains("sources", F.col("node"))
    return x.select("edge_id", "node", "edge_type", "source_path", relation(F.col("edge_type"), ahead).alias("relationship"), F.when(ahead, F.col("targets")).otherwise(F.col("sources")).alias("targets"))


def grep_patterns(symbols: DataFrame, least: int = 3) -> DataFrame:
    """(pattern): last segments of the other ends of relations, ``least`` characters or more."""
    return symbols.select(F.explode("targets").alias("n")).select(last_segment(F.col("n")).alias("pattern")).where(F.length("pattern") >= least).distinct()


def flags_to_types(calls: bool = False, callers: bool = False, inherits: bool = False, imports: bool = False, raises: bool = False) -> tuple[list[str] | None, str]:
    """(edge types or None for all, direction) that yes-or-no switches ask for."""
    types = [t for on, t in ((calls or callers, "CALLS"), (inherits, "INHERITS"), (imports, "IMPORTS"), (raises, "RAISES")) if on]
    return types or None, "forward" if calls and not callers else "backward" if callers and not calls else "both"


def infer_edge_types(query: str) -> list[str] | None:
    """Edge types named by the verbs of a query, in order; None if there is none."""
    words = [w.rstrip(".,;:!?") for w in query.lower().split()]
    return list(dict.fromkeys(VERB_TYPES[w] for w in words if w in VERB_TYPES)) or None


def match_names(g: Hypergraph, query: str, tokens: Sequence[str]) -> DataFrame:
    """Nodes equal to the whole query or ending in it as a last segment; only if there are none, the same for each token. Columns node, token, degree."""
    d = g.degrees()
    low = F.lower("node")
    whole = query.strip().lower()

    def of(words: Sequence[str]) -> DataFrame:
        w = F.broadcast(g.edges.sparkSession.createDataFrame([(x,) for x in words], "token string"))  # a query's words
        keys = d.select("node", "degree", F.explode(F.array_distinct(F.array(low, last_segment(low)))).alias("token"))  # an equi-join instead of an OR
        return keys.join(w, "token").groupBy("node").agg(F.min("token").alias("token"), F.first("degree").alias("degree"))

    hit = of([whole])
    return hit if not hit.isEmpty() or not tokens else of(tokens)


def lookup(g: Hypergraph, names: DataFrame, edge_types: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, symbols) of all edges on the matched nodes. Files: source_path and priority (1 if a DEFINES or CALLS edge, else 2); symbols: a row per edge and matched node, as ``relate`` gives it."""
    i = g.incidence.where(F.col("edge_type").isin(*edge_types)) if edge_types else g.incidence
    hit = i.join(names.select("node"), "node", "left_semi")
    files = hit.where("source_path <> ''").groupBy("source_path").agg(F.min(F.when(F.col("edge_type").isin("DEFINES", "CALLS"), 1).otherwise(2)).alias("priority"))
    return files, relate(g, hit)


def score_names(g: Hypergraph, names: DataFrame) -> DataFrame:
    n = max(g.count(), 1)
    return names.withColumn("specificity", F.round(specificity(F.col("degree"), F.lit(float(n)), F.col("token"), F.col("node")), 4))


def text_search(g: Hypergraph, terms: Sequence[str], limit: int = 20) -> DataFrame:
    """(entry, kind, quality): nodes and paths by best match: 1 last segment or stem equal, 2 prefix, 3 inside, 4 in an edge's relation and the node, 6 in a path; ties by name; ``limit`` in all."""
    d = g.incidence.groupBy("node").agg(F.lit(1).alias("one"))
    low, stem = F.lower("node"), last_segment(F.lower("node"))

    def best(by) -> Column:
        return F.least(*[by(t) for t in terms], F.lit(99), F.lit(99))  # no terms match nothing

    node = best(lambda t: F.when(stem == t, 1).when(low.startswith(t), 2).when(low.contains(t), 3).otherwise(99))
    nodes = d.select(F.col("node").alias("entry"), F.lit("node").alias("kind"), node.alias("quality"))
    paths = g.edges.where("source_path <> ''").select("source_path").distinct()
    plow, pstem = F.lower("source_path"), F.lower(path_stem(F.col("source_path")))
    path = best(lambda t: F.when(pstem == t, 1).when(plow.contains(t), 6).otherwise(99))
    both = nodes.unionByName(paths.select(F.col("source_path").alias("entry"), F.lit("path").alias("kind"), path.alias("quality")))
    return both.where("quality < 99").orderBy("quality", "kind", "entry").limit(limit)


def collapse_directories(files: DataFrame, terms: Sequence[str], least: int = 3) -> DataFrame:
    """Files (source_path, priority) with folders of ``least`` files or more made one row 'dir/': priority 1 if a term is in the folder's name and it has 5 files, 2 if either that or 7 files, else 3."""
    from ..functions.text import parent_dir

    up = F.coalesce(F.nullif(parent_dir(F.col("source_path")), F.lit("")), F.lit("."))
    x = files.withColumn("dir", up)
    n = x.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    low = F.lower("dir")
    named = F.lit(False)
    for t in terms:
        named = named | low.contains(t)
    dirs = n.select(F.concat("dir", F.lit("/")).alias("source_path"), F.when(named & (F.col("n") >= 5), 1).when(named | (F.col("n") >= 7), 2).otherwise(3).alias("priority"), "n")
    rest = x.join(n.select("dir"), "dir", "left_anti").select("source_path", F.col("priority").cast("int").alias("priority"), F.lit(1).cast("long").alias("n"))
    return dirs.unionByName(rest)


def collapse_plan(files: DataFrame, terms: Sequence[str], least: int = 3) -> DataFrame:
    """The folding of a whole plan's files (source_path, priority): rows that are folders already ('dir/') stay and swallow the files right below them; other folders of ``least`` files or more become one row: priority 1 if a term is in
    the folder's own name and it has 5 files, 2 if either that or 7 files, else the best of its files but 3 at least; then test paths come later by 2. Columns source_path, priority, n. Rows with a NULL path are left out."""
    from ..functions.text import file_name, is_test_segment, parent_dir

    base = files.where("source_path is not null")
    folded = base.where(F.col("source_path").endswith("/")).groupBy("source_path").agg(F.min("priority").cast("int").alias("priority")).withColumn("n", F.lit(1).cast("long"))
    x = base.where(~F.col("source_path").endswith("/")).withColumn("dir", F.coalesce(F.nullif(parent_dir(F.col("source_path")), F.lit("")), F.lit(".")))
    x = x.join(folded.select(F.expr("left(source_path, length(source_path) - 1)").alias("dir")), "dir", "left_anti")
    per = x.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.min("priority").alias("best")).where(F.col("n") >= least)
    named = F.lit(False)
    for t in terms:
        named = named | F.lower(file_name(F.col("dir"))).contains(t)
    rank = F.when(named & (F.col("n") >= 5), 1).when(named | (F.col("n") >= 7), 2).otherwise(F.greatest("best", F.lit(3))).cast("int")
    dirs = per.select(F.concat("dir", F.lit("/")).alias("source_path"), rank.alias("priority"), "n")
    rest = x.join(per.select("dir"), "dir", "left_anti").select("source_path", F.col("priority").cast("int").alias("priority"), F.lit(1).cast("long").alias("n"))
    return folded.unionByName(dirs).unionByName(rest).withColumn("priority", F.col("priority") + F.when(is_test_segment(F.col("source_path")), 2).otherwise(0))


def rank_seeds(g: Hypergraph, names: DataFrame, limit: int = 5, least: float = 0.25) -> DataFrame:
    """The ``limit`` nodes a search starts from: of (node, specificity) those of ``least`` or more (all in a graph too small for specificity to tell), those of source files before those of tests, the most specific first, ties by name."""
    from ..functions.text import is_test_segment
    from .traverse import first_files

    if g.edges.limit(50).count() >= 50:
        names = names.where(F.col("specificity") >= least)
    placed = names.join(first_files(g), "node", "left")
    return placed.withColumn("late", is_test_segment(F.coalesce("source_path", F.lit("")))).orderBy("late", F.desc("specificity"), "node").limit(limit).select("node", "specificity")


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def vector_top(vectors: DataFrame, query: Sequence[float], k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest unit vectors by cosine; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(dot(F.col(vec_col), q), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


TILE = 2000  # vectors a side of a block pair, whatever their number, so a task's product stays at TILE x TILE


def similar_pairs(vectors: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, score) for a < b with cosine of at least ``least``, by blocks: the vectors are cut into blocks, and blocks meet as matrix products in Arrow batches; every pair is looked at once."""
    import numpy as np
    import pandas as pd

    base = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    blocks = max(1, -(-base.count() // TILE))
    own = base.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("blk", "o").alias("p"), F.greatest("blk", "o").alias("q"), "blk", "id", "v")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        p, q = key
        a, b = f[f.blk == p], f[f.blk == q]
        x, y = (np.array(list(s.v), dtype=np.float64).reshape(len(s), -1) for s in (a, b))
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "score": []})
        i, j = np.nonzero(x @ y.T >= least - 1e-12)
        ia, jb = a.id.to_numpy()[i], b.id.to_numpy()[j]
        keep = ia < jb if p == q else ia != jb
        s = np.einsum("ij,ij->i", x[i], y[j])[keep]
        return pd.DataFrame({"a": np.minimum(ia, jb)[keep], "b": np.maximum(ia, jb)[keep], "score": s.round(6)})

    return left.groupBy("p", "q").applyInPandas(run, "a long, b long, score double")


def hybrid_top(vectors: DataFrame, query: Sequence[float], terms: Sequence[str], k: int = 20, floor: float = 0.0) -> DataFrame:
    """(node, score): the ``k`` nodes of (node, embedding) of highest score, the greater of cosine and keyword score (1 for a name equal to a term, 0.85 for one that holds a term); those under ``floor`` are left out, ties go by name."""
    low = F.lower("node")
    word = F.greatest(F.lit(0.0), *[F.when(low == t, 1.0).when(low.contains(t), 0.85).otherwise(0.0) for t in terms])
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("node", F.round(F.greatest(dot(F.col("embedding"), q), word), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "node").limit(k).where(F.col("score") >= floor)


def semantic_search(g: Hypergraph, matched: DataFrame, floor: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, symbols, greps) of nodes matched by score (node, score); those under ``floor`` are dropped. Files: source_path, priority 2, the best score; symbols: the nodes; greps: their last segments."""
    kept = matched.where(F.col("score") >= floor)
    files = g.incidence.join(F.broadcast(kept), "node").where("source_path <> ''").groupBy("source_path").agg(F.max("score").alias("score")).withColumn("priority", F.lit(2))  # top-k rows
    return files, kept.select("node", F.lit("semantic match").alias("relationship"), "score"), kept.select(last_segment(F.col("node")).alias("pattern")).distinct()


def put_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored vectors (node, embedding) with those of nodes not stored yet; of repeated new ones the first in order of the vector counts."""
    fresh = new.join(stored.select("node"), "node", "left_anti").groupBy("node").agg(F.min("embedding").alias("embedding"))
    return stored.select("node", "embedding").unionByName(fresh)


def remove_vectors(stored: DataFrame, nodes: DataFrame) -> DataFrame:
    return stored.join(nodes.select("node").distinct(), "node", "left_anti")


def rename_vectors(stored: DataFrame, mapping: DataFrame) -> DataFrame:
    """Vectors moved to their node's keeper (merged, keeper); a keeper that has a vector keeps its own, of several merged ones the first by name counts."""
    moved = stored.join(mapping, F.col("node") == F.col("merged")).groupBy("keeper").agg(F.min_by("embedding", "merged").alias("embedding")).select(F.col("keeper").alias("node"), "embedding")
    left = stored.join(mapping.select(F.col("merged").alias("node")), "node", "left_anti")
    return left.select("node", "embedding").unionByName(moved.join(left.select("node"), "node", "left_anti"))


def coverage_score(g: Hypergraph, retrieved: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row: seeds, covered ones, their share (0 without seeds)."""
    flags = coverage(g, retrieved, seeds)[0]
    return flags.agg(F.count(F.lit(1)).alias("seeds"), F.count_if("covered").alias("covered")).withColumn("score", F.when(F.col("seeds") == 0, 0.0).otherwise(F.round(F.col("covered") / F.col("seeds"), 4)))


def confidence(score: Column) -> Column:
    return F.when(score >= 0.7, "HIGH").when(score >= 0.4, "MED").otherwise("LOW")


def assemble_context(g: Hypergraph, query: str, scored: DataFrame, paths: Sequence[Sequence[str]], score: float, more: int = 10, most: int = 500) -> str:
    """A result as text: coverage and provenance, each path edge by edge with its confidence and what ties it to the next, then the ``more`` best other edges. ``scored``: edge_id, score, retrieval_source; at most ``most`` edges are told of."""
    rows = scored.orderBy(F.desc("score"), "edge_id").limit(most).join(g.edges.select("edge_id", "edge_type", "relation", "source_path", "all_nodes"), "edge_id").withColumn("tier", confidence(F.col("score"))).collect()
    by, sources = {r.edge_id: r for r in rows}, [r.retrieval_source for r in rows]
    say = lambda r: f"{r.edge_type}: {r.relation} [{r.retrieval_source}, {r.score:.2f}, {r.tier}] {r.source_path}"
    lines = [f"Query: {query}", f"Coverage: {score:.2f}", f"Edges: {sources.count('seed')} seed, {sources.count('intersection')} intersection"]
    told: set[str] = set()
    for n, path in enumerate(paths, 1):
        lines += ["", f"Path {n}"]
        known = [by[e] for e in path if e in by]
        for r, after in zip(known, [*known[1:], None]):
            told.add(r.edge_id)
            lines.append(f"  {say(r)}")
            if after is not None:
                lines.append(f"    through {', '.join(sorted(set(r.all_nodes) & set(after.all_nodes)))}")
    rest = [r for r in sorted(rows, key=lambda r: (-r.score, r.edge_id)) if r.edge_id not in told][:more]
    return "\n".join(lines + (["", "Other edges"] + [f"  {say(r)}" for r in rest] if rest else []))


def hashed_vectors(names: DataFrame, size: int = 64, encoder=None) -> DataFrame:
    """(node, embedding) of unit length for (node). Without an ``encoder`` the parts of a name and their runs of three letters are counted into ``size`` hashed places; an encoder takes a list of texts and gives a list of vectors, and is called on batches of 64 in the workers. A name without parts gets zeros."""
    if encoder is None:
        parts = F.filter(F.split(F.lower(F.regexp_replace("node", r"(?<=[a-z0-9])(?=[A-Z])", "_")), r"[^a-z0-9]+"), lambda x: x != "")
        grams = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > 3, F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))).otherwise(F.array(p))))
        places = F.transform(F.concat(parts, grams), lambda x: F.pmod(F.xxhash64(x), F.lit(size)).cast("int"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda x: x == i)).cast("double"))
        x = names.select("node", counts.alias("c")).withColumn("n", F.sqrt(dot(F.col("c"), F.col("c"))))
        return x.select("node", F.transform("c", lambda v: v / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).alias("embedding"))

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            out = []
            for lo in range(0, len(f), 64):
                v = np.asarray(encoder(f["node"].iloc[lo : lo + 64].tolist()), dtype=np.float64)
                out.extend((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).tolist())
            yield pd.DataFrame({"node": f["node"], "embedding": out})

    return names.select("node").mapInPandas(run, "node string, embedding array<double>")


def edge_scores(g: Hypergraph, node_scores: DataFrame, k: int, alpha: float = 0.6) -> DataFrame:
    """Edges on scored nodes: precision = mean score x sqrt(matched / size), coverage = matched / k, score = (alpha precision + (1 - alpha) coverage) x type weight."""
    size = g.edges.select("edge_id", "edge_type", F.size("all_nodes").alias("size"))
    hit = g.incidence.join(F.broadcast(node_scores.limit(k)), "node").groupBy("edge_id").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("matched"))
    x = hit.join(size, "edge_id").withColumn("wp", F.col("mean") * F.sqrt(F.col("matched") / F.col("size"))).withColumn("cov", F.col("matched") / F.lit(float(k)))
    return x.select("edge_id", "edge_type", F.round("wp", 4).alias("weighted_precision"), F.round("cov", 4).alias("coverage"), F.round((alpha * F.col("wp") + (1 - alpha) * F.col("cov")) * type_weight(F.col("edge_type")), 4).alias("score"))


def expand_scores(g: Hypergraph, seeds: DataFrame, node_scores: DataFrame, alpha: float = 0.6, limit: int = 50) -> DataFrame:
    """Edges next to scored edges through nodes that are no hubs: alpha x best seed's score + (1 - alpha) x (sum of idf x mean score over shared nodes). The best seed counts; ties by id."""
    i = g.incidence.select("edge_id", "node").join(g.hubs().select("node"), "node", "left_anti")
    s = i.join(seeds.select("edge_id", "score"), "edge_id").select(F.col("edge_id").alias("seed"), F.col("score").alias("seed_score"), "node")
    w = g.idf().select("node", "idf").join(node_scores.select("node", F.col("score").alias("sim")), "node", "left")
    pairs = s.join(i, "node").join(seeds.select("edge_id"), "edge_id", "left_anti").join(w, "node")
    per = pairs.groupBy("seed", "seed_score", "edge_id").agg(F.sum("idf").alias("idf"), F.avg(F.coalesce("sim", F.lit(0.0))).alias("sim"))
    per = per.withColumn("final", alpha * F.col("seed_score") + (1 - alpha) * F.col("idf") * F.col("sim"))
    one = Window.partitionBy("edge_id").orderBy(F.desc("seed_score"), "seed")
    return per.withColumn("n", F.row_number().over(one)).where("n = 1").select("edge_id", "seed", F.round("final", 4).alias("score")).orderBy(F.desc("score"), "edge_id").limit(limit)


def coverage(g: Hypergraph, retrieved: DataFrame, seeds: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """(seeds with covered flag, frontier): a seed is covered if a retrieved edge holds it; the frontier is the ``top`` nodes of edges next to retrieved ones that no retrieved edge holds, by degree, then name."""
    held = g.incidence.join(retrieved.select("edge_id"), "edge_id", "left_semi").select("node").distinct()
    flags = seeds.select("node").distinct().join(held.withColumn("hit", F.lit(True)), "node", "left").select("node", F.coalesce("hit", F.lit(False)).alias("covered"))
    near = g.incidence.join(held, "node", "left_semi").select("edge_id").distinct()
    out = g.incidence.join(near, "edge_id", "left_semi").select("node").distinct().join(held, "node", "left_anti")
    return flags, g.degrees().join(out, "node", "left_semi").orderBy(F.desc("degree"), "node").limit(top)


def density(g: Hypergraph, ids: DataFrame) -> DataFrame:
    """One row: edges, intersecting pairs, density (0 for fewer than two edges). Where one node lies in all edges every pair meets, and no pair is made."""
    i = g.incidence.join(ids.select("edge_id"), "edge_id", "left_semi").select("edge_id", "node")
    n = i.agg(F.countDistinct("edge_id").alias("n_edges"))
    total = n.head()[0]
    most = i.groupBy("node").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
    if total > 1 and most == total:
        pairs = n.select((F.col("n_edges") * (F.col("n_edges") - 1) / 2).cast("long").alias("n_pairs"))
    else:
        both = i.select(F.col("edge_id").alias("a"), "node").join(i.select(F.col("edge_id").alias("b"), "node"), "node").where("a < b").select("a", "b").distinct()
        pairs = both.agg(F.count(F.lit(1)).alias("n_pairs"))
    return n.join(pairs).withColumn("density", F.when(F.col("n_edges") < 2, 0.0).otherwise(F.round(F.col("n_pairs") / (F.col("n_edges") * (F.col("n_edges") - 1) / 2), 4)))  # one row each
