"""Reading files, cutting them into chunks, extracting edges, and finding what changed."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File kinds and folders that are passed over (fixed values).
CODE_EXTENSIONS = ("py", "js", "jsx", "ts", "tsx", "java", "go", "rs", "c", "cc", "cpp", "cxx", "h", "hpp", "hxx", "cs", "rb", "php", "swift", "kt", "scala", "lua", "r", "jl", "sh", "mjs", "cjs")
TEXT_EXTENSIONS = ("md", "txt", "rst")
SKIP_DIRS = ("__pycache__", "node_modules", "venv", "env", "dist", "build", "target")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))


def skipped(path: Column) -> Column:
    """A hidden or passed-over folder is on the path."""
    return F.exists(F.split(path, "/"), lambda x: x.isin(*SKIP_DIRS) | (x.startswith(".") & (x != ".") & (x != "..")))


def _decoded(content: pd.Series) -> pd.DataFrame:
    """Bytes as UTF-8 text with replacement characters; what could not be read is an error."""
    text, err = [], []
    for b in content:
        if b is None:
            text.append(None)
            err.append("unreadable")
        else:
            b = bytes(b)
            text.append(b.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace"))
            err.append(None)
    return pd.DataFrame({"text": text, "err": err})


def scan_directory(spark: SparkSession, root: str, extensions: list[str] | None = None, most_bytes: int = 50_000_000) -> DataFrame:
    """(source_path, markdown, file_type, is_code, metadata, error) of all text files below ``root``, by path; bytes that are no UTF-8 become replacement characters.

    A file that cannot be read as a whole comes out with NULL text and an error instead of failing the scan: corrupt or vanished files, and those over ``most_bytes``, which are never loaded.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(root)
    prefix = F.lit(root.rstrip("/") + "/")
    rel = F.split_part("path", prefix, F.lit(-1))
    wanted = [e.lower().lstrip(".") for e in extensions] if extensions else [*CODE_EXTENSIONS, *TEXT_EXTENSIONS]
    x = listed.withColumn("rel", rel).withColumn("ext", extension(F.col("rel"))).where(~skipped(F.col("rel")) & F.col("ext").isin(*wanted))
    shape = [F.col("rel").alias("source_path"), F.col("text").alias("markdown"), F.col("ext").alias("file_type"), F.col("ext").isin(*CODE_EXTENSIONS).alias("is_code"), F.struct(F.substring_index("rel", "/", -1).alias("filename"), F.col("length").alias("size_bytes")).alias("metadata"), F.col("err").alias("error")]
    read = x.where(F.col("length") <= most_bytes).withColumn("t", F.pandas_udf(_decoded, "struct<text:string,err:string>")(F.col("content"))).select("rel", "ext", "length", "t.text", "t.err").select(*shape)
    large = x.where(F.col("length") > most_bytes).select("rel", "ext", "length", F.lit(None).cast("string").alias("text"), F.lit("too large").alias("err")).select(*shape)
    return read.unionByName(large)


def split_errors(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable documents, (source_path, error) of the others)."""
    return docs.where("error is null"), docs.where("error is not null").select("source_path", "error")


def fixed_windows(docs: DataFrame, id_col: str, text_col: str, size: int = 2000, overlap: int = 200) -> DataFrame:
    """(id, start, text, chunk_id): windows of ``size`` characters every size - overlap; empty and NULL texts give none."""
    step = size - overlap
    starts = F.expr(f"sequence(0, length({text_col}) - 1, {step})")
    x = docs.where(F.length(text_col) > 0).select(F.col(id_col), F.col(text_col).alias("__t"), F.explode(starts).alias("start"))
    piece = F.expr(f"substring(__t, start + 1, {size})")
    return x.select(id_col, "start", piece.alias("text"), F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col("start").cast("string"))), 1, 16).alias("chunk_id"))


def markdown_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, heading, text): a section per ATX heading; what stands before the first is '__top__'. Blank sections are left out."""
    cut = F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\n(?=#{1,6} )")
    x = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(cut).alias("pos", "text"))
    head = F.regexp_extract(F.col("text"), r"^#{1,6} ([^\r\n]*)", 1)
    return x.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select(id_col, "pos", F.coalesce(F.nullif(F.trim(head), F.lit("")), F.lit("__top__")).alias("heading"), "text")


def packed_paragraphs(text: Column, limit: int = 2000) -> Column:
    """A text as pieces of whole paragraphs, filled from the left up to ``limit`` characters; a longer paragraph is a piece of its own."""
    parts = F.filter(F.split(text, r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))
    full = lambda a, x: F.length(a["last"]) + F.length(x) + 2 > limit
    fold = F.aggregate(
        parts, start,
        lambda a, x: F.when(a["last"].isNull(), F.struct(a["done"].alias("done"), x.alias("last"))).when(full(a, x), F.struct(F.array_append(a["done"], a["last"]).alias("done"), x.alias("last"))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["last"], F.lit("\n\n"), x).alias("last"))),
        lambda a: F.when(a["last"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["last"])),
    )
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(fold)


def chunk_documents(docs: DataFrame, limit: int = 2000) -> DataFrame:
    """(source_path, start, symbol, kind, text, chunk_id) of documents (source_path, markdown): Python by definitions, Markdown and other text by headings with long sections packed by paragraphs, other code, and whatever those two find nothing in, by fixed windows.

    NULL, empty and blank documents give no chunks. ``start`` is a line for Python, the section's number for text, and a character for windows. Pieces over ``limit`` (one paragraph, one function) stay whole.
    """
    d = docs.select("source_path", "markdown").where(F.length(F.trim(F.col("markdown"))) > 0)
    ext = extension(F.col("source_path"))
    py, code = d.where(ext == "py"), d.where(ext.isin(*CODE_EXTENSIONS) & (ext != "py"))
    prose = d.where(~ext.isin(*CODE_EXTENSIONS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["source_path"], f["markdown"]):
                lines = text.split("\n")
                found = [(path, a, name, kind, "\n".join(lines[a - 1 : z])) for name, kind, a, z in python_chunks(text)]
                rows.extend(found or [(path, None, None, None, text)])  # nothing to cut at: by windows below
            yield pd.DataFrame(rows, columns=["source_path", "start", "symbol", "kind", "text"]).astype({"start": "Int32"})

    cut = py.mapInPandas(run, "source_path string, start int, symbol string, kind string, text string")
    sections = markdown_sections(prose, "source_path", "markdown")
    packed = sections.select("source_path", F.col("pos").alias("start"), F.col("heading").alias("symbol"), F.lit("section").alias("kind"), F.explode(packed_paragraphs(F.col("text"), limit)).alias("text"))
    plain = code.unionByName(cut.where("start is null").select("source_path", F.col("text").alias("markdown")))
    windows = fixed_windows(plain, "source_path", "markdown", limit, limit // 10).select("source_path", F.col("start").cast("int").alias("start"), F.lit(None).cast("string").alias("symbol"), F.lit("window").alias("kind"), "text")
    every = cut.where("start is not null").unionByName(packed).unionByName(windows)
    return every.withColumn("chunk_id", F.substring(F.md5(F.concat_ws(":", "source_path", F.col("start").cast("string"), F.md5("text"))), 1, 16))


def python_chunks(source: str) -> list[tuple[str, str, int, int]]:
    """(symbol, kind, first line, last line): the preamble, each function, class and method; none for source that does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    tops = [n for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))]
    if tops:
        out.append(("__preamble__", "preamble", min(n.lineno for n in tops), max(n.end_lineno for n in tops)))
    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((n.name, "function", n.lineno, n.end_lineno))
        elif isinstance(n, ast.ClassDef):
            out.append((n.name, "class", n.lineno, n.end_lineno))
            out.extend((f"{n.name}.{m.name}", "method", m.lineno, m.end_lineno) for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)))
    return out


def _text(n: ast.AST) -> str:
    try:
        return ast.unparse(n)
    except Exception:  # noqa: BLE001
        return ""


def python_edges(path: str, source: str) -> list[tuple[str, list[str], list[str], int]]:
    """(type, sources, targets, line) of one Python file: DEFINES, INHERITS, CALLS, RAISES, SIGNATURE, IMPORTS, DECORATES. Function bodies belong to their function; nested definitions yield nothing of their own."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    module = path.replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    out: list[tuple[str, list[str], list[str], int]] = []

    def function(n, owner: str) -> None:
        name = f"{owner}.{n.name}"
        calls, raises = {}, {}
        for x in ast.walk(n):
            if isinstance(x, ast.Call):
                calls[_text(x.func)] = None
            elif isinstance(x, ast.Raise) and x.exc is not None:
                raises[_text(x.exc.func if isinstance(x.exc, ast.Call) else x.exc)] = None
        own = {n.name, name}
        if found := [c for c in calls if c and c not in own and len(c) < 100 and "\n" not in c]:
            out.append(("CALLS", [name], found, n.lineno))
        if raises:
            out.append(("RAISES", [name], list(raises), n.lineno))
        a = n.args
        hints = [_text(p.annotation) for p in [*a.posonlyargs, *a.args, *a.kwonlyargs] if p.annotation is not None] + ([_text(n.returns)] if n.returns is not None else [])
        if hints:
            out.append(("SIGNATURE", [name], hints, n.lineno))
        for d in n.decorator_list:
            out.append(("DECORATES", [_text(d.func if isinstance(d, ast.Call) else d)], [name], n.lineno))

    tops = []
    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            tops.append(f"{module}.{n.name}")
            function(n, module)
        elif isinstance(n, ast.ClassDef):
            name = f"{module}.{n.name}"
            tops.append(name)
            methods = [m for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            if methods:
                out.append(("DEFINES", [name], [f"{name}.{m.name}" for m in methods], n.lineno))
            if bases := [_text(b) for b in n.bases]:
                out.append(("INHERITS", [name], bases, n.lineno))
            for m in methods:
                function(m, name)
        elif isinstance(n, ast.Import):
            out.append(("IMPORTS", [module], [a.asname or a.name for a in n.names], n.lineno))
        elif isinstance(n, ast.ImportFrom):
            out.append(("IMPORTS", [module], [n.module or ".", *[a.asname or a.name for a in n.names]], n.lineno))
    return ([("DEFINES", [module], tops, 1)] if tops else []) + out


EDGE_SCHEMA = "edge_id string, relation string, edge_type string, sources array<string>, targets array<string>, all_nodes array<string>, source_path string, chunk_id string, line int, seq long, loaded_at timestamp"


def extract_python(docs: DataFrame) -> DataFrame:
    """Edges of the Python files among ``docs`` (source_path, markdown). Ids are made of path, type and place, so they do not depend on other files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["source_path"], f["markdown"]):
                for i, (kind, s, t, line) in enumerate(python_edges(path, text or "")):
                    key = hashlib.md5(f"{kind}_{path}_{i}".encode()).hexdigest()[:16]
                    rows.append((key, f"{', '.join(s)} {kind.lower()} {', '.join(t)}"[:200], kind, s, t, list(dict.fromkeys(s + t)), path, "", line, i, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EDGE_SCHEMA.split(", ")])

    return docs.where(extension(F.col("source_path")) == "py").select("source_path", "markdown").mapInPandas(run, EDGE_SCHEMA)


def extract_by_pattern(docs: DataFrame) -> DataFrame:
    """(source_path, edge_type, targets) for other languages: names after function and class words, and imported modules, by pattern."""
    t = F.col("markdown")
    fns = F.regexp_extract_all(t, F.lit(r"(?m)\b(?:def|function|func|fn)\s+(\w+)"), F.lit(1))
    classes = F.regexp_extract_all(t, F.lit(r"(?m)\b(?:class|struct|interface|trait)\s+(\w+)"), F.lit(1))
    imports = F.regexp_extract_all(t, F.lit(r"(?m)^\s*(?:import|from|use|require)\s+([\w.:/]+)"), F.lit(1))
    kinds = F.array(F.struct(F.lit("DEFINES").alias("edge_type"), F.array_distinct(F.concat(fns, classes)).alias("targets")), F.struct(F.lit("IMPORTS").alias("edge_type"), F.array_distinct(imports).alias("targets")))
    return docs.where(t.isNotNull()).select("source_path", F.explode(kinds).alias("k")).select("source_path", "k.*").where(F.size("targets") > 0)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source_path, status): added, deleted, modified or unchanged by the SHA-256 of the text; one row a path on either side."""
    a = old.select("source_path", F.sha2("markdown", 256).alias("was"))
    b = new.select("source_path", F.sha2("markdown", 256).alias("now"))
    x = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "source_path", "full")
    return x.select("source_path", F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("modified").alias("status"))


def associate_chunks(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(edge_id, chunk_id): the narrowest chunk of the edge's file that holds its line (ties: lower start, then id). Chunks without numbers span 1 to 999999; edges without a line or without such a chunk get the file's first. The join is on the file; each pair is reduced by a map-side minimum."""
    lo, hi = F.coalesce(F.least("start_line", "end_line"), F.lit(1)), F.coalesce(F.greatest("start_line", "end_line"), F.lit(999999))
    c = chunks.select("source_path", F.col("chunk_id").alias("chunk"), lo.alias("lo"), hi.alias("hi")).distinct()
    x = edges.where("source_path <> ''").select("edge_id", "source_path", F.coalesce("line", F.lit(0)).alias("line")).join(c, "source_path")
    inside = (F.col("line") > 0) & F.col("line").between(F.col("lo"), F.col("hi"))
    rank = F.struct(F.when(inside, 0).otherwise(1), F.when(inside, F.col("hi") - F.col("lo")).otherwise(0), F.col("lo"), F.col("chunk"))
    return x.groupBy("edge_id").agg(F.min_by("chunk", rank).alias("chunk_id"))
