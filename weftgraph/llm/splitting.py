"""Oversized texts cut at natural boundaries by packing a structure tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, DEEPEST = 2000, 200, 40
_HEAD = re.compile(r"(#{1,6})\s")
_UNDER = re.compile(r"([=\-~^\"'#*+])\1{2,}\s*$")
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_SENTENCE = re.compile(r"[.!?;:]['\")\]]*\s+|[,{};]\s*(?=\S)")
_SPACE = re.compile(r"\s+")
_LINE = re.compile(r"[^\n]*\n|[^\n]+$")


def _indent(line: str) -> int:
    n = 0
    for ch in line:
        if ch == " ":
            n += 1
        elif ch == "\t":
            n += 4
        else:
            break
    return n


def _code_depths(lines: list[str]) -> list[int]:
    """Twice the indentation in steps, one more unless a blank line goes before: blocks hold their lines, lines what is indented below them."""
    out, gap = [], True
    for line in lines:
        if not line.strip():
            out.append(-1)
            gap = True
            continue
        out.append(min(2 * (_indent(line) // 2) + (not gap), DEEPEST))
        gap = False
    return out


def _text_depths(lines: list[str]) -> list[int]:
    """Headings by level, then paragraphs, list items by indentation, lines; fenced code is one block."""
    out, gap, fence = [], True, False
    for i, line in enumerate(lines):
        if _FENCE.match(line):
            out.append(14 if fence else 8)
            fence, gap = not fence, False
        elif fence:
            out.append(12 + (not gap))
            gap = not line.strip()
        elif not line.strip():
            out.append(-1)
            gap = True
        elif m := _HEAD.match(line):
            out.append(len(m[1]))
            gap = True
        elif gap and i + 1 < len(lines) and _UNDER.match(lines[i + 1]):
            out.append({"=": 1, "-": 2, "~": 3}.get(lines[i + 1][0], 4))
            gap = False
        elif m := _ITEM.match(line):
            out.append(min(9 + _indent(line) // 2, DEEPEST))
            gap = False
        else:
            out.append(8 if gap else DEEPEST)
            gap = False
    return out


def _tree(depths: list[int]) -> list:
    """Nodes [first line, last line + 1, children]; a blank line belongs to what stands before it."""
    roots: list = []
    stack: list = []
    for i, d in enumerate(depths):
        if d < 0:
            if not stack:
                roots.append([i, i + 1, []])
            continue
        while stack and stack[-1][0] >= d:
            stack.pop()[1][1] = i
        node = [i, len(depths), []]
        (stack[-1][1][2] if stack else roots).append(node)
        stack.append((d, node))
    return roots


def _cut_line(text: str, start: int, end: int, cap: int) -> list[tuple[int, int]]:
    """A line over the cap: after sentences or commas, else between words, else at the cap; never inside \\r\\n."""
    out = []
    while end - start > cap:
        cut = 0
        for pattern in (_SENTENCE, _SPACE):
            for m in pattern.finditer(text, start + cap // 2, start + cap):
                cut = m.end()
            if cut > start:
                break
        else:
            cut = start + cap
            if cap > 1 and text[cut - 1] == "\r" and text[cut : cut + 1] == "\n":
                cut -= 1
        out.append((start, cut))
        start = cut
    return [*out, (start, end)]


def _pack(nodes: list, at: list[int], text: str, cap: int) -> list[tuple[int, int]]:
    """Merge neighbouring sibling subtrees up to the cap; only nodes over the cap are opened, and what comes out of one is never merged with its neighbours."""
    out: list[tuple[int, int]] = []
    whole = False  # the last part holds whole siblings
    for first, last, children in nodes:
        a, b = at[first], at[last]
        if b - a <= cap:
            if whole and b - out[-1][0] <= cap:
                out[-1] = (out[-1][0], b)
            elif b > a:
                out.append((a, b))
                whole = True
            continue
        if children:
            out.extend(_pack([(first, children[0][0], []), *children], at, text, cap))
        elif last - first > 1:
            out.extend(_pack([(i, i + 1, []) for i in range(first, last)], at, text, cap))
        else:
            out.extend(_cut_line(text, a, b, cap))
        whole = False
    return out


def cut_points(text: str, is_code: bool, limit: int = LIMIT, overlap: int = OVERLAP, whole_words: bool = False) -> list[tuple[int, int]]:
    """(start, end) of the pieces, in characters. Each but the first repeats the ``overlap`` characters before it, with ``whole_words`` from the first word that begins in them; none is longer than ``limit``; together they cover the text."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if len(text) <= limit:
        return [(0, len(text))]
    lines = _LINE.findall(text)
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line))
    parts = _pack(_tree((_code_depths if is_code else _text_depths)(lines)), at, text, limit - overlap)
    return [(_back(text, a, overlap, whole_words), b) if a else (a, b) for a, b in parts]


_START = re.compile(r"(?<!\w)\w")


def _back(text: str, a: int, overlap: int, whole_words: bool) -> int:
    start = max(0, a - overlap)
    if whole_words and start:
        m = _START.search(text, start, a)
        start = m.start() if m else a
    return start


def sections(text: str) -> list[tuple[int, str]]:
    """(position, heading) of the ATX headings outside fences, in order."""
    out, at, fence = [], 0, False
    for line in _LINE.findall(text):
        if _FENCE.match(line):
            fence = not fence
        elif not fence and _HEAD.match(line):
            out.append((at, line.strip("#").strip() if line.strip("# \t\r\n") else ""))
        at += len(line)
    return out


def _pieces(limit: int, overlap: int, whole_words: bool = False):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                known = [int(x) for x in (r.start_line, r.end_line) if pd.notna(x) and x >= 1]
                base, text = (min(known) if known else 1), r.text
                lines, seen = 0, 0  # newlines before the last piece's start
                heads = [] if r.code else sections(text)
                for no, (a, b) in enumerate(cut_points(text, bool(r.code), limit, overlap, whole_words)):
                    new = min(a + overlap, b - 1) if no and not whole_words else a  # where what the piece adds begins
                    section = next((h for p, h in reversed(heads) if p <= new), r.heading)
                    lines += text.count("\n", seen, a)
                    seen = a
                    rows.append((r.chunk_id, no, text[a:b], r.source_path, r.heading, base + lines, base + lines + text.count("\n", a, b - 1), a, section))
            yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "text", "source_path", "heading", "start_line", "end_line", "start_char", "section"])

    return run


CODE_TYPES = ("py", "js", "jsx", "ts", "tsx", "go", "java", "c", "h", "cc", "cpp", "rs", "rb", "php", "cs", "swift", "kt", "scala")


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, whole_words: bool = False) -> DataFrame:
    """Pieces (chunk_id, piece_no, text, source_path, heading, start_line, end_line, start_char, section) of the chunks over ``limit`` characters.

    Of a chunk_id's rows the one with the latest indexed_at counts (NULL is the earliest; ties go to the latest loaded_at, then to the greatest text); only if its text
    is over the limit it is cut. Rows without a chunk_id are versions of nothing and count each. Only long texts are shuffled.
    Pieces are at most ``limit`` characters; each but the first begins with exactly ``overlap`` characters of the one before (all of it if shorter), with ``whole_words`` from the first word among them.
    ``heading`` is the chunk's, ``section`` the nearest heading inside the text at or before what the piece adds (the chunk's where there is none, and in code).
    Line numbers start at the lower of the chunk's two (1 where both are missing or below 1). NULL and short texts yield nothing here.
    Code is what is_code says, or the file type or extension where that is NULL. Empty input gives no rows; other columns are ignored.
    """
    long = F.length("text") > limit
    kind = F.lower(F.regexp_replace(F.coalesce(F.nullif(F.trim("file_type"), F.lit("")), F.regexp_extract("source_path", r"\.(\w+)$", 1), F.lit("")), r"^\.", ""))
    own = F.coalesce(F.col("chunk_id"), F.concat(F.lit("\x00"), F.xxhash64("text", "source_path", "start_line", "end_line").cast("string")))
    kept = F.when(long, F.struct("text", "source_path", "heading", "start_line", "end_line", F.coalesce(F.col("is_code"), kind.isin(*CODE_TYPES)).alias("code")))
    rank = F.struct(F.col("indexed_at"), F.col("loaded_at"), F.xxhash64("text").alias("tie"))
    rows = chunks.select(own.alias("own"), F.col("chunk_id"), kept.alias("kept"), rank.alias("rank"))
    newest = rows.groupBy("own").agg(F.max_by(F.struct("chunk_id", "kept"), "rank").alias("x"))
    over = newest.where("x.kept is not null").select("x.chunk_id", "x.kept.*")
    schema = "chunk_id string, piece_no int, text string, source_path string, heading string, start_line int, end_line int, start_char int, section string"
    return over.mapInPandas(_pieces(limit, overlap, whole_words), schema)
