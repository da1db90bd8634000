"""Files nobody wrote by hand: tool output, minified scripts, third-party copies, data saved as code.

Each file's text becomes a sequence of statement tokens (a statement with its names, numbers and strings taken out), for which a Re-Pair grammar is
inferred. Tool output and tables are made of few rules used over and over. Large literals get a grammar over their characters;
what hardly shrinks is a blob. Third-party copies are found by one grammar of the whole corpus: over the lines of all files and libraries the commonest pairs of neighbours become rules, round by round, and rules that occur in several
repositories or in a known library mark the files they cover.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, release
from .syntax import newest_files

REUSED, BLOB_CHARS, BLOB_RATE, BLOB_SHARE, SHARED = 0.6, 200, 0.62, 0.3, 0.3
EVEN = 0.81  # bits of the characters of random data, against those of its alphabet, that even short samples exceed and prose, code and word lists do not
PACKED = 3  # statements a line from which a file counts as minified
LONG, SHORT = 4, 16  # rules of LONG lines or more tell a copy; lines under SHORT characters say too little

_COMMENT = {"py": r"#[^\n]*", "": r"//[^\n]*|/\*[\s\S]*?\*/"}
_STR = r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`"
_TAKE = {k: re.compile(f"({_STR})|(?:{c})", re.M) for k, c in _COMMENT.items()}
_WORD = re.compile(r"[^\W\d][\w$]*")
_RUN = re.compile(r"(?:[-+]?(?:0|s)\s*[,;]?\s*){3,}")
_GAP = re.compile(r"[ \t]{2,}|\t")
_JOIN = re.compile(r"[\s,+\\]*(?:\b[bBrRuUfF]{1,2})?")  # what may stand between two literals of a run
_CUT = re.compile(r"(?<=[;{}])(?!\n)")
_KEEP = frozenset("if for while return def class func fn function struct type interface enum const let var static public private package import from export".split())


class _Marks(dict):
    """What stands for a word or number: itself for keywords, 0 for numbers, a for names; kept until there are very many."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        mark = self[word] = word if word in _KEEP else "0" if word[0].isdigit() else "a"
        return mark


_ITEM, _POINT = re.compile(r"[\w$]+"), re.compile(r"0(?:\.[0a]?)+")
_marks = _Marks()


# What tools write into the comments of their output, and how they name files and folders (fixed values).
_MARK = re.compile(r"(?i)\bcode generated by\b|@generated\b|<auto-?generated\b|\bauto-?generated (?:file|by|code)\b|\bautomatisch erzeugt\b|\bproduced by a tool\b|\b(?:made|emitted|written|generated|created) by [\w.-]+ v?\d|\bcommands emitted by\b|\bfile (?:is|was) (?:auto-?)?generated\b")
_MARK_WORDS = ("generated", "erzeugt", "produced by a tool", "made by", "emitted by", "written by", "created by")  # one of them is in every mark
_TOOL_FILE = re.compile(r"(?:\.pb\.(?:go|c|h|cc)|_pb2(?:_grpc)?\.py|\.(?:gen|g|generated|designer)\.\w+|\.tab\.[ch]|\.lex\.c)$")
_FOREIGN = re.compile(r"(?i)\bvendored from\b|\bcopied (?:verbatim )?from (?:the )?upstream\b|\bthird[- ]party code\b")
TOOL_DIRS = ("gen", "generated", "__generated__", "autogen", "_generated")


def statements(text: str, ext: str) -> tuple[list[str], list[str], list[str]]:
    """(statement tokens, string literals, comments) of a text. Literals that follow each other (side by side, added, items of a list) are one."""
    comments: list[str] = []
    runs: list[list[str]] = []
    end = -1  # of the last literal or comment; -1 once other code was met

    def take(m: re.Match) -> str:
        nonlocal end
        joins = end >= 0 and _JOIN.fullmatch(text, end, m.start())
        if m.group(1) is None or (python and text.startswith(_TRIPLE, m.start()) and _alone(text, m.start())):
            comments.append(m.group())
            end = m.end() if joins else -1
            return " "
        if joins:
            runs[-1].append(m.group(1))
        else:
            runs.append([m.group(1)])
        end = m.end()
        return ' "" '

    python = ext == "py"
    bare = _TAKE["py" if python else ""].sub(take, text)
    bare = _POINT.sub("0", _ITEM.sub(lambda m: _marks[m[0]], bare)).replace('""', "s")
    bare = _RUN.sub("0+", bare)
    parts = (p.strip() for p in _CUT.sub("\n", _GAP.sub(" ", bare)).split("\n"))
    literals = ["".join(r) if len(r) == 1 else "".join(map(_inside, r)) for r in runs]
    return [p for p in parts if p and p not in _CLOSERS], literals, comments


_TRIPLE = ('"""', "'''")


def _alone(text: str, at: int) -> bool:
    """Only blanks stand before it on its line, and either some do or the line before is empty: a docstring, which is a comment."""
    line = text.rfind("\n", 0, at) + 1
    return not text[line:at].strip() and (at > line or text[max(0, line - 2) : line] == "\n\n")


def _inside(literal: str) -> str:
    n = 3 if len(literal) > 5 and literal[:3] in ('"""', "'''") else 1
    return literal[n:-n]


_CLOSERS = frozenset(["}", "{", "};", ")", "]", "end", ");"])


def re_pair(seq: list) -> tuple[list[int], dict[int, tuple[int, int]], list]:
    """Re-Pair: the commonest pair of neighbours becomes a rule until none occurs twice. Returns the last sequence, the rules and the terminals; symbols below len(terminals) are terminals."""
    ids: dict = {}
    s = [ids.setdefault(x, len(ids)) for x in seq]
    rules: dict[int, tuple[int, int]] = {}
    n = len(ids)
    while len(s) > 1:
        pair, count = Counter(zip(s, s[1:])).most_common(1)[0]
        if count < 2:
            break
        a, b = pair
        out, i, hits = [], 0, 0
        end = len(s) - 1
        while i < end:
            if s[i] == a and s[i + 1] == b:
                out.append(n)
                hits += 1
                i += 2
            else:
                out.append(s[i])
                i += 1
        if i == end:
            out.append(s[end])
        if hits < 2:
            break  # only overlapping occurrences were left
        rules[n] = pair
        s = out
        n += 1
    return s, rules, list(ids)


def reuse(seq: list) -> float:
    """Share of a sequence that stands in repetitions: rules that double a rule (or a terminal) twice over, times their uses."""
    if len(seq) < 8:
        return 0.0
    s, rules, terminals = re_pair(seq)
    size = dict.fromkeys(range(len(terminals)), 1)
    power: dict[int, int] = {}  # how often the symbol doubled
    for r, (a, b) in rules.items():
        size[r] = size[a] + size[b]
        power[r] = power.get(a, 0) + 1 if a == b else 0

    def covered(x: int) -> int:
        if power.get(x, 0) >= 2:
            return size[x]
        if x in rules:
            return covered(rules[x][0]) + covered(rules[x][1])
        return 0

    total = 0
    i = 0
    while i < len(s):  # neighbours of a run that were left over by the doubling belong to it
        x = s[i]
        total += covered(x) or (size[x] if (i and _root(s[i - 1], rules) == _root(x, rules)) else 0)
        i += 1
    return total / len(seq)


def _root(x: int, rules: dict[int, tuple[int, int]]) -> int:
    while x in rules and rules[x][0] == rules[x][1]:
        x = rules[x][0]
    return x


# Alphabets that data is written in, least first; a literal counts as written in the first that holds all but 3 % of it.
_ALPHABETS = (frozenset("0123456789"), frozenset("0123456789abcdefABCDEF"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567="), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="), frozenset(map(chr, range(33, 127))), frozenset(map(chr, range(256))))
_BITS = (math.log2(10), 4.0, 5.0, 6.0, math.log2(94), 8.0)
_BARE = re.compile(r"\s+|\\[nrt\n]|(?:(?<![0-9A-Za-z])0x(?=[\da-fA-F]{1,8}\b))|(?<=[\da-fA-F]{2})[,:;-](?=\s*(?:0x)?[\da-fA-F]{2})")
_BYTE = re.compile(r"\\x([\da-fA-F]{2})|\\u00([\da-fA-F]{2})|\\([0-3][0-7]{2})")


def _entropy(counts) -> float:
    """Bits of a sequence with these counts of symbols."""
    n = sum(counts)
    return n * math.log2(n) - sum(c * math.log2(c) for c in counts) if n else 0.0


def _pairing(s: list[int], terminals: int) -> Iterator[tuple[int, int, int, int]]:
    """Re-Pair over ``s``, in place and in about linear time, as pairs are counted as they change: yields each rule's (left, right, symbol, uses); taken positions become -1."""
    n = len(s)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    where: dict[tuple[int, int], set[int]] = {}
    for i in range(n - 1):
        where.setdefault((s[i], s[i + 1]), set()).add(i)
    heap = [(-len(v), k) for k, v in where.items() if len(v) > 1]
    heapq.heapify(heap)
    new = terminals
    while heap:
        c, pair = heapq.heappop(heap)
        at = where.get(pair, ())
        if len(at) != -c:
            if len(at) > 1:
                heapq.heappush(heap, (-len(at), pair))
            continue
        a, b = pair
        hits = 0
        touched = set()
        for i in sorted(at):
            j = after[i] if s[i] == a else n
            if j >= n or s[j] != b:
                continue  # an overlap that was used up
            p, q = before[i], after[j]
            if p >= 0:
                where[s[p], a].discard(p)
                where.setdefault((s[p], new), set()).add(p)
                touched.add((s[p], new))
            if q < n:
                where[b, s[q]].discard(j)
                where.setdefault((new, s[q]), set()).add(i)
                touched.add((new, s[q]))
                before[q] = i
            s[i], s[j], after[i] = new, -1, q
            hits += 1
        where.pop(pair, None)
        if not hits:
            continue
        for k in touched:
            if k in where and len(where[k]) > 1:
                heapq.heappush(heap, (-len(where[k]), k))
        yield a, b, new, hits
        new += 1


def grammar_bits(text: str) -> float:
    """Bits of the Re-Pair grammar of a text, from the characters alone to the last rule, where it is least: its sequence by the counts of its symbols, and each rule by one symbol and two bits (rules in the order of their left sides)."""
    ids: dict[str, int] = {}
    s = [ids.setdefault(x, len(ids)) for x in text]
    counts = Counter(s)
    best, rules, due = _entropy(counts.values()), 0, 1
    size = lambda: _entropy([x for x in counts.values() if x > 0]) + rules * (math.log2(len(ids) + rules) + 2)
    for a, b, new, hits in _pairing(s, len(ids)):
        counts[a] -= hits
        counts[b] -= hits
        counts[new] = hits
        rules += 1
        if rules >= due:
            due += 1 + due // 8
            best = min(best, size())
    return min(best, size()) if s else 0.0


def shrink(literal: str) -> float:
    """Size of a literal's own grammar against as much random data in its alphabet, 0 where its characters are far from evenly used; white space, separators of hexadecimal numbers and escapes are taken out before."""
    x = _BARE.sub("", _BYTE.sub(lambda m: chr(int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3], 8)), literal))
    if not x:
        return 0.0
    counts = Counter(x)
    held = [sum(n for c, n in counts.items() if c not in a) <= 0.03 * len(x) for a in _ALPHABETS]
    if sum(counts[c] for c in "234567") < 0.05 * len(x):
        held[2] = False  # words in capitals
    full = min(next((b for h, b in zip(held, _BITS) if h), 16.0), math.log2(max(2, len(x)))) * len(x)
    return grammar_bits(x) / full if _entropy(counts.values()) > EVEN * full else 0.0


_VALUE, _NUMBER = re.compile(r"\d[\w.]*"), re.compile(r"(?<![\w$])\d[\w.]*")


def table_share(text: str) -> float:
    """Share of a text's characters in tables of numbers: its numbers become 0 and its names a, and rules that double again and again hold numbers, signs and brackets only.

    Only where numbers and what stands between them could make up BLOB_SHARE of the text is the grammar built at all.
    """
    values = _VALUE.findall(text)
    if 2 * (sum(map(len, values)) + 2 * len(values)) < BLOB_SHARE * len(text):  # with a sign and a point each
        return 0.0
    if 2 * sum(2 + len(m) for m in _NUMBER.findall(text)) < BLOB_SHARE * len(text):  # digits in names are no numbers
        return 0.0
    seq: list[str] = []
    size: list[int] = []
    at = 0
    for m in _TABLE.finditer(text):
        k = m.lastgroup
        if k == "blank":
            if size:
                size[-1] += m.end() - at  # white space belongs to what stands before it
            at = m.end()
            continue
        seq.append("0" if k == "value" else "a" if k == "name" else m.group())
        size.append(m.end() - at)
        at = m.end()
    ids: dict[str, int] = {}
    s = [ids.setdefault(x, len(ids)) for x in seq]
    rules = {new: (a, b) for a, b, new, _ in _pairing(s, len(ids))}
    s, terminals = [x for x in s if x >= 0], list(ids)
    plain, length, power = [x not in ("a", '"', "'", "`") for x in terminals], dict.fromkeys(range(len(terminals)), 1), {}
    good = dict(enumerate(plain))
    for r, (a, b) in rules.items():
        good[r] = good[a] and good[b]
        length[r] = length[a] + length[b]
        power[r] = power.get(a, 0) + 1 if a == b else 0
    total, at = 0, 0

    def covered(x: int, at: int) -> int:
        if good[x] and power.get(x, 0) >= 2:
            return sum(size[at : at + length[x]])
        if x in rules:
            a, b = rules[x]
            return covered(a, at) + covered(b, at + length[a])
        return 0

    for i, x in enumerate(s):
        n = covered(x, at)
        if not n and good[x] and i and _root(s[i - 1], rules) == _root(x, rules):
            n = sum(size[at : at + length[x]])
        total += n
        at += length[x]
    return total / max(1, len(text))


_TABLE = re.compile(r"(?P<blank>\s+)|(?P<value>[-+]?(?:\d[\w.]*|\.\d[\w.]*))|(?P<name>[^\W\d][\w$]*)|(?P<sign>.)")


def measure(text: str, path: str) -> tuple[float, float, float, float, bool, bool]:
    """(reuse of rules, share of near-incompressible literals and number tables, statements a line, share of names of one or two characters, marked as tool output, marked as a third-party copy)."""
    tokens, literals, comments = statements(text, path.rsplit(".", 1)[-1].lower())
    blob = sum(len(x) for x in literals if len(x) > BLOB_CHARS and shrink(x) > BLOB_RATE)
    lines = max(1, sum(1 for x in text.split("\n") if x.strip()))
    density = len(tokens) / lines
    short = 0.0
    if density > 1.3:
        names = [w for w in _WORD.findall(text) if w not in _KEEP]
        short = sum(len(w) < 3 or (len(w) < 5 and w[1:].isdigit()) for w in names) / max(1, len(names))
    parts = path.split("/")
    said = "\n".join(comments)
    low = said.lower()
    marked = any(x in low for x in _MARK_WORDS) and bool(_MARK.search(said)) or bool(_TOOL_FILE.search(parts[-1])) or any(x in TOOL_DIRS for x in parts[1:-1])
    return reuse(tokens), max(blob / max(1, len(text)), table_share(text)), density, short, marked, any(x in low for x in ("vendored", "upstream", "third")) and bool(_FOREIGN.search(said))


def _lines(text: str) -> list[str]:
    return [x for x in (" ".join(raw.split()) for raw in text.split("\n")) if len(x) >= SHORT]


def line_names(text: str) -> list[int]:
    """A file's terminals of the corpus grammar: the names of its lines, white space aside."""
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in _lines(text)]


# Folders that hold other people's code or tools' output, by custom (fixed values).
VENDOR_DIRS = ("vendor", "_vendor", "3rdparty", "3rd_party", "third_party", "thirdparty", "third-party", "node_modules", "bower_components", "external", "extern", "deps")


LIBRARY = "\x00library"


def _measured(files: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, repo, text in zip(f["source_path"], f["repo"], f["markdown"]):
                found = measure(text, path) if text and repo != LIBRARY else (0.0, 0.0, 0.0, 0.0, False, False)
                rows.append((path, repo, *found, line_names(text) if text else []))
            yield pd.DataFrame(rows, columns=["source_path", "repo", "reuse", "blob", "density", "short_names", "marked", "foreign", "lines"])

    return files.mapInPandas(run, "source_path string, repo string, reuse double, blob double, density double, short_names double, marked boolean, foreign boolean, lines array<long>")


def _in_two_homes(rows: DataFrame, symbol: str, hot_rows: int) -> DataFrame:
    """The rows whose symbol occurs in two repositories (or one and a library), with ``uses``, the symbol's number of rows.

    A symbol is judged by its least and greatest repository, reduced before the shuffle, so no symbol's files are ever gathered. Symbols with more than ``hot_rows`` rows are sent to the rows instead of joined with them.
    """
    common = rows.where(F.col(symbol).isNotNull()).groupBy(F.col(symbol).alias("s")).agg(F.min("home").alias("lo"), F.max("home").alias("hi"), F.count(F.lit(1)).alias("uses")).where("lo <> hi").select("s", "uses")
    hot = F.broadcast(common.where(F.col("uses") > hot_rows).select(F.col("s").alias("hot_s"), F.col("uses").alias("hot_uses")))
    marked = rows.join(hot, F.col(symbol) == F.col("hot_s"), "left")
    cold = marked.where("hot_s is null").join(common.where(F.col("uses") <= hot_rows), F.col(symbol) == F.col("s"), "left")
    warm = marked.where("hot_s is not null")
    return cold.select(*rows.columns, "uses").unionByName(warm.select(*rows.columns, F.col("hot_uses").alias("uses")))


def shared_rules(measured: DataFrame, hot_rows: int | None = None, rounds: int | None = None) -> DataFrame:
    """(file, hits): how many of each file's lines are covered by rules of LONG lines or more that occur in another repository or in a library file.

    Re-Pair over the corpus, in rounds: terminals are the lines found in two repositories; in a round every pair of neighbours is counted over all files, and a pair found in two repositories becomes a rule wherever it is
    commoner (ties: by name) than the pairs it overlaps. Rounds go on until no rule under LONG lines has a pair left to join. Symbols with more than ``hot_rows`` rows (at least 50,000, a thousandth of all lines, so at most 1,000 symbols) are broadcast.
    """
    rows = measured.select(F.xxhash64("source_path").alias("file"), F.xxhash64("repo").alias("home"), F.posexplode("lines").alias("pos", "sym")).withColumn("len", F.lit(1))
    if hot_rows is None:
        hot_rows = max(50_000, (measured.agg(F.sum(F.size("lines"))).head()[0] or 0) // 1000)
    w = Window.partitionBy("file").orderBy("pos")
    terminals = _in_two_homes(rows, "sym", hot_rows).where("uses is not null").withColumn("run", F.col("pos") - F.row_number().over(w))
    # fewer than LONG in a row can never become a rule of LONG lines
    now = materialize(terminals.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file", "run"))).where(F.col("n") >= LONG).drop("uses", "run", "n"), "terminals")
    k = 0
    while rounds is None or k < rounds:
        after = F.lead("pos").over(w) == F.col("pos") + F.col("len")
        # both long: joined already well enough
        pair = F.when(after & ((F.col("len") < LONG) | (F.lead("len").over(w) < LONG)), F.xxhash64(F.lit(k), "sym", F.lead("sym").over(w)))
        paired = _in_two_homes(now.withColumn("pair", pair).withColumn("next_len", F.lead("len").over(w)), "pair", hot_rows)
        rank = F.when(F.col("uses").isNotNull(), F.struct("uses", "pair"))
        ranked = paired.withColumn("rank", rank)
        before, behind = F.lag("rank").over(w), F.lead("rank").over(w)
        ranked = ranked.withColumn("taken", F.coalesce(F.col("rank").isNotNull() & (before.isNull() | (F.col("rank") > before)) & (behind.isNull() | (F.col("rank") >= behind)), F.lit(False)))
        ranked = ranked.withColumn("gone", F.coalesce(F.lag("taken").over(w), F.lit(False)))
        done = ranked.where("not gone").select("file", "home", "pos", F.when(F.col("taken"), F.col("pair")).otherwise(F.col("sym")).alias("sym"), F.when(F.col("taken"), F.col("len") + F.col("next_len")).otherwise(F.col("len")).alias("len"), "taken")
        done = materialize(done, f"rules{k}")
        more = not done.where("taken").isEmpty()
        release(now)
        now = done.drop("taken")
        now._weft_path = done._weft_path
        k += 1
        if not more:
            break
    return now.where(F.col("len") >= LONG).groupBy("file").agg(F.sum("len").alias("hits"))


def not_by_hand(docs: DataFrame, library: DataFrame) -> DataFrame:
    """(source_path, repo, kind, reuse, blob, density, short_names, marked, shared): one row per code file; kind is 'generated', 'minified', 'data', 'vendored' or ''.

    The newest version of each file counts (see newest_files). Output of tools shaped like hand-written code shows no grammar of its own; it is known by the tool's
    mark in a comment (never in a string) or by the file's or folder's name. Rules shared over repositories cannot show a third-party copy that occurs once and is in no known library; such files
    are taken from their folder or from a comment that says so. NULL and empty texts are hand-written. Repeated rows count once; no rows, no rows out; the library may be empty.
    """
    lib = library.where("text is not null").select(F.concat(F.lit("\x00"), F.coalesce(F.col("lib_file_id").cast("string"), F.lit(""))).alias("source_path"), F.lit(LIBRARY).alias("repo"), F.col("text").alias("markdown"))
    measured = materialize(_measured(newest_files(docs).unionByName(lib)), "measured")
    hits = shared_rules(measured)
    own = measured.where(F.col("repo").isNull() | (F.col("repo") != LIBRARY)).withColumn("file", F.xxhash64("source_path"))
    both = own.join(hits, "file", "left").withColumn("shared", F.coalesce(F.col("hits") / F.size("lines"), F.lit(0.0)))
    folder = F.exists(F.slice(F.split("source_path", "/"), 2, 1000), lambda x: x.isin(*VENDOR_DIRS))
    kind = (
        F.when(F.col("blob") >= BLOB_SHARE, "data").when(F.col("density") >= PACKED, "minified").when((F.col("reuse") >= REUSED) | F.col("marked"), "generated").when(minified(), "minified")
        .when((F.col("shared") >= SHARED) | folder | F.col("foreign"), "vendored").otherwise("")
    )
    return both.select("source_path", "repo", kind.alias("kind"), "reuse", "blob", "density", "short_names", "marked", F.round("shared", 6).alias("shared"))


def minified():
    """Several statements a line, or mostly names of one or two characters with some."""
    return (F.col("density") >= PACKED) | ((F.col("short_names") >= 0.5) & (F.col("density") >= 1.5))
