"""Edges from source files of languages with braces: definitions, inheritance, calls, raises, imports, by a scan of scopes.

Comments and strings are blanked first, at the same length. What stands before a brace tells the scope: a class (also interfaces, structs, traits and the like), a function, or a plain block. Function bodies are read for calls and raises
as a whole and not descended. Python goes through its own parser, other languages through patterns (see ``ingest``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import CODE_EXTENSIONS, EDGE_SCHEMA, extension, extract_by_pattern, extract_python

# Extension to language family (fixed values).
FAMILIES = {
    "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "ts", "tsx": "ts", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "php": "php",
}
_STRINGS = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'"
_BLANK = {
    "js": rf"//[^\n]*|/\*[\s\S]*?\*/|{_STRINGS}|{_SINGLE}|`(?:[^`\\]|\\[\s\S])*`", "go": rf"//[^\n]*|/\*[\s\S]*?\*/|{_STRINGS}|`[^`]*`|'(?:[^'\\\n]|\\.)+'", "rust": rf"//[^\n]*|/\*[\s\S]*?\*/|{_STRINGS}|'(?:[^'\\\n]|\\.)'",
    "java": rf'//[^\n]*|/\*[\s\S]*?\*/|"""[\s\S]*?"""|{_STRINGS}|{_SINGLE}', "c": rf"//[^\n]*|/\*[\s\S]*?\*/|{_STRINGS}|{_SINGLE}|(?m:^[ \t]*#(?:[^\n\\]|\\[\s\S])*)", "php": rf"//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?\*/|{_STRINGS}|{_SINGLE}",
}
_BLANK |= {"ts": _BLANK["js"], "cpp": _BLANK["c"]}
_BLANK = {k: re.compile(v) for k, v in _BLANK.items()}
_TYPE_ARGS = r"(?:<[^(){}]*>)?"
_CLASS = {
    "js": r"\bclass\s+(?P<name>[\w$]+)(?:\s+extends\s+(?P<bases>[\w$.]+))?", "ts": rf"\b(?:class|interface|enum|namespace)\s+(?P<name>[\w$.]+)\s*{_TYPE_ARGS}(?:\s*extends\s+(?P<bases>[\w$.,<>\s]+?))?(?:\s*implements\s+(?P<more>[\w$.,<>\s]+))?$",
    "go": r"\btype\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?:struct|interface)$", "rust": rf"\b(?:struct|enum|union|trait|mod)\s+(?P<name>\w+)\s*{_TYPE_ARGS}(?:\s*:\s*(?P<bases>[\w:+<>\s,']+?))?(?:\s*where\b.*)?$",
    "java": rf"(?:\b(?:class|interface|enum|record)|@interface)\s+(?P<name>\w+)\s*{_TYPE_ARGS}(?:\s*\([^)]*\))?(?:\s*extends\s+(?P<bases>[\w.,<>?\s&]+?))?(?:\s*implements\s+(?P<more>[\w.,<>?\s]+?))?(?:\s*permits\b.*)?$",
    "c": r"\b(?:struct|union|enum)\s+(?P<name>\w+)$", "cpp": r"\b(?:class|struct|union|enum(?:\s+class)?|namespace)\s+(?P<name>\w+)(?:\s+final)?(?:\s*:(?!:)\s*(?P<bases>[\w:<>,\s]+))?$",
    "php": r"\b(?:class|interface|trait|enum)\s+(?P<name>\w+)(?:\s*:\s*\w+)?(?:\s+extends\s+(?P<bases>[\w\\,\s]+?))?(?:\s+implements\s+(?P<more>[\w\\,\s]+))?$",
}
_IMPL = re.compile(rf"\bimpl\b\s*{_TYPE_ARGS}\s*(?:(?P<bases>[\w:]+)\s*{_TYPE_ARGS}\s+for\s+)?&?(?P<name>[\w:]+)[^;]*$")
_JS_FUNCTION = rf"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*{_TYPE_ARGS}\s*\(|\b(?:const|let|var)\s+(?P<arrow>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=>]+)?=>$|\b(?:const|let|var)\s+(?P<held>[\w$]+)\s*=\s*(?:async\s+)?function\b"
_FUNCTION = {
    "js": _JS_FUNCTION, "ts": _JS_FUNCTION, "go": r"\bfunc\s*(?:\((?P<owner>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\]\s*)?\(", "rust": r"\bfn\s+(?P<name>\w+)", "java": r"(?P<name>\w+)\s*\([^(){}]*(?:\([^()]*\)[^(){}]*)*\)\s*(?:throws\s+[\w.,\s]+)?$",
    "c": r"(?P<name>\w+)\s*\([^{}]*\)\s*$", "cpp": r"(?P<name>~?\w+(?:::~?\w+)*)\s*\([^{}]*\)\s*(?:const|noexcept|override|final|\s)*(?:->[^{}]*)?(?::[^{}]*)?$", "php": r"\bfunction\s+&?(?P<name>\w+)\s*\(",
}
_METHOD = re.compile(rf"(?:^|\s)(?:\*|#)?(?P<name>[\w$]+)\s*{_TYPE_ARGS}\s*\([^{{}}]*\)\s*(?::[^{{}}]*)?$")
_ABSTRACT = re.compile(r"(?:^|[\s;])(?:fn\s+|function\s+&?)?([A-Za-z_$][\w$]*)\s*(?:<[^(){};]*>)?\s*\(")
_CLASS = {k: re.compile(v, re.S) for k, v in _CLASS.items()}
_FUNCTION = {k: re.compile(v, re.S) for k, v in _FUNCTION.items()}
_NOT_CALLS = frozenset("if for while switch catch return function sizeof typeof new throw else do with super match loop fn func await yield in of case when elseif foreach isset empty unset array list echo print assert static_assert defined synchronized alignof decltype go defer select chan map range".split())
_CONTROL = frozenset("if for while switch catch with do else match loop synchronized try foreach elseif return new".split())
_CALL = re.compile(r"(?<![\w$.>:])((?:[A-Za-z_$][\w$]*(?:\?\.|\.|::|->|\\))*[A-Za-z_$][\w$]*)(?:!(?=[(\[{])|(?:<[\w,\s:&']*>|::<[^()]*>)?(?=\s*\())")
_THROW = re.compile(r"\bthrow\s+(?:new\s+)?([A-Za-z_$\\][\w$.:\\]*)")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")


def _spaces(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def _names(listed: str | None) -> list[str]:
    """Bases of a heritage clause: type arguments, visibility and lifetimes taken out."""
    if not listed:
        return []
    flat = listed
    while "<" in flat and (cut := re.sub(r"<[^<>]*>", "", flat)) != flat:
        flat = cut
    out = [re.sub(r"\b(?:public|private|protected|virtual)\b|'\w+", "", x).strip(" \t\n:") for x in re.split(r"[,+&]", flat)]
    return [x for x in dict.fromkeys(out) if x]


def imports(text: str, family: str) -> list[tuple[list[str], int]]:
    """(targets, line) of the imports of a text as it stands."""
    found: list[tuple[list[str], int]] = []

    def add(at: int, *targets: str) -> None:
        kept = [t.strip() for t in dict.fromkeys(targets) if t.strip()]
        if kept:
            found.append((kept, text.count("\n", 0, at) + 1))

    if family in ("js", "ts"):
        for m in re.finditer(r"""(?m)^\s*import\s+(?:type\s+)?(?:([\w$*{},\s]+?)\s+from\s+)?['"]([^'"]+)['"]""", text):
            parts = re.split(r"[{},]|\s+as\s+\S+", m[1] or "")
            add(m.start(2), m[2], *(p.replace("type ", "").strip(" *\n\t") for p in parts))
        for m in re.finditer(r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)|(?m:^\s*export\s[^'"\n;]*\sfrom\s+['"]([^'"]+)['"])""", text):
            add(m.start(), m[1] or m[2])
    elif family == "go":
        for m in re.finditer(r"(?m)^import\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"([^\"]+)\")", text):
            for p in re.finditer(r"\"([^\"]+)\"", m.group()):
                add(m.start() + p.start(), p[1])
    elif family == "rust":
        for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", text):
            add(m.start(1), *_expanded(m[1]))
    elif family == "java":
        for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", text):
            add(m.start(1), m[1])
    elif family in ("c", "cpp"):
        for m in re.finditer(r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", text):
            add(m.start(1), m[1])
    elif family == "php":
        for m in re.finditer(r"(?m)^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+\w+)?\s*;|\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]", text):
            add(m.start(), m[1] or m[2])
    return found


def _expanded(path: str) -> list[str]:
    """A use path with its braces multiplied out; aliases dropped."""
    path = " ".join(path.split())
    if "{" not in path:
        return [path.split(" as ")[0].replace(" ", "")]
    head, rest = path.split("{", 1)
    depth, part, parts = 1, "", []
    for ch in rest:
        depth += (ch == "{") - (ch == "}")
        if not depth:
            break
        if ch == "," and depth == 1:
            parts.append(part)
            part = ""
        else:
            part += ch
    head = head.replace(" ", "")
    out = [x for p in [*parts, part] if p.strip() for x in _expanded(p.strip())]
    return [head.removesuffix("::") if x == "self" else head + x for x in out]


def source_edges(path: str, text: str) -> list[tuple[str, list[str], list[str], int]]:
    """(type, sources, targets, line) of one file; the module's own definitions first."""
    family = FAMILIES.get(path.rsplit(".", 1)[-1].lower())
    if family is None or not text.strip():
        return []
    module = path.replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    bare = _BLANK[family].sub(_spaces, text)
    out = [("IMPORTS", [module], t, line) for t, line in imports(text, family)]
    tops: list[str] = []
    members: dict[str, list[str]] = {}
    lines: dict[str, int] = {}
    stack: list[tuple[str, str, int]] = []  # (kind, qualified name, where its body begins)
    head, blocks = 0, 0  # where the text before the next brace begins; open blocks inside a function
    starts = [0]
    for m in re.finditer(r"\n", text):
        starts.append(m.end())

    def line_of(at: int) -> int:
        import bisect

        return bisect.bisect_right(starts, at)

    def owner() -> str:
        return next((n for k, n, _ in reversed(stack) if k == "class"), module)

    def define(name: str, at: int) -> str:
        up = owner()
        full = f"{up}.{name}"
        if up == module:
            tops.append(full)
        else:
            members.setdefault(up, []).append(full)
            lines.setdefault(up, line_of(at))
        return full

    def opened(said: str, at: int) -> None:
        nonlocal blocks
        if any(k == "function" for k, _, _ in stack):
            stack.append(("block", "", at))
            return
        m = _IMPL.search(said) if family == "rust" else None
        if m:
            name = f"{module}.{m['name'].split('::')[-1]}"
            if m["bases"]:
                out.append(("INHERITS", [name], [m["bases"].split("::")[-1]], line_of(at)))
            stack.append(("class", name, at))
            return
        m = _CLASS[family].search(said)
        if m:
            name = define(m["name"], at)
            bases = _names(m.groupdict().get("bases")) + _names(m.groupdict().get("more"))
            if bases:
                out.append(("INHERITS", [name], bases, line_of(at)))
            stack.append(("class", name, at))
            return
        m = _FUNCTION[family].search(said)
        if m is None and family in ("js", "ts") and stack and stack[-1][0] == "class":
            m = _METHOD.search(said)
        name = next((x for k, x in m.groupdict().items() if k != "owner" and x), None) if m else None
        if name and name not in _CONTROL and not (family == "java" and not (stack and stack[-1][0] == "class")):
            receiver = (m.groupdict().get("owner") or "").replace("*", " ").split("[")[0].split()
            if receiver:
                full = f"{module}.{receiver[-1]}.{name}"
                members.setdefault(f"{module}.{receiver[-1]}", []).append(full)
                lines.setdefault(f"{module}.{receiver[-1]}", line_of(at))
            else:
                full = define(name.replace("::", "."), at)
            stack.append(("function", full, at))
            return
        stack.append(("block", "", at))

    def closed(kind: str, name: str, begin: int, end: int) -> None:
        body = bare[begin + 1 : end]
        if kind == "function":
            own = {name, name.rsplit(".", 1)[-1]}
            calls = dict.fromkeys(c[1] + ("!" if body[c.end(1) : c.end(1) + 1] == "!" else "") for c in _CALL.finditer(body))
            found = [c for c in calls if c not in own and c.split(".")[-1].split("::")[-1].split("->")[-1] not in _NOT_CALLS and len(c) < 100]
            if found:
                out.append(("CALLS", [name], found, line_of(begin)))
            raised = list(dict.fromkeys(m[1] for m in _THROW.finditer(body)))
            if raised:
                out.append(("RAISES", [name], raised, line_of(begin)))
        elif kind == "class":
            flat = body
            while (cut := re.sub(r"\{[^{}]*\}", ";", flat)) != flat:
                flat = cut
            known = {x.rsplit(".", 1)[-1] for x in members.get(name, ())}
            if family == "go":
                more = [w[1] for w in re.finditer(r"(?m)^\s*(\w+)\b", flat)]
            elif family == "rust" and "(" not in flat.split("fn ")[0][:1]:
                more = [w[1] for w in re.finditer(r"(?:^|[,;{\n])\s*(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:fn\s+)?([A-Za-z_]\w*)\s*(?=[:,(<=;]|$)", flat)]
            else:
                more = [w[1] for w in _ABSTRACT.finditer(flat) if w[1] not in _NOT_CALLS] if family in ("ts", "java", "php", "cpp") else []
            for x in dict.fromkeys(more):
                if x not in known and x != name.rsplit(".", 1)[-1]:
                    members.setdefault(name, []).append(f"{name}.{x}")
                    lines.setdefault(name, line_of(begin))

    for m in re.finditer(r"[{};]", bare):
        ch, at = m.group(), m.start()
        if ch == "{":
            opened(bare[head:at].strip(), at)
        elif ch == "}" and stack:
            kind, name, begin = stack.pop()
            closed(kind, name, begin, at)
        if ch != ";" or bare.count("(", head, at) <= bare.count(")", head, at):
            head = at + 1
    while stack:  # cut off: what was open ends here
        closed(*stack.pop(), len(bare))
    out.extend(("DEFINES", [k], list(dict.fromkeys(v)), lines[k]) for k, v in members.items())
    own = list(dict.fromkeys(tops))
    return ([("DEFINES", [module], own, 1)] if own else []) + out


def extract_braced(docs: DataFrame) -> DataFrame:
    """Edges of the files of braced languages among ``docs`` (source_path, markdown), one file at a time. NULL and empty texts give none; of a file that is cut off, what is there counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["source_path"], f["markdown"]):
                for i, (kind, s, t, line) in enumerate(source_edges(path, text or "")):
                    key = hashlib.md5(f"{kind}_{path}_{i}".encode()).hexdigest()[:16]
                    rows.append((key, f"{', '.join(s)} {kind.lower()} {', '.join(t)}"[:200], kind, s, t, list(dict.fromkeys(s + t)), path, "", line, i, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EDGE_SCHEMA.split(", ")])

    return docs.where(extension(F.col("source_path")).isin(*FAMILIES)).select("source_path", "markdown").mapInPandas(run, EDGE_SCHEMA)


def extract(docs: DataFrame) -> DataFrame:
    """Edges of all code files: Python by its parser, braced languages by scopes, the others by patterns (one edge per file and kind)."""
    other = docs.where(extension(F.col("source_path")).isin(*[e for e in CODE_EXTENSIONS if e != "py" and e not in FAMILIES]))
    stem = F.regexp_extract("source_path", r"([^/\\]+?)(?:\.\w+)?$", 1)
    p = extract_by_pattern(other)
    by_pattern = p.select(
        F.substring(F.md5(F.concat_ws("_", "edge_type", "source_path")), 1, 16).alias("edge_id"), F.concat(stem, F.lit(" "), F.lower("edge_type")).alias("relation"), "edge_type", F.array(stem).alias("sources"), "targets",
        F.array_distinct(F.concat(F.array(stem), "targets")).alias("all_nodes"), "source_path", F.lit("").alias("chunk_id"), F.lit(1).alias("line"), F.when(F.col("edge_type") == "DEFINES", 0).otherwise(1).cast("long").alias("seq"), F.lit(None).cast("timestamp").alias("loaded_at"),
    )
    return extract_python(docs).unionByName(extract_braced(docs)).unionByName(by_pattern)
