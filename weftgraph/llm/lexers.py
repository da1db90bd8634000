"""Token classes of seven languages. Each lexer yields (class, position): keywords and operators as themselves, NAME, NUM, STR, line ends where they count, ERR for what is no token."""

from __future__ import annotations

import re
from functools import lru_cache

EXTENSIONS = {"py": "python", "js": "js", "ts": "ts", "go": "go", "java": "java", "c": "c", "rs": "rust"}

_KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type",
    "js": "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield async await let of get set static from as",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface native new null package private protected public return static strictfp super switch synchronized this throw throws transient true false try volatile while boolean byte char double float int long short void var record sealed permits yield",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while",
}
_KEYWORDS["ts"] = _KEYWORDS["js"] + " abstract any declare enum implements infer interface is keyof namespace module private protected public readonly type satisfies unique override"
KEYWORDS = {lang: frozenset(words.split()) for lang, words in _KEYWORDS.items()}

_OPS = {
    "python": r"\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^]=|[-+*/%@&|^~<>=.,:;()\[\]{}]",
    "js": r">>>=|\*\*=|<<=|>>=|>>>|===|!==|&&=|\|\|=|\?\?=|\.\.\.|=>|\*\*|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\?\?|\?\.(?!\d)|[-+*/%&|^]=|[-+*/%&|^!~<>=.,:;?()\[\]{}@#]",
    "go": r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|<<|>>|&\^|[-+*/%&|^]=|[-+*/%&|^!<>=.,:;()\[\]{}~]",
    "java": r">>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|<<|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^!~<>=.,:;?()\[\]{}@]",
    "c": r"<<=|>>=|\.\.\.|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^!~<>=.,:;?()\[\]{}]",
    "rust": r"<<=|>>=|\.\.=|\.\.\.|\.\.|->|=>|::|&&|\|\||<<|<=|>=|==|!=|[-+*/%&|^]=|[-+*/%&|^!<>=.,:;?()\[\]{}@#$]",
}
_OPS["ts"] = _OPS["js"].replace(">>>=|", "").replace(r">>=|>>>|", "").replace(r"<<|>>|", "<<|")
_NAME = r"[^\W\d]\w*"
_SLASH = r"//[^\n]*|/\*[\s\S]*?\*/"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_INT = r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.eE])|\d[\d_]*(?:\.(?!\.)(?![^\W\d])[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?"
_TPL = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`"
_REGEX = r"(?:(?<=[=(,:\[!&|?{};\n])|(?<=[=(,:\[!&|?{};] )|(?<=return ))/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"

# group 1: line ends that may count, 2: name, 3: string, 4: number, 5: operator, 6: anything else
_PARTS = {
    "python": ("#[^\n]*|\\\\\r?\n|[ \t\f]+", r"\n[ \t\f\r]*(?:(?:#[^\n]*)?\n[ \t\f\r]*)*", _NAME, r"""(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:\"""(?:[^\\]|\\[\s\S])*?\"""|'''(?:[^\\]|\\[\s\S])*?'''|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')""", rf"(?:{_INT})[jJ]?(?!\w)"),
    "js": (rf"//[^\n]*|/\*[\s\S]*?\*/|[^\S\n]+", r"\n\s*", r"#?(?:[^\W\d]|\$)[\w$]*", rf"{_DQ}|{_SQ}|{_TPL}|{_REGEX}", rf"(?:{_INT})n?(?![\w$])"),
    "go": (r"//[^\n]*|/\*[\s\S]*?\*/|[^\S\n]+", r"\n\s*", _NAME, rf"{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{{1,10}}?)'", rf"(?:{_INT})i?(?!\w)"),
    "java": (_SLASH + r"|\s+", r"(?!)", r"(?:[^\W\d]|\$)[\w$]*", rf'"""[\s\S]*?"""|{_DQ}|{_SQ}', rf"(?:{_INT})[lLfFdD]?(?!\w)"),
    "c": (_SLASH + r"|(?m:^[ \t]*#(?:[^\n\\]|\\[\s\S])*)|\s+|\\\r?\n", r"(?!)", _NAME, rf"(?:u8|[uUL])?(?:{_DQ}|{_SQ})", rf"(?:{_INT})[uUlLfF]*(?!\w)"),
    "rust": (r"//[^\n]*|/\*[\s\S]*?\*/|\s+", r"(?!)", r"(?:r#)?[^\W\d]\w*", r'b?r"[^"]*"|b?r#"[\s\S]*?"#|b?r##"[\s\S]*?"##|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?\'(?:[^\'\\\n]|\\(?:u\{\w+\}|x\w\w|.))\'|\'[^\W\d]\w*', rf"(?:{_INT})(?:_?[iuf](?:8|16|32|64|128|size))?(?!\w)"),
}
_PARTS["ts"] = _PARTS["js"]


@lru_cache(maxsize=None)
def pattern(lang: str) -> re.Pattern:
    skip, line, name, string, number = _PARTS[lang]
    # strings go before names for their prefixes
    return re.compile(rf"(?:{skip})|({line})|({string})|({name})|({number})|({_OPS[lang]})|(\w+|[\s\S])")


_JS_NOT_STARTS = frozenset("else catch finally in instanceof of as while".split())
_JS_OPEN_ENDS = frozenset("if else for while do var let const new typeof delete void in instanceof of case export import extends function class throw try catch finally switch with await static async get set from as".split())
_GO_ENDS = frozenset(["NAME", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


_JS_STARTS = frozenset(["{", "++", "--", "@", "!", "~", "#"])
_JS_ENDS = frozenset(["NAME", "NUM", "STR", ")", "]", "}", "++", "--"])
_OPENING, _CLOSING = frozenset("([{"), frozenset(")]}")


def lex(lang: str, text: str) -> list[tuple[str, int]]:
    """(class, position) of every token."""
    at: list[int] = []
    return list(zip(classes(lang, text, at), at))


def classes(lang: str, text: str, at: list[int] | None = None) -> list[str]:
    """The token classes alone; ``at`` collects the positions where they are asked for."""
    if lang == "python":
        return _python(text, at)
    words = KEYWORDS[lang]
    out: list[str] = []
    put = out.append
    mark = at.append if at is not None else None
    if lang not in ("js", "ts", "go"):
        for m in pattern(lang).finditer(text):
            kind = m.lastindex
            if kind is None:
                continue
            t = m.group()
            if kind == 3:
                put(t if t in words else "NAME")
            elif kind == 5:
                put(t)
            elif kind == 4:
                put("NUM")
            elif kind == 2:
                put("LIFE" if lang == "rust" and t[0] == "'" and t[-1:] != "'" else "STR")
            else:
                put("ERR")
            if mark:
                mark(m.start())
        return out
    go = lang == "go"
    line = -1  # a line end since the last token
    depth: list[str] = []
    top = ""
    for m in pattern(lang).finditer(text):
        kind = m.lastindex
        if kind is None:
            if line < 0 and m.group().find("\n") >= 0:
                line = m.start()
            continue
        if kind == 1:
            if line < 0:
                line = m.start()
            continue
        t = m.group()
        if kind == 3:
            c = t if t in words else "NAME"
        elif kind == 5:
            c = t
        else:
            c = "STR" if kind == 2 else "NUM" if kind == 4 else "ERR"
        if line >= 0:
            if out:
                prev = out[-1]
                if go:
                    if prev in _GO_ENDS:
                        put(";")
                        if mark:
                            mark(line)
                elif top == "" or top == "{":
                    starts = kind < 5 and c not in _JS_NOT_STARTS or c in _JS_STARTS
                    if starts and (prev in _JS_ENDS or (prev[0].isalpha() and prev not in _JS_OPEN_ENDS)) and not (kind == 2 and t[0] == "`"):
                        put("NL")
                        if mark:
                            mark(line)
            line = -1
        if kind == 5 and not go:
            if t in _OPENING:
                depth.append(top)
                top = t
            elif t in _CLOSING:
                top = depth.pop() if depth else ""
        put(c)
        if mark:
            mark(m.start())
    if go and out and out[-1] in _GO_ENDS:
        put(";")
        if mark:
            mark(len(text))
    return out


def _python(text: str, where: list[int] | None) -> list[str]:
    words = KEYWORDS["python"]
    out: list[str] = []
    pos: list[int] = []
    levels = [(0, 0)]
    depth = 0
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text[:1] == "﻿":
        text = text[1:]
    for m in pattern("python").finditer("\n" + text):
        kind = m.lastindex
        if kind is None:
            continue
        t, at = m.group(), m.start() - 1
        if kind == 1:
            if depth:
                continue
            end = m.end() - 1
            if end >= len(text) or text[end] == "#":
                continue  # no token on that line
            pad = t[t.rindex("\n") + 1 :].rsplit("\f", 1)[-1]
            wide = 0
            for ch in pad:
                wide = wide + 1 if ch == " " else (wide // 8 + 1) * 8
            here = (wide, len(pad))
            if out and out[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                out.append("NEWLINE")
                pos.append(at)
            top = levels[-1]
            if here == top:
                continue
            if here[0] > top[0] and here[1] > top[1]:
                levels.append(here)
                out.append("INDENT")
                pos.append(at)
            elif here[0] < top[0] and here[1] < top[1]:
                while len(levels) > 1 and levels[-1][0] > here[0]:
                    levels.pop()
                    out.append("DEDENT")
                    pos.append(at)
                if levels[-1] != here:
                    out.append("ERR")
                    pos.append(at)
            else:
                out.append("ERR")
                pos.append(at)
            continue
        if kind == 3:
            c = t if t in words else "NAME"
        elif kind == 5:
            c = t
            if t in "([{":
                depth += 1
            elif t in ")]}":
                depth = max(0, depth - 1)
        else:
            c = "STR" if kind == 2 else "NUM" if kind == 4 else "ERR"
        out.append(c)
        pos.append(at)
    if out and out[-1] not in ("NEWLINE", "DEDENT"):
        out.append("NEWLINE")
        pos.append(len(text))
    out.extend("DEDENT" for _ in levels[1:])
    pos.extend(len(text) for _ in levels[1:])
    if where is not None:
        where.extend(pos)
    return out


# The quick way to the classes: strings, comments, numbers and names become marks for the whole text at once; the lines of what is left repeat so often that their tokens are looked up.

_BLOCK = r"/\*(?:[^*\n]|\*(?!/))*(?:(?P<line>\n)[\s\S]*?)?\*/"
_PREFIX = {"python": r"(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])", "c": r"(?:u8|[uUL])", "rust": r"[bc]"}
_JS_TEXT = rf"//[^\n]*|{_BLOCK}|(?=(?P<quote>[\"'`]))(?:{_DQ}|{_SQ}|{_TPL})|(?P<slash>/)(?![*/])(?:(?<=[=(,:\[!&|?{{}};\n]/)|(?<=[=(,:\[!&|?{{}};] /)|(?<=return /))(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_TEXTS = {  # strings and comments; every part begins with a fixed character
    "python": r"""#[^\n]*|\\\n|(?=(?P<quote>["']))(?:\"""(?:[^\\]|\\[\s\S])*?\"""|'''(?:[^\\]|\\[\s\S])*?'''|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')""",
    "js": _JS_TEXT,
    "ts": _JS_TEXT,
    "go": rf"//[^\n]*|{_BLOCK}|(?=(?P<quote>[\"'`]))(?:{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{{1,10}}?)')",
    "java": rf"//[^\n]*|{_BLOCK}|(?=(?P<quote>[\"']))(?:\"\"\"[\s\S]*?\"\"\"|{_DQ}|{_SQ})",
    "c": rf"//[^\n]*|{_BLOCK}|(?=(?P<quote>[\"']))(?:{_DQ}|{_SQ})|\n[ \t]*#(?:[^\n\\]|\\[\s\S])*|\\\r?\n",
    "rust": rf"//[^\n]*|{_BLOCK}|(?:br(?<!\wbr)|r(?<!\wr))(?=#{{0,2}}(?P<quote>\"))(?:\"[^\"]*\"|#\"[\s\S]*?\"#|##\"[\s\S]*?\"##)|(?=(?P<other>[\"']))(?:\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\(?:u\{{\w+\}}|x\w\w|.))')",
}
_MARKS = {"quote": r"\g<quote>\g<quote>", "other": r"\g<other>\g<other>", "slash": r"\g<slash>\g<slash>", "line": r"\g<line>"}
MOST_WORDS, MOST_LINES, WIDE = 200_000, 50_000, 400  # kept a language; then the table starts anew; wider lines are read each time


class _Words(dict):
    """What stands for a word: itself for keywords, prefixes of strings and numbers of other forms, 0 for digits, a for names."""

    def __init__(self, lang: str):
        self.kept = KEYWORDS[lang] | frozenset(_RAW.get(lang, "").split())

    def __missing__(self, word: str) -> str:
        if len(self) > MOST_WORDS:
            self.clear()
        mark = self[word] = word if word in self.kept else "0" if word.isascii() and word.isdigit() else "a" if word[0] == "_" or word[0] == "$" or word[0].isalpha() else word
        return mark


_RAW = {"python": "r R b B u U f F rb rB Rb RB br bR Br BR rf rF Rf RF fr fR Fr FR", "c": "u8 u U L", "rust": "b c r"}


@lru_cache(maxsize=None)
def _quick(lang: str) -> tuple:
    w = r"[\w$]" if lang in ("js", "ts", "java") else r"\w"
    text = re.compile(_TEXTS[lang])
    mark = "".join(m for name, m in _MARKS.items() if name in text.groupindex) + " "
    own = rf"(?:{_PREFIX[lang]})?" if lang in _PREFIX else ""
    strings = rf"{own}(?:\"\"|'')|``" + ("|//" if lang in ("js", "ts") else "")
    life = r"|('[^\W\d]\w*)" if lang == "rust" else r"|((?!))"
    _, _, name, _, number = _PARTS[lang]
    token = re.compile(rf"\s+|({strings}){life}|({name})|({number})|({_OPS[lang]})|(\w+|[\s\S])")
    return text, mark, re.compile(rf"{w}+"), _Words(lang), token


_lines: dict[str, dict[str, tuple]] = {}


def _line(lang: str, line: str, token: re.Pattern) -> tuple:
    """(classes, net depth, least depth, may stand after a line end) of a line of marks."""
    out = []
    words = KEYWORDS[lang]
    depth = least = 0
    starts = None
    for m in token.finditer(line):
        k = m.lastindex
        if k is None:
            continue
        t = m.group()
        c = "STR" if k == 1 else "LIFE" if k == 2 else "NUM" if k == 4 else t if k == 5 or (k == 3 and t in words) else "NAME" if k == 3 else "ERR"
        if k == 5 and t in "([{":
            depth += 1
        elif k == 5 and t in ")]}":
            depth -= 1
            least = min(least, depth)
        if starts is None:
            starts = (k < 5 and c not in _JS_NOT_STARTS or c in _JS_STARTS) and t != "``"
        out.append(c)
    return tuple(out), depth, least, bool(starts)


def quick_classes(lang: str, text: str) -> list[str] | None:
    """The same as ``classes`` for text without faults of its tokens and brackets; None where it can't be told."""
    strings, mark, word, marks, token = _quick(lang)
    if lang == "python":
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if text[:1] == "﻿":
            text = text[1:]
    elif lang == "c":
        text = "\n" + text
    text = word.sub(lambda m: marks[m[0]], strings.sub(mark, text))
    known = _lines.setdefault(lang, {})
    if len(known) > MOST_LINES:
        known.clear()
    if lang == "python":
        return _quick_python(text, known, token)
    out: list[str] = []
    put = out.extend
    if lang not in ("js", "ts", "go"):
        for line in text.split("\n"):
            found = known.get(line)
            if found is None:
                found = _line(lang, line, token)
                if len(line) <= WIDE:
                    known[line] = found
            put(found[0])
        return out
    go = lang == "go"
    stack: list[str] = []
    for line in text.split("\n"):
        found = known.get(line)
        if found is None:
            found = _line(lang, line, token)
            if len(line) <= WIDE:
                known[line] = found
        own, net, least, starts = found
        if not own:
            continue
        if out:
            prev = out[-1]
            if go:
                if prev in _GO_ENDS:
                    out.append(";")
            elif starts and (not stack or stack[-1] == "{") and (prev in _JS_ENDS or (prev[0].isalpha() and prev not in _JS_OPEN_ENDS)):
                out.append("NL")
        put(own)
        if not go and (net or least):
            for c in own:
                if c in _OPENING:
                    stack.append(c)
                elif c in _CLOSING:
                    if not stack:
                        return None
                    stack.pop()
    if go and out and out[-1] in _GO_ENDS:
        out.append(";")
    return out


def _quick_python(text: str, known: dict[str, tuple], token: re.Pattern) -> list[str] | None:
    out: list[str] = []
    levels = [(0, 0)]
    depth = 0
    for line in text.split("\n"):
        found = known.get(line)
        if found is None:
            bare = line.lstrip(" \t\f")
            pad = line[: len(line) - len(bare)].rsplit("\f", 1)[-1]
            wide = 0
            for ch in pad:
                wide = wide + 1 if ch == " " else (wide // 8 + 1) * 8
            found = (*_line("python", bare, token), (wide, len(pad)))
            if len(line) <= WIDE:
                known[line] = found
        own, net, least, _, here = found
        if not own:
            continue
        if not depth:
            top = levels[-1]
            if here != top:
                if here[0] > top[0] and here[1] > top[1]:
                    levels.append(here)
                    out.append("INDENT")
                elif here[0] < top[0] and here[1] < top[1]:
                    while len(levels) > 1 and levels[-1][0] > here[0]:
                        levels.pop()
                        out.append("DEDENT")
                    if levels[-1] != here:
                        return None
                else:
                    return None
        if depth + least < 0:
            return None
        out.extend(own)
        depth += net
        if not depth:
            out.append("NEWLINE")
    if depth:
        return None
    out.extend("DEDENT" for _ in levels[1:])
    return out
