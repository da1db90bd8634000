"""Labelled spans for training: invented lines with marked personal information, and lines that only look like it."""

from __future__ import annotations

import random

KINDS = ("email", "phone", "identity", "address", "name")

_NOUNS = "cache ledger token queue index parser module worker batch schema cursor router shard layer stage signal registry buffer widget panel".split()
_VERBS = "load store merge drain fetch build parse open close split verify render walk sync".split()
_CAPS = "Cold Warm Lazy Stale Shared Local Remote Nested Partial Signed Frozen".split()
_SMALL = "are was that when where which each nothing else touches keeps reads path lists plan wider local names files lines edges calls users tests docs race cleanup reference memory caller owner release before after only whole branch line error table group time data text page item".split()
_ROLES = "Manager Broker Notes Service Handler Factory Builder Monitor Runner Guide Center Index Lane Board Report".split()
_ADJ = "Session Release Profile Worker Build Error Test Cache Project Design Status Type Event Code Data".split()
_HOSTS = "willow ashgate riverton mail.oakfield corp.thornby mx1.pinewood-it eu.ops.redhill post.brook".split()
_TLDS = "example test invalid example.com example.org example.net com org io".split()
_SERVICE = "git noreply no-reply support admin root postmaster security builds ci-bot info hello team webmaster".split()
_STREETS = "Alder Birch Cedar Elm Foxglove Heron Ivy Juniper Larch Maple Nettle Oak Plum Quince Rowan Thistle Willow Mill Church Station Garden Harbour Kingfisher Sandpiper Bramble Coppice".split()
_WAYS = "Street St. Road Rd Lane Close Avenue Ave. Terrace Drive Court Place Way Square Crescent".split()
_SYL = "ba be bri ca cor da del dro e el far fen ga gor ha hes i il jo ka ker la lin mar mo na nor o or pe quil ra ro sa sil ta ti tor u ul va ve wen xan y za zo".split()
_END = "n r s th lt nd rn ck wick brand mond field man ton gard croft hold son well dale moor brandt ström".split()

_PLAIN = (
    "The {n} index is rebuilt whenever the {n} changes size.", "`{f}` gives up after {d} tries and {dd} ms.", "Tests cover {d} of the {ddd} branches in {p}.",
    "See {p}.{f} for the slow path.", "{C} inherits its {n} logic from {C}.", "Docs for the {n} were out of date since release {d}.{ddd}.",
    "Reverting {hex} makes the {n} count drop from {ddd} to {d}.", "Error at 0x{hexx}: see {A} {R}.", "Bound to 10.{dd}.{dd}.{dd}:{dddd}.",
    "Order of {dd} {A} {W} tasks.", "Order of {dd} {A} Lane tasks.", "Build {y}.{dd}.{dddd} took {dddd} {dddd} ms.", "Trace id {dddd}-{dd}-{dddd} shows up twice.", "Checksum {d13} did not match.",
    "Sizes 1024-2048-4096 all fail.", "Timestamp {d11} is in the future.", "Pinned {n}@{d}.{d}.{d} and {n}-{n}@^{d}.{d}.", "The @{n}_property on {C} is wrong.",
    "Decorator `@app.{n}` hides {f}.", "Clone with {svc}@{n}.{tld}:team/{n}.git first.", "Write to {svc}@{host}.{tld} for access.", "See {C} {R} and {A} {R} for details.",
    "Street names in the {n} fixture are invented.", "{A} {R}: the {n} is {n}.", '  {n}.{f}({ddd}, "{n} {n}");', "  const {n}_{dd} = {f}({n}, {ddd});", "    if {n} > {ddd}:", 'File "{p}.py", line {ddd}, in {f}',
    "Die Änderung {hex} verdoppelt die Laufzeit von {p}.", "Ohne Sperre läuft {f} gegen das Aufräumen.", "In {p} hält die Klasse {C} noch einen Verweis.", "Nach {ddd} Versuchen bricht `{f}` ab.",
    "Après {dd} essais, `{f}` abandonne sans message.", "La révision {hex} casse le chargement.", "Tras {ddd} intentos, `{f}` se rinde.", "Faltan pruebas para {C} en este caso.", "La revisión {hex} rompe la carga.",
    "Why does {p} import {C} at module level?", "The tour stops at `{f}`, then follows its callers.", "# {C} {n}", "- Renamed {C} to make room for a {n}.", "Node {C} sits in {ddd} edges.", "Version v{d}.{dd}.{d}-rc{d}, id {hex}-{dddd}.", "{n}@{hex} is the last good one at {p}.", "Issue #{dddd} from {y}-0{d}-{dd} 1{d}:{dd}:{dd}.",
)
_WITH = (
    "{name} wrote:", "Thanks to {name} for tracing {f}.", "cc {name}, on call today ({phone}).", "Mr {name} reported it by phone (tel:{phone}).", "As Dr. {name} said in review, {f} is slow.", "# author: {name}", "@author {name}, {email}",
    "Signed-off-by: {name} <{email}>", "Reviewed-by: {name} <{email}>", "Contact: {name}\n{address}\nTel. {phone}", "Ship the board to {name}, {address}.", "Bitte an {name}, {address} wenden.", "Écrire à {name} ({email}).", "Preguntar a {name}, tel. {phone}.",
    'The user record was {{"name": "{name}", "email": "{email}", "phone": "{phone}"}}', "| {name} | {email} | {phone} |", "Sample row: {name};{address};{phone};{id}", "Please remove {label} {id} from the test data.", "The fixture still has the {label} {id} of {name}.",
    "DEBUG payload {label}={id} addr='{address}'", "> I moved to {address}, so update the file.", "My number is {phone}, call before noon.", "log: login failed for {email} from worker {d}", "curl -d 'who={email}&doc={id}' /api/{f}", "mailto:{email}?subject=patch",
    "Ping {email} if {f} breaks", "Ping me at {email} if {f} breaks.", "traceback: KeyError: '{email}' in {f}", '"email": "{email}", "phone": "{phone}"', 'user record was {{"name": "{name}", "email": "{email}"}}', "Preguntar a {name}, tel. {phone}.", "Mr {name} reported it by phone (tel:{phone}).", "module level?  {name} wrote:\n> I moved to {address}.", "Dr {name} and Ms {name} met Herr {name}.", "Écrire à {name} ({email}).", "> I moved to {address}, so update the CODEOWNERS file.", "Bitte {name} ({email}) fragen.", "Mail from {email} about `{f}`.", "assigned to '{email}'", "{name} and {name} agreed.", "Call {phone} or write to {email}.", "Frau {name} wohnt in {address}.", "Mme {name}, {address}", "Send it to {name}", "{name}", "{address}", "{label}: {id}", "owner = \"{email}\"",
)
# Frames of sentences, code and logs without personal information; {w} is any invented or listed word, {W} the same with a capital, {WW} two or three of these joined.
_FRAMES = (
    "The {w} {w} {w} is {w} after the {w} {w}.", "{W} of {w} {w}: {d} files, {ddd} symbols, depth {d}.", "In {w}/{w} the {w} keeps a {w} to the {w} {w}, so {w} {w} slowly.", "Edges of type {U} into {w}/{w} {w} this {w}.", "Node {WW} sits in {dd} hyperedges, most of them {U}.", "Benchmarks: {ddd} ops before, {dddd} after, same {w}.",
    "# {WW} {w}", "## {W} {W} {w}", "- {W} the {w} {w} of {f}", "Chunk {d} of {w} is {w}.", "Search ranks {w}/{w} first although {WW} is the real owner.", "`{f}` now accepts a timeout of {ddd} ms and gives up after {d} tries.", "{WW} {w} its {w} logic from a base that nobody {w}.", "Without the {w} a {w} {w} reaches `{f}` and raises in line {ddd}.",
    "The summary names {WW}, {f} and {ddd} key {w}.", "{WW} {w} its {w}. {W} {w} a {w}.", "en {w}/{w} el {w} guarda una referencia a {WW}. {W} {w} a `{f}`.", "Die Tests für {WW} {w}. {W} {w}.", "Why does {w}/{w} import {WW} at module level?", "{W} chain goes from {WW} through {f}.", "func ({w} *{WW}) {W}({w} {WW}, n int) {", "async {cc}({w}: {WW}, n: number): {WW} {", "so update the {UU} file.", "{UU} {w} {w}", "# {UU}", "Bitte vor dem {W} die {W} für {WW} ergänzen.", "Les tests de {WW} ne couvrent pas ce cas.", "The @{w}_{w} on {WW} is wrong.", "{W}{w} {w} the {W}.", "Chunk {d} of {w}/{w} is indexed.",
    "  const {w}_{dd}: number = {cc}({w}, {ddd});", "let {w}_{d}: {w} = {cc}({w}, {ddd}); // {w} {W}", "const {w}_{dd} = {cc}({w}, {dd});", "    {w} {w} = {w}.{cc}({w}, {ddd}, {d});", "    }}\n  {w}.{cc}({ddd}, \"{w} {w}\");", "Why does it import {WW} at module level? {W} {w}.", "Nothing else in {w}/{w} touches the {w}.", "{W}, {W} {w} {w}: {w}", "  for (const {w} of {cc}({w})) {", "export function {cc}({w}: {WW}, n: number): number {",
    "Fixed in {W} {W} {d}.{dd}, see {W} {W}.", "{W} {W} and {W} {W} are {w} here.", "{W}: {W} {W} {w}", "The {W} {W} page of {w} lists {dd} {W} {W} items.", "Order of {dd} {A} {W} {w}.", "Order of {dd} {A} {X} tasks.", "{dd} {W} {X} rows in {w}", "Le {w} {w} de {f} ne {w} pas le {w}.", "Il faut déplacer {f} hors de la {w} du {w}.", "El {w} de {w} no {w} la {w} {w}.", "Der {w} in {w}/{w} {w} die {W} {W}.", "{W} {W} prüft {w} und {W}.",
    "func {W}(ctx *{WW}, n int) (int, error) {", "function {cc}({w}, opts) {", "const {w}_{dd}: {WW}<{W}> = {cc}({w}, {ddd});", "  if ({w}.{cc}({d}) > {ddd}) { return null; }", "\t{w}_{d} := {cc}({w}, {ddd})", "    {w} = self.{f}({w}=\"{w} {w}\", {w}={d})", "public static void {cc}({WW} {w}, int {w}) {", "let mut {w}: Vec<{WW}> = {cc}(&{w}, {d});", "class {WW}({WW}):", "import { {WW}, {cc} } from './{w}/{w}';", "from {w}.{w} import {WW} as {W}", "  {w}.{cc}(\"{w} {w}\", {ddd});", "return {w} / {dd}.{d} + {w}[{d}];", "#include <{w}/{w}.h>", "static const char *{w}[] = {\"{W} {W}\", \"{w}\"};", "assert {f}({d}, {w}=[{d}, {dd}, {ddd}]) == '{WW}'", "// {W} the {w} when {w} is {w}", "/* {W} {W}: {w} {w} */", "@{w}.{w}(\"/{w}/<int:{w}>\")", "@{w}_{w}", "  \"{w}\": {\"{w}\": {ddd}, \"{w}_{w}\": \"{W} {W}\"},",
    "{y}-0{d}-{dd}T{dd}:{dd}:{dd}Z {U} {w}: {w} {w} took {ddd} ms", "{y}/{d}/{dd} {dd}:{dd} [{w}-{d}] {U} {w}={hex}", "  at {w}.{WW}.{cc}({WW}.java:{ddd})", "Traceback (most recent call last):", "  File \"/{w}/{w}/{f}.py\", line {ddd}, in {f}", "{WW}Error: {w} {d} of {dd}", "diff --git a/{w}/{w}.go b/{w}/{w}.go", "@@ -{dd},{d} +{dd},{d} @@ func {W}({w})", "+    {w}: {d}.{d}.{dd}", "| {w} | {ddd} | {WW} | {d}.{dd} |", "https://{w}.example/{w}/{w}?{w}={ddd}&{w}={hex}", "git clone {svc}@{w}.example:{w}/{w}.git", "scp {svc}@{w}:{w}/{w} .", "npm i {w}@{d}.{dd}.{d} @{w}/{w}@{d}", "{hex}{hexx} {w}/{w}.c", "id: {hex}-{dddd}-{dddd}-{dddd}-{hexx}{dd}", "ISBN {ddd}-{d}-{dddd}-{dddd}-{d}", "range {ddd}-{dddd}, step {dd}-{dd}-{dddd}x", "{dddd}-{dddd}-{dddd} bytes", "{d}{dddd}{dddd}{dddd} ns", "port {dddd}, pid {dddd}{d}, uid {dddd}{dddd}{dd}", "v{d}.{d}.{d} {d}.{dd}.{dddd} {d}.{d}.{d}-rc.{d}", "10.{dd}.{ddd}.{d}/{dd} via 192.168.{d}.{dd}", "0x{hexx} {ddd}% {dd}/{dd} {d}e-{d} {dd}:{dd}",
    "Co-authored by the {W} {W} team", "cc the {w} {W} on call", "Thanks to everybody for {w}.", "Ping me if {f} breaks.", "Contact the {W} {W} {w}.", "Call {f} or write to the {w}.", "Please remove the {w} {w} from the test data.", "author: {w}-bot", "Reviewed-by: {w} {w}", "Signed off in {W} {y}.", "My {w} is {ddd}.", "I moved to {w} {W}, so update the {w}.", "{W} street, {W} road and {w} lane are layers.", "Tel. means {w} here.", "addr={hexx} phone={d} id={ddd}", "mail to {svc}@{host}.{tld}", "from {svc}@{host}.{tld} to {svc}+{w}@{host}.{tld}",
)
_LABELS = "SSN,social security number,NI number,NINO,DNI,passport no.,passport number,Personalausweis,national insurance number".split(",")


class Maker:
    """Makes labelled texts from the given name parts; without any, from invented ones."""

    def __init__(self, given: list[str], family: list[str], seed: int):
        self.r = random.Random(seed)
        self.given, self.family = given or self._parts(60), family or self._parts(60)

    def _parts(self, n: int) -> list[str]:
        out: dict[str, None] = {}
        while len(out) < n:
            w = self._word().capitalize()
            if len(w) > 3:
                out[w if len(out) % 9 else f"{w}-{self._word().capitalize()}a"] = None
        return list(out)

    def _word(self) -> str:
        r = self.r
        return "".join(r.choice(_SYL) for _ in range(r.randint(1, 3))) + r.choice(["", r.choice(_END), r.choice("aeio")])

    def _part(self, known: list[str]) -> str:
        r = self.r
        if known and r.random() < 0.5:
            return r.choice(known)
        w = self._word().capitalize()
        w = w if len(w) > 2 else w + "den"
        x = r.random()
        if x < 0.05:
            w = "O'" + w
        elif x < 0.12:
            w = w + "-" + self._word().capitalize() + "a"
        if r.random() < 0.08:
            w = w.replace("a", r.choice("äáà"), 1).replace("o", r.choice("öóo"), 1).replace("n", r.choice("nnñ"), 1)
        return w

    def name(self) -> str:
        r = self.r
        g, f = self._part(self.given), self._part(self.family)
        if r.random() < 0.06:
            f = r.choice(["van ", "von ", "de ", "van der "]) + f
        x = r.random()
        if x < 0.2:
            g = g[0] + "."
        elif x < 0.35:
            g += f" {r.choice('ABCDEFGHJKLMNPRST')}."
        out = f"{f}, {g}" if r.random() < 0.13 and g[-1] != "." else f"{g} {f}"
        return out.upper() if r.random() < 0.08 else out

    def email(self) -> str:
        r = self.r
        g, f = (self._part(k).lower().replace("'", "").replace("-", "") for k in (self.given, self.family))
        local = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{g}{r.randint(1, 99)}", f"{g}+ci", f"{f}-{g}", f"{g}_{f}{r.randint(1, 99)}", f"{g[0]}.{f}+patch", f"{g}.{f}"])
        host = f"{r.choice(_HOSTS)}.{r.choice(_TLDS)}"
        x = r.random()
        if x < 0.6:
            out = f"{local}@{host}"
        elif x < 0.84:
            at, dot = r.choice([(" [at] ", " [dot] "), (" AT ", " DOT "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", "."), (" [at] ", "."), (" at ", ".")])
            out = local + at + host.replace(".", dot)
        else:
            out = local + r.choice(["%40", "&#64;", "&#x40;", "&commat;", "\\u0040"]) + host
        return out.upper() if r.random() < 0.08 and "&" not in out and "%" not in out else out

    def phone(self) -> str:
        d = lambda n: "".join(self.r.choice("0123456789") for _ in range(n))
        us = f"{self.r.randint(200, 999)}"
        return self.r.choice([f"({us}) {d(3)}-{d(4)}", f"{us}-{d(3)}-{d(4)}", f"{us}.{d(3)}.{d(4)}", f"+1-{us}-{d(3)}-{d(4)}", f"+1{us}{d(7)}", f"{us}-{d(3)}-{d(4)} ext. {d(3)}", f"+44 (0){d(4)} {d(6)}", f"0044 {d(4)} {d(3)} {d(3)}", f"020 {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 {d(2)} {d(5)} {d(3)}", f"0{d(2)}/{d(8)}", f"+34 {d(3)} {d(3)} {d(3)}"])

    def id(self) -> str:
        d = lambda n: "".join(self.r.choice("0123456789") for _ in range(n))
        a = self.r.choice
        return a([f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"9{d(8)}", f"QQ {d(2)} {d(2)} {d(2)} {a('ABCD')}", f"QQ{d(6)}{a('ABCD')}", f"{d(8)}{a('TRWAGMYFPDXBNJZSQVHLCKE')}", f"{d(8)}-{a('TRWAGMYFPDXBNJZSQVHLCKE')}", f"X{a('ABCDEFGH')}{d(7)}"])

    def address(self) -> str:
        r = self.r
        s = r.choice(_STREETS) if r.random() < 0.7 else self._word().capitalize() + r.choice(["ley", "by", "moor", "field"])
        n = str(r.randint(1, 240)) + (r.choice("abc") if r.random() < 0.2 else "")
        x = r.random()
        if x < 0.5:
            out = f"{n} {r.choice(['', '', '', 'Old ', 'North ', 'Upper ', 'W. '])}{s} {r.choice(_WAYS)}"
            return out.upper() if r.random() < 0.15 else out
        if x < 0.68:
            return f"{s}{r.choice(['straße', 'weg', 'gasse', 'str.', 'platz', 'allee'])} {n[:-1] + ' ' + n[-1] if n[-1].isalpha() and r.random() < 0.5 else n}"
        if x < 0.84:
            return f"{r.choice(['Calle', 'Plaza de', 'Avenida de', 'Paseo'])} {s}{r.choice([' ', ', '])}{n}"
        return f"{n}{r.choice(['', ' bis', ' ter'])}{r.choice([' ', ', '])}{r.choice(['rue du', 'rue de la', 'chemin des', 'avenue du', 'place de'])} {s}"

    def _fill(self, template: str) -> list[tuple[str, str]]:
        """(text, kind or '') parts of a filled template."""
        r, out, i = self.r, [], 0
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        f = lambda: f"{r.choice(_VERBS)}_{r.choice(_NOUNS)}"
        plain = {
            "n": lambda: r.choice(_NOUNS), "f": f, "p": lambda: f"{r.choice(_NOUNS)}/{r.choice(_NOUNS)}", "C": lambda: r.choice(_CAPS) + r.choice(_NOUNS).capitalize(), "A": lambda: r.choice(_ADJ), "R": lambda: r.choice(_ROLES), "W": lambda: r.choice(_WAYS),
            "w": lambda: r.choice(r.choice((_NOUNS, _VERBS, _SMALL))) if r.random() < 0.7 else self._word(), "W": lambda: (r.choice(r.choice((_ADJ, _ROLES, _CAPS))) if r.random() < 0.6 else r.choice(r.choice((_NOUNS, _VERBS, _SMALL))).capitalize()), "X": lambda: r.choice(_WAYS).rstrip("."), "U": lambda: r.choice(("CALLS", "IMPORTS", "DEFINES", "INFO", "WARN", "ERROR", "DEBUG", "TODO", "INHERITS")),
            "WW": lambda: "".join((r.choice(r.choice((_CAPS, _ADJ, _NOUNS, _SMALL, _VERBS))) if r.random() < 0.7 else self._word()).capitalize() for _ in range(r.choice((2, 2, 2, 3)))), "UU": lambda: (r.choice(("CODEOWNERS", "README", "LICENSE", "CHANGELOG", "MAKEFILE")) if r.random() < 0.3 else (self._word() + r.choice(_SMALL)).upper()), "cc": lambda: r.choice(_VERBS) + r.choice(_NOUNS).capitalize() + (r.choice(_NOUNS).capitalize() if r.random() < 0.3 else ""),
            "svc": lambda: r.choice(_SERVICE), "host": lambda: r.choice(_HOSTS), "tld": lambda: r.choice(_TLDS), "y": lambda: str(r.randint(2015, 2030)), "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(7)), "hexx": lambda: "".join(r.choice("0123456789abcdef") for _ in range(10)), "label": lambda: r.choice(_LABELS), "d13": lambda: d(13), "d11": lambda: d(11),
        }
        kinds = {"name": "name", "email": "email", "phone": "phone", "id": "identity", "address": "address"}
        while i < len(template):
            j = template.find("{", i)
            if j < 0:
                out.append((template[i:], ""))
                break
            out.append((template[i:j], ""))
            if template[j : j + 2] == "{{" or not template[j + 1 : j + 2].isalpha():
                out.append(("{", ""))
                i = j + (2 if template[j : j + 2] == "{{" else 1)
                continue
            k = template.index("}", j)
            key = template[j + 1 : k]
            out.append((getattr(self, key)(), kinds[key]) if key in kinds else (plain[key]() if key in plain else d(len(key)), ""))
            i = k + 1
        return [(t.replace("}}", "}") if not k else t, k) for t, k in out]

    def text(self, length: int) -> tuple[str, list[str]]:
        """At least ``length`` characters and a tag for each: 'O', 'B-kind' or 'I-kind'."""
        r = self.r
        chars: list[str] = []
        tags: list[str] = []
        while len(chars) < length:
            x = r.random()
            for t, k in self._fill(r.choice(_WITH if x < 0.34 else _PLAIN if x < 0.6 else _FRAMES)) + [(r.choice([" ", " ", "\n", "\n\n", "  "]), "")]:
                chars.extend(t)
                tags.extend((f"B-{k}" if i == 0 else f"I-{k}") if k else "O" for i in range(len(t)))
        return "".join(chars[:length]), tags[:length]
