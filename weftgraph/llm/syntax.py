"""Syntax check of source files by error-correcting chart parsing.

Tokens are grouped by their brackets (indentation counts as a bracket in Python); a group is stored once per distinct content, and the
chart holds, for (rule, content), whether the content derives from the rule and at what edit cost. A group's content is parsed by
the rule's automaton over tokens and inner groups, each of which is looked up in the chart in turn. Chart entries are shared by all files of a
worker, so a statement shape is parsed once, however often it occurs. Where no derivation exists, the least edits (drop, insert or replace a token) of the
statement are the shortest path over its positions and all states of the automaton, without bounds, found level by level as sets of states. Unmatched brackets are edits of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammars import GRAMMARS
from .lexers import EXTENSIONS, lex, quick_classes

_GROUP = {"p": "(", "s": "[", "b": "{", "i": "INDENT"}
_CLOSE = {"(": ")", "[": "]", "{": "}", "INDENT": "DEDENT"}
_OPENS = frozenset(_CLOSE)
_CLOSES = {v: k for k, v in _CLOSE.items()}
# 0 ends a segment, 1 opens, a bracket closes that bracket
_ROLE = {t: 0 for t in (";", "NL", "NEWLINE", ",")} | {t: 1 for t in _OPENS} | _CLOSES
FULL, HELD = 400_000, 48 << 20  # chart entries, and bytes of remembered sets of states, after which a worker starts a new chart of a language
FAR = 1 << 29  # cost of what is not reached


SMALL = 400  # states up to which a rule's automaton is made deterministic and least


class Automaton:
    """A rule as states with labelled moves and empty moves; state 0 starts, state 1 ends. Labels are token classes or (bracket, rule). Rules named within are made first and copied in; those that stay small are reduced before."""

    def __init__(self, rules: dict[str, str], rule: str, done: dict[str, Automaton]):
        self.moves: list[list[tuple[object, int]]] = []
        self.eps: list[list[int]] = []
        self.rules, self.done, self.words, self.pos = rules, done, rules[rule].split(), 0
        a, b = self._new(), self._new()
        x, y = self._alternatives()
        self.eps[a].append(x)
        self.eps[y].append(b)
        if self.pos != len(self.words):
            raise ValueError(f"rule {rule}: {self.words[max(0, self.pos - 5) : self.pos + 5]}")
        if len(self.moves) < 8 * SMALL and self._reduce():
            return
        if len(self.moves) > SMALL:
            self._fold()

    def _new(self) -> int:
        self.eps.append([])
        self.moves.append([])
        return len(self.eps) - 1

    def _alternatives(self) -> tuple[int, int]:
        a, b = self._new(), self._new()
        while True:
            x, y = self._sequence()
            self.eps[a].append(x)
            self.eps[y].append(b)
            if self.pos < len(self.words) and self.words[self.pos] == "|":
                self.pos += 1
                continue
            return a, b

    def _sequence(self) -> tuple[int, int]:
        first = last = self._new()
        while self.pos < len(self.words) and self.words[self.pos] not in ("|", ")", ")?", ")*", ")+", ")~"):
            x, y = self._one()
            self.eps[last].append(x)
            last = y
        return first, last

    def _one(self) -> tuple[int, int]:
        w = self.words[self.pos]
        self.pos += 1
        if w == "(":
            x, y = self._alternatives()
            mark = self.words[self.pos][1:]
            self.pos += 1
            if mark in ("?", "*"):
                self.eps[x].append(y)
            if mark in ("*", "+"):
                self.eps[y].append(x)
            if mark == "~":
                p, q = self._one()
                self.eps[y].append(p)
                self.eps[q].append(x)
        elif w[0] == "$" and len(w) > 1:
            inner = build(self.rules, w[1:], self.done)
            base = len(self.moves)
            self.moves.extend([(k, base + v) for k, v in m] for m in inner.moves)
            self.eps.extend([base + v for v in m] for m in inner.eps)
            x, y = base, base + 1
        else:
            x, y = self._new(), self._new()
            label = (_GROUP[w[0]], w[2:]) if len(w) > 2 and w[1] == ":" and w[0] in _GROUP else w[1:-1] if w[0] == "'" and len(w) > 2 else w
            self.moves[x].append((label, y))
        return x, y

    def closure(self, states) -> frozenset[int]:
        seen, todo, eps = set(states), list(states), self.eps
        while todo:
            for x in eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if self.moves[x] or x == 1)

    def _reduce(self) -> bool:
        sets = [self.closure([0])]
        ids = {sets[0]: 0}
        table: list[dict] = []
        for s in sets:
            by: dict[object, set[int]] = {}
            for x in s:
                for label, y in self.moves[x]:
                    by.setdefault(label, set()).add(y)
            row = {}
            for label, targets in by.items():
                c = self.closure(targets)
                if c not in ids:
                    if len(sets) > SMALL:
                        return False
                    ids[c] = len(sets)
                    sets.append(c)
                row[label] = ids[c]
            table.append(row)
        part = [int(1 in s) for s in sets]
        while True:
            keys: dict = {}
            after = [keys.setdefault((part[i], frozenset((k, part[v]) for k, v in row.items())), len(keys)) for i, row in enumerate(table)]
            if len(keys) == len(set(part)):
                break
            part = after
        number = {p: i + 2 for i, p in enumerate(dict.fromkeys(part))}
        self.moves = [[] for _ in range(len(number) + 2)]
        self.eps = [[] for _ in range(len(number) + 2)]
        self.eps[0].append(number[part[0]])
        for i, row in enumerate(table):
            at = number[part[i]]
            self.moves[at] = [(k, number[part[v]]) for k, v in row.items()]
            self.eps[at] = [1] if 1 in sets[i] else []
        return True

    def _fold(self) -> None:
        """Empty moves taken out, then states alike in all that follows made one, then those alike in all that goes before."""
        number, todo, ids = {0: 0}, [0], {}
        src, lab, dst, ends = [], [], [], []
        for x in todo:
            c = self.closure([x])
            ends.append(1 in c)
            for name, y in {m for z in c for m in self.moves[z]}:
                if y not in number:
                    number[y] = len(todo)
                    todo.append(y)
                src.append(number[x])
                lab.append(ids.setdefault(name, len(ids)))
                dst.append(number[y])
        src, lab, dst = (np.array(v, np.int64) for v in (src, lab, dst))
        end, start = np.array(ends), 0
        for back in (False, True):
            part = _alike(np.arange(len(end)) == start if back else end, *((dst, lab, src) if back else (src, lab, dst)))
            end = np.bincount(part, end) > 0
            start = int(part[start])
            labels, m = len(ids), int(part.max()) + 1
            t = _distinct((part[src] * labels + lab) * m + part[dst])
            src, lab, dst = t // (labels * m), t // m % labels, t % m
        names = list(ids)
        self.moves = [[] for _ in range(len(end) + 2)]
        self.eps = [[start + 2], []] + [[1] if e else [] for e in end.tolist()]
        for x, k, y in zip(src.tolist(), lab.tolist(), dst.tolist()):
            self.moves[x + 2].append((names[k], y + 2))


def _alike(flag: np.ndarray, src: np.ndarray, lab: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Classes of states with the same flag and the same labels into the same classes, by refinement; the sets are told apart by sums of 64-bit hashes."""
    part, n, labels = flag.astype(np.int64), len(np.unique(flag)), int(lab.max(initial=0)) + 1
    while True:
        t = _distinct((src * labels + lab) * n + part[dst])  # each move into a class once
        h = (t % (labels * n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        sums = part.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        np.add.at(sums, t // (labels * n), h)
        part = np.unique(sums, return_inverse=True)[1].reshape(-1)
        if part.max() + 1 == n:
            return part
        n = int(part.max()) + 1


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def build(rules: dict[str, str], rule: str, done: dict[str, Automaton]) -> Automaton:
    if rule not in done:
        done[rule] = Automaton(rules, rule, done)
    return done[rule]


class Dfa:
    """A rule's automaton over sets of its states, numbered as they are reached; -1 is failure."""

    def __init__(self, a: Automaton):
        self.a = a
        self.sets: list[frozenset[int]] = []
        self.ids: dict[frozenset[int], int] = {}
        self.tokens: list[dict[str, object]] = []
        self.groups: list[dict[str, list[tuple[str, frozenset[int]]]]] = []
        self.final: list[bool] = []
        self.start = self.add(a.closure([0]))

    def add(self, s: frozenset[int]) -> int:
        if not s:
            return -1
        if s not in self.ids:
            self.ids[s] = len(self.sets)
            self.sets.append(s)
            self.final.append(1 in s)
            by: dict[object, set[int]] = {}
            for x in s:
                for label, y in self.a.moves[x]:
                    by.setdefault(label, set()).add(y)
            groups: dict[str, list] = {}
            tokens: dict[str, object] = {}
            for k, v in by.items():
                if isinstance(k, str):
                    tokens[k] = v
                else:
                    groups.setdefault(k[0], []).append((k[1], self.a.closure(v)))
            self.tokens.append(tokens)
            self.groups.append(groups)
        return self.ids[s]

    def token(self, state: int, t: str) -> int:
        to = self.tokens[state].get(t, -1)
        if to.__class__ is not int:
            to = self.tokens[state][t] = self.add(self.a.closure(to))
        return to


def least_tokens(rules: dict[str, str]) -> dict[str, int]:
    """Tokens of the shortest content of each rule."""
    least = dict.fromkeys(rules, FAR) | {"Any": 0}

    def alternatives(words: list[str]) -> int:
        best = FAR
        while True:
            n = 0
            while words and words[-1] not in ("|", ")", ")?", ")*", ")+", ")~"):
                n += one(words)
            best = min(best, n)
            if not words or words[-1] != "|":
                return best
            words.pop()

    def one(words: list[str]) -> int:
        w = words.pop()
        if w == "(":
            n = alternatives(words)
            mark = words.pop()[1:]
            if mark == "~":
                one(words)
            return 0 if mark in ("?", "*") else n
        if w[0] == "$" and len(w) > 1:
            return least[w[1:]]
        return 2 + least[w[2:]] if len(w) > 2 and w[1] == ":" and w[0] in _GROUP else 1

    while True:
        now = {r: min(FAR, alternatives(text.split()[::-1])) for r, text in rules.items()} | {"Any": 0}
        if now == least:
            return least
        least = now


class Levels:
    """Sets of states by edit cost. A set is an integer of bits; what it moves to is looked up once per (set, label) and kept, so cells of one statement and of others share it."""

    def __init__(self, arcs: Arcs):
        self.a, self.n = arcs, arcs.states
        self.bytes = (self.n + 7) // 8
        self.moved: dict = {}
        self.put: dict = {}
        self.ends: dict = {}

    def held(self) -> int:
        """Bytes of the sets remembered, about."""
        return 2 * (len(self.moved) + len(self.put) + len(self.ends)) * (self.bytes + 32)

    def mask(self, states) -> int:
        v = np.zeros(8 * self.bytes, bool)
        v[list(states)] = True
        return self._int(v)

    def _int(self, v: np.ndarray) -> int:
        return int.from_bytes(np.packbits(v, bitorder="little").tobytes(), "little")

    def _bits(self, m: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(m.to_bytes(self.bytes, "little"), np.uint8), bitorder="little")

    def states(self, m: int) -> np.ndarray:
        return np.flatnonzero(self._bits(m))

    def move(self, m: int, label) -> int:
        key = (m, label)
        to = self.moved.get(key)
        if to is None:
            arcs = self.a.by.get(label)
            to = self.moved[key] = self._over(m, *arcs) if arcs else 0
        return to

    def insert(self, m: int, price: int) -> int:
        """What one token (price 1) or one group of that price put in leads to."""
        if price not in self.a.prices:
            return 0
        key = (m, price)
        to = self.put.get(key)
        if to is None:
            to = self.put[key] = self._over(m, *self.a.prices[price])
        return to

    def _over(self, m: int, src: np.ndarray, dst: np.ndarray) -> int:
        v = np.zeros(8 * self.bytes, bool)
        v[dst[self._bits(m).astype(bool)[src]]] = True
        return self._int(v)

    def grown(self, levels: list[int], m: int) -> int:
        """The states at cost ``len(levels)`` or less, from those at lower cost at the same place and ``m`` reached otherwise."""
        c = len(levels)
        if c:
            m |= levels[-1]
        for price in self.a.prices:
            if price <= c and levels[c - price]:
                m |= self.insert(levels[c - price], price)
        return m

    def finish(self, m: int) -> int:
        """Tokens to put in until the rule may end (state 1)."""
        found = self.ends.get(m)
        if found is None:
            levels = [m]
            while not levels[-1] & 2:
                levels.append(self.grown(levels, 0))
            found = self.ends[m] = len(levels) - 1
        return found


class Arcs:
    """An automaton's moves without empty ones: per label, and per price of what is put in, (from, to)."""

    def __init__(self, a: Automaton, least: dict[str, int]):
        ids: dict = {}
        src, label, dst = [], [], []
        closed: dict[int, np.ndarray] = {}
        for x, m in enumerate(a.moves):
            for name, y in m:
                c = closed.get(y)
                if c is None:
                    c = closed[y] = np.fromiter(a.closure([y]), np.int32)
                src.append(x)
                label.append(ids.setdefault(name, len(ids)))
                dst.append(c)
        n = np.fromiter(map(len, dst), np.int64, len(dst))
        src, label = np.repeat(np.array(src, np.int32), n), np.repeat(np.array(label, np.int32), n)
        dst = np.concatenate(dst) if len(dst) else np.zeros(0, np.int32)
        small = np.uint16 if len(a.moves) < 1 << 16 else np.int32
        order = np.argsort(label, kind="stable")
        cuts = np.searchsorted(label[order], np.arange(len(ids) + 1))
        self.states = len(a.moves)
        self.by = {x: (src[o].astype(small), dst[o].astype(small)) for i, x in enumerate(ids) for o in (order[cuts[i] : cuts[i + 1]],)}
        self.groups: dict[str, list[str]] = {}
        per: dict[int, list] = {}
        for x in ids:
            if not isinstance(x, str):
                self.groups.setdefault(x[0], []).append(x[1])
            price = 1 if isinstance(x, str) else 2 + least[x[1]]
            if price < FAR:
                per.setdefault(price, []).append(self.by[x])
        self.prices = {}
        for price in sorted(per):
            pairs = _distinct(np.concatenate([s.astype(np.int64) * self.states + d for s, d in per[price]]))
            self.prices[price] = ((pairs // self.states).astype(small), (pairs % self.states).astype(small))


class Chart:
    def __init__(self, lang: str, automata: dict[str, Automaton]):
        self.lang, self.automata = lang, automata
        self.dfas: dict[str, Dfa] = {}
        self.levels: dict[str, Levels] = {}
        self.inside: dict[str, list[str]] = {}
        self.clear()

    def full(self) -> bool:
        return len(self.items) + len(self.moved) > FULL or sum(e.held() for e in self.levels.values()) > HELD

    def clear(self) -> None:
        self.dfas.clear()
        self.levels.clear()
        self.ids: dict = {}
        self.items: list = []  # id -> token class, ('g', bracket, content) or tuple of ids (a segment or content)
        self.moved: dict = {}
        self.derived: dict = {}
        self.prices: dict = {}
        self.sizes: dict = {}
        self.mended: dict = {}
        self.wrong: dict = {}

    def intern(self, x) -> int:
        i = self.ids.get(x)
        if i is None:
            i = self.ids[x] = len(self.items)
            self.items.append(x)
        return i

    def dfa(self, rule: str) -> Dfa:
        if rule not in self.dfas:
            self.dfas[rule] = Dfa(self.automata[rule])
        return self.dfas[rule]

    def tree(self, tokens: list[tuple[str, int]]) -> tuple[int, list[tuple[int, str]], list]:
        """Content of the file as an id, unmatched brackets as (position, class), and where the top segments begin."""
        ids, intern = self.ids, self.intern
        stack: list = []  # (bracket, position, segments, segment)
        segs: list[int] = []
        cur: list[int] = []
        starts: list[int] = []
        begin = None
        faults: list[tuple[int, str]] = []
        for t, at in tokens:
            if not stack and begin is None:
                begin = at
            if t in _OPENS:
                stack.append((t, at, segs, cur))
                segs, cur = [], []
                continue
            if t in _CLOSES:
                want = _CLOSES[t]
                if not stack or stack[-1][0] != want:
                    k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == want), None)
                    if k is None or (want == "INDENT" and any(s[0] != "INDENT" for s in stack[k:])):
                        faults.append((at, t))  # closes nothing: dropped
                        continue
                    while len(stack) - 1 > k:  # what was opened in between is closed here
                        o, a, s0, c0 = stack.pop()
                        faults.append((a, o))
                        if cur:
                            segs.append(intern(tuple(cur)))
                        g = intern(("g", o, intern(("c", *segs))))
                        segs, cur = s0, c0
                        cur.append(g)
                if cur:
                    segs.append(intern(tuple(cur)))
                o, _, s0, c0 = stack.pop()
                g = intern(("g", o, intern(("c", *segs))))
                segs, cur = s0, c0
                cur.append(g)
                if o in ("{", "INDENT"):
                    segs.append(intern(tuple(cur)))
                    cur = []
                    if not stack:
                        starts.append(begin)
                        begin = None
                continue
            i = ids.get(t)
            cur.append(intern(t) if i is None else i)
            if t in (";", "NL", "NEWLINE", ","):
                segs.append(intern(tuple(cur)))
                cur = []
                if not stack:
                    starts.append(begin)
                    begin = None
        while stack:
            o, a, s0, c0 = stack.pop()
            faults.append((a, o))
            if cur:
                segs.append(intern(tuple(cur)))
            g = intern(("g", o, intern(("c", *segs))))
            segs, cur = s0, c0
            cur.append(g)
        if cur:
            segs.append(intern(tuple(cur)))
            starts.append(begin)
        return intern(("c", *segs)), faults, starts

    def quick(self, tokens: list[str]) -> int | None:
        """The content of a file whose brackets match; None if they don't."""
        ids, intern = self.ids, self.intern
        stack: list = []
        segs: list = ["c"]
        cur: list[int] = []
        for t in tokens:
            k = _ROLE.get(t)
            if k is None:
                i = ids.get(t)
                cur.append(intern(t) if i is None else i)
            elif k == 0:
                i = ids.get(t)
                cur.append(intern(t) if i is None else i)
                segs.append(intern(tuple(cur)))
                cur = []
            elif k == 1:
                stack.append((t, segs, cur))
                segs, cur = ["c"], []
            else:
                if not stack or stack[-1][0] != k:
                    return None
                if cur:
                    segs.append(intern(tuple(cur)))
                g = intern(("g", k, intern(tuple(segs))))
                _, segs, cur = stack.pop()
                cur.append(g)
                if k == "{" or k == "INDENT":
                    segs.append(intern(tuple(cur)))
                    cur = []
        if stack:
            return None
        if cur:
            segs.append(intern(tuple(cur)))
        return intern(tuple(segs))

    def derives(self, rule: str, content: int) -> bool:
        if rule == "Any":  # a token tree
            return not self.errors(content)
        key = (rule, content)
        found = self.derived.get(key)
        if found is None:
            d = self.dfa(rule)
            state = d.start
            for seg in self.items[content][1:]:
                state = self.over(rule, d, state, seg)
                if state < 0:
                    break
            found = self.derived[key] = state >= 0 and d.final[state]
        return found

    def over(self, rule: str, d: Dfa, state: int, seg: int) -> int:
        key = (rule, state, seg)
        to = self.moved.get(key)
        if to is None:
            to = state
            for i in self.items[seg]:
                to = self.step(d, to, i)
                if to < 0:
                    break
            self.moved[key] = to
        return to

    def step(self, d: Dfa, state: int, i: int) -> int:
        x = self.items[i]
        if x.__class__ is str:
            return d.token(state, x)
        sets = [s for rule, s in d.groups[state].get(x[1], ()) if self.derives(rule, x[2])]
        return d.add(frozenset().union(*sets)) if sets else -1

    # repair

    def size(self, i: int) -> int:
        """Tokens of an item."""
        n = self.sizes.get(i)
        if n is None:
            x = self.items[i]
            n = self.sizes[i] = 1 if x.__class__ is str else 2 + sum(self.size(k) for s in self.items[x[2]][1:] for k in self.items[s])
        return n

    def errors(self, content: int) -> int:
        """Tokens of a content, at any depth, that are none of the language."""
        n = self.wrong.get(content)
        if n is None:
            n = self.wrong[content] = sum(x == "ERR" if x.__class__ is str else self.errors(x[2]) for s in self.items[content][1:] for x in (self.items[i] for i in self.items[s]))
        return n

    def price(self, rule: str, content: int) -> int:
        """Edits that make a group's content derive from the rule, least first; statement by statement."""
        key = (rule, content)
        if key not in self.prices:
            self.prices[key] = 0 if self.derives(rule, content) else self.errors(content) if rule == "Any" else self.repair(rule, content)[0]
        return self.prices[key]

    def repair(self, rule: str, content: int) -> tuple[int, list[int]]:
        """(cost, segments with edits; the number of segments where only the end lacks something). A segment that fails from the state reached is repaired alone, at the least cost, to all states reached at that cost."""
        d = self.dfa(rule)
        state, cost, where = d.start, 0, []
        segs = self.items[content][1:]
        for k, seg in enumerate(segs):
            to = self.over(rule, d, state, seg)
            if to < 0:
                last = k == len(segs) - 1
                key = (rule, state, seg, last)
                if key not in self.mended:
                    self.mended[key] = self._mend(rule, d, state, self.items[seg], last)
                c, to = self.mended[key]
                cost += c
                where.append(k)
            state = to
        if not d.final[state]:
            e = self.edits(rule)
            cost += e.finish(e.mask(d.sets[state]))
            where.append(len(segs))
        return max(cost, 1), where

    def ends_open(self, rule: str, content: int, ended: bool) -> bool:
        """The last segment, without a line end of the lexer's own making, is the start of something valid: only what should follow is missing."""
        d = self.dfa(rule)
        state = d.start
        segs = self.items[content][1:]
        for seg in segs[:-1]:
            state = self.over(rule, d, state, seg)
            if state < 0:
                return False
        for i in self.items[segs[-1]][: -1 if ended else None] if segs else ():
            state = self.step(d, state, i)
            if state < 0:
                return False
        return True

    def rules(self, bracket: str) -> list[str]:
        """The rules that a bracket's content may follow."""
        if bracket not in self.inside:
            self.inside[bracket] = sorted({r for a in self.automata.values() for r in a.arcs.groups.get(bracket, ())})
        return self.inside[bracket]

    def edits(self, rule: str) -> Levels:
        if rule not in self.levels:
            self.levels[rule] = Levels(self.automata[rule].arcs)
        return self.levels[rule]

    def _mend(self, rule: str, d: Dfa, state: int, items: tuple, last: bool) -> tuple[int, int]:
        """(least cost, states reached at it) of a segment: level by level, the states that each place is reached in at that cost or less, until the end is reached, and after the last segment the rule may end; at the latest where all is dropped."""
        e = self.edits(rule)
        n = len(items)
        sizes = [self.size(i) for i in items]
        kinds = [self.items[i] for i in items]
        open_: list = [None] * n  # groups: rules they derive from at no cost, and prices of the others
        cells: list[list[int]] = [[] for _ in range(n + 1)]
        for c in count():
            cells[0].append(e.grown(cells[0], 0 if c else e.mask(d.sets[state])))
            for k in range(n):
                before, x, size = cells[k], kinds[k], sizes[k]
                m = before[c - size] if size <= c else 0
                now = before[c]
                if x.__class__ is str:
                    if now:
                        m |= e.move(now, x)
                    if c and before[c - 1]:
                        m |= e.insert(before[c - 1], 1)  # another token in its place
                elif now:
                    if open_[k] is None:
                        free = [r for r in e.a.groups.get(x[1], ()) if self.derives(r, x[2])]
                        open_[k] = (free, [r for r in e.a.groups.get(x[1], ()) if r not in free], {})
                    free, dear, paid = open_[k]
                    for r in free:
                        m |= e.move(now, (x[1], r))
                    for r in dear if c else ():  # priced only where one edit inside could pay
                        if r not in paid and e.move(before[c - 1], (x[1], r)):
                            paid[r] = self.price(r, x[2])
                        if paid.get(r, FAR) <= c and before[c - paid[r]]:
                            m |= e.move(before[c - paid[r]], (x[1], r))
                cells[k + 1].append(e.grown(cells[k + 1], m))
            if cells[n][c] & 2 if last else cells[n][c]:
                return max(c, 1), d.add(d.a.closure(e.states(cells[n][c]).tolist()))


@lru_cache(maxsize=None)
def automata(lang: str) -> dict[str, Automaton]:
    """The automata of the rules that groups and files are parsed by; a fixed size, made once on the driver and sent to the workers."""
    rules = GRAMMARS[lang]
    done: dict[str, Automaton] = {}
    used = {"File"} | {w[2:] for text in rules.values() for w in text.split() if len(w) > 2 and w[1] == ":" and w[0] in _GROUP}
    least = least_tokens(rules)
    for rule in sorted(used):
        a = build(rules, rule, done)
        a.arcs = Arcs(a, least)
        del a.rules, a.done, a.words
    return {rule: done[rule] for rule in used}


_charts: dict[str, Chart] = {}


def chart(lang: str, ready: dict[str, dict[str, Automaton]] | None = None) -> Chart:
    if lang not in _charts:
        _charts[lang] = Chart(lang, ready[lang] if ready else automata(lang))
    return _charts[lang]


_MATE = {"(": ")", "[": "]", "{": "}"}
_MATES = {v: k for k, v in _MATE.items()}
_TOKEN = re.compile(r"[\w$]+|[^\w\s]{1,2}(?<![()\[\]{}].)(?<!.[()\[\]{}])|[^\w\s]")
NOTHING = "\x00"  # a character of no token in any of the languages


def bracket_faults(tokens: list[tuple[str, int]], end: int) -> list[tuple[str, int, int, int]]:
    """(bracket, its token's number, its position, where it must be closed at the latest; -1 for one that closes nothing)."""
    stack: list[tuple[str, int, int]] = []
    out = []
    for i, (t, at) in enumerate(tokens):
        if t in _MATE:
            stack.append((t, i, at))
        elif t in _MATES:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == _MATES[t]), None)
            if k is None:
                out.append((t, i, at, -1))
                continue
            out.extend((*x, at) for x in stack[k + 1 :])
            del stack[k:]
    return sorted(out + [(*x, end) for x in stack], key=lambda x: x[1])


class Brackets:
    """A text whose brackets don't match, and the edits of brackets that cost least: an unclosed one is closed at the latest place, or after the last item to which one of the bracket's rules is complete, or is given to the
    repair of statements as no token, which drops or replaces it; one that closes nothing likewise, or another is put in before it or a token of its line; of two faulty ones the one is made the other's mate. One or two
    are changed at a time, until nothing gets cheaper."""

    def __init__(self, c: Chart, text: str, tokens: list[tuple[str, int]]):
        self.c, self.text, self.tokens = c, text, tokens
        self.faults = bracket_faults(tokens, len(text))
        least = (len(self.faults) + 1) // 2
        self.edits: list = [self._late(f) for f in self.faults]
        self.found = self.price(self.edits)
        changed = True
        while changed and self.found[0] > least:
            changed = False
            for at, other in self._others():
                edits = [*self.edits[:at], *other, *self.edits[at + len(other) :]]
                found = self.price(edits)
                if found[0] < self.found[0]:
                    self.edits, self.found, changed = edits, found, True
                if self.found[0] <= least:
                    return

    @staticmethod
    def _late(f) -> tuple[int, str, int]:
        """(position, what stands there, characters it stands for)."""
        return (f[2], NOTHING, 1) if f[3] < 0 else (f[3], _MATE[f[0]], 0)

    def _others(self) -> Iterator[tuple[int, list]]:
        """(number of a fault, edits for it and those that follow)."""
        tokens = self.tokens
        for n, (t, i, at, latest) in enumerate(self.faults):
            if latest >= 0:
                for p in self._complete(t, i, latest):
                    bare = len(self.text[:p].rstrip())
                    yield from ((n, [(x, _MATE[t], 0)]) for x in dict.fromkeys((bare, p)))
                    yield n, [(p, _MATE[t], self._width(p))]
                yield n, [(at, NOTHING, 1)]
            else:
                first = self.text.rfind("\n", 0, at) + 1
                for k in range(i, -1, -1):
                    if tokens[k][1] < first:
                        break
                    yield n, [(tokens[k][1], _MATES[t], 0)]
                    if k < i:
                        yield n, [(tokens[k][1], _MATES[t], self._width(tokens[k][1]))]
            if n + 1 < len(self.faults):
                other = self.faults[n + 1]
                if latest >= 0:
                    yield n, [None, (other[2], _MATE[t], 1)]
                if other[3] < 0:
                    yield n, [(at, _MATES[other[0]], 1), None]

    def _complete(self, t: str, i: int, latest: int) -> list[int]:
        """Where the content of the bracket, read by each of its rules, is last complete; latest first."""
        c = self.c
        items: list[tuple[int, int]] = []
        k = i + 1
        while k < len(self.tokens) and self.tokens[k][1] < latest:
            x, at = self.tokens[k]
            if x in _MATES:
                break
            if x in _MATE:
                depth, m = 1, k + 1
                while m < len(self.tokens) and depth:
                    depth += (self.tokens[m][0] in _MATE) - (self.tokens[m][0] in _MATES)
                    m += 1
                whole = c.quick([y for y, _ in self.tokens[k:m]])
                if depth or whole is None:
                    break
                items.append((c.items[c.items[whole][1]][0], at))
                k = m
                continue
            items.append((c.intern(x), at))
            k += 1
        ends = [at for _, at in items] + [self.tokens[k][1] if k < len(self.tokens) else len(self.text)]
        out = set()
        for rule in c.rules(t):
            if rule == "Any":
                continue
            d = c.dfa(rule)
            state, last = d.start, 0 if d.final[d.start] else -1
            for n, (x, _) in enumerate(items, 1):
                state = c.step(d, state, x)
                if state < 0:
                    break
                if d.final[state]:
                    last = n
            if last >= 0:
                out.add(ends[last])
        return sorted((p for p in out if p < latest), reverse=True)

    def _width(self, at: int) -> int:
        """Characters of the token at a position."""
        m = _TOKEN.match(self.text, at)
        return m.end() - at if m else 0

    def mended(self, edits: list) -> str:
        parts, at = [], 0
        for p, _, n, x in sorted((e[0], -i, e[2], e[1]) for i, e in enumerate(edits) if e):  # what was opened last is closed first
            parts.append(self.text[at:p])
            parts.append(x)
            at = p + n
        return "".join(parts) + self.text[at:]

    def price(self, edits: list) -> tuple:
        """(cost, edited segments, segments' starts, tokens, positions of bracket edits) with the edits made; positions in the text as it was. What became no token is paid for by the repair."""
        c = self.c
        tokens = lex(c.lang, self.mended(edits)) if edits else self.tokens
        content, faults, starts = c.tree(tokens)
        cost, where = sum(e is not None and e[1] != NOTHING for e in edits) + len(faults), []
        if not c.derives("File", content):
            more, where = c.repair("File", content)
            cost += more
        put_in = sorted(e[0] for e in edits if e and not e[2])
        back = lambda at: at - sum(p + k < at for k, p in enumerate(put_in))
        return cost, where, [back(x) for x in starts], tokens, [e[0] for e in edits if e] + [back(at) for at, _ in faults]


def check_source(text: str, lang: str, ready: dict[str, dict[str, Automaton]] | None = None) -> tuple[int, str, int]:
    """(edit cost, kind of fault, line of the first edit); (0, '', 0) for valid source. Empty source is valid.

    The kind follows from where the edits lie: on a line of a merge conflict; all over the file (mismatch); nowhere but at its end (truncation); at characters of no token; else local.
    """
    c = chart(lang, ready)
    if c.full():
        c.clear()
    found = quick_classes(lang, text)
    content = c.quick(found) if found is not None else None
    if content is not None and c.derives("File", content):
        return 0, "", 0
    if lang == "python":
        text = text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("\ufeff")
    b = Brackets(c, text, lex(lang, text))
    cost, where, starts, tokens, spots = b.found
    segs, end = max(1, len(starts)), len(text)
    spans = [(starts[k], starts[k + 1] if k + 1 < len(starts) else end) if k < len(starts) else (end, end) for k in where]
    last = starts[-1] if starts else 0
    first = min([*spots, *(a for a, _ in spans)], default=0)
    marks = [at for at in _line_starts(text) if text.startswith(_CONFLICT, at)]
    late = all(x == len(text) for x in spots) and all(k >= len(starts) - 1 for k in where) and (not where or bool(spots) or where == [len(starts)] or c.ends_open("File", c.tree(tokens)[0], tokens[-1][0] == "NEWLINE" or (lang == "go" and not text.startswith(";", tokens[-1][1]))))
    if any(text.startswith(("<", ">"), at) for at in marks) and any(a <= at < z for at in marks for a, z in [*spans, *((x, x + 1) for x in spots)]):
        kind = "conflict"
    elif len(where) > 2 and len(where) > 0.4 * segs or cost > 0.15 * len(tokens) + 3:
        kind = "mismatch"
    elif late:
        kind, first = "truncation", max(first, last) if not spots else end
    elif any(t == "ERR" for t, _ in b.tokens):
        kind = "characters"
    else:
        kind = "local"
    return max(cost, 1), kind, text.count("\n", 0, first) + 1


_CONFLICT = ("<<<<<<<", "=======", ">>>>>>>", "|||||||")


def _line_starts(text: str) -> Iterator[int]:
    at = 0
    while at >= 0:
        yield at
        at = text.find("\n", at) + 1 or -1


def language_of(path: str) -> str | None:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None


def newest_files(docs: DataFrame) -> DataFrame:
    """The code files' newest versions: source_path, repo, markdown. Only the rows' keys are ranked first, so older texts are not shuffled further than once per file."""
    code = docs.where(F.col("source_path").isNotNull() & F.lower(F.regexp_extract("source_path", r"\.(\w+)$", 1)).isin(*EXTENSIONS))
    rank = F.struct("converted_at", "loaded_at", F.xxhash64("markdown").alias("tie"))
    repo = F.coalesce("repo", F.split_part("source_path", F.lit("/"), F.lit(1)))
    return code.select("source_path", repo.alias("repo"), "markdown", rank.alias("rank")).groupBy("source_path").agg(F.max_by(F.struct("repo", "markdown"), "rank").alias("x")).select("source_path", "x.repo", "x.markdown")


def check_files(docs: DataFrame) -> DataFrame:
    """(source_path, repo, language, edit_cost, fault, line): one row per code file, over the text of its newest version.

    Newest is the latest converted_at (NULL is earliest; ties go to the latest loaded_at, then by hash). A NULL or empty text is valid. Rows with a NULL source_path or
    another extension are no code files. A NULL repo is the first part of the path. Repeated rows count once; no rows give no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast({lang: automata(lang) for lang in GRAMMARS})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, repo, text in zip(f["source_path"], f["repo"], f["markdown"]):
                lang = language_of(path)
                rows.append((path, repo, lang, *(check_source(text, lang, shared.value) if text else (0, "", 0))))
            yield pd.DataFrame(rows, columns=["source_path", "repo", "language", "edit_cost", "fault", "line"])

    return newest_files(docs).mapInPandas(run, "source_path string, repo string, language string, edit_cost int, fault string, line int")


def fault_rates(checked: DataFrame) -> DataFrame:
    """Files and invalid files per repository and language; NULL in either stands for all."""
    bad = F.col("edit_cost") > 0
    return checked.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if(bad).alias("invalid"), F.count_if(F.col("fault") == "truncation").alias("truncated"), F.count_if(F.col("fault") == "conflict").alias("conflicts"), F.count_if(F.col("fault") == "mismatch").alias("mismatches")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
