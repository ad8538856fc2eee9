"""Secret scanning with one deterministic automaton for all rules.

Every rule's expression goes through Thompson and subset construction, leftmost match first; the
rules' automata are then run as one (the reachable part of their product), which Moore's algorithm
minimises into transition arrays over byte classes. Every text is walked once, byte by byte, many
stretches side by side in numpy. For each byte the automaton writes which rules accept there, and
which rules' match has begun how many bytes ago; starts, ends and lengths are read off these marks.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, table, utf8

#: name, expression, group whose length counts, least length. The first three are the base kinds.
RULES: tuple[tuple[str, bytes, int, int], ...] = (
    ("assign", rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", rb"AKIA[A-Z0-9]+", 0, 16),
    ("hex", rb"[0-9a-f]+", 0, 32),
    ("github", rb"gh[oprsu]_[A-Za-z0-9]+", 0, 24),
    ("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google", rb"AIza[A-Za-z0-9_-]+", 0, 39),
    ("stripe", rb"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    ("jwt", rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("pem", rb"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", 0, 0),
)

class Nfa:
    """Thompson construction for a small expression language over bytes:
    literals, ``\\x20``, escaped bytes, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{n}``."""

    def __init__(self) -> None:
        self.arcs: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return frozenset(states)

    def moved(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closed({t for s in states for chars, t in self.arcs[s] if byte in chars})

    def loops(self) -> frozenset[int]:
        """States with an arc from which a way leads back to them."""

        def after(state: int) -> set[int]:
            seen: set[int] = set()
            todo = [state]
            while todo:
                for t in self.closed({x for _, x in self.arcs[todo.pop()]}):
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return seen

        return frozenset(s for s in range(len(self.arcs)) if self.arcs[s] and s in after(s))

    def add(self, expression: bytes) -> tuple[int, int]:
        self.text, self.at = expression, 0
        ends = self.choice()
        assert self.at == len(expression), expression[self.at :]
        return ends

    def choice(self) -> tuple[int, int]:
        first, last = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.free[first].append(a)
            self.free[b].append(last)
            if self.text[self.at : self.at + 1] != b"|":
                return first, last
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self.at < len(self.text) and self.text[self.at] not in b"|)":
            begin = self.at
            a, b = self.atom()
            mark = self.text[self.at : self.at + 1]
            if mark in (b"?", b"*", b"+"):
                self.at += 1
                end = self.state()
                self.free[b].append(end)
                if mark in b"?*":
                    self.free[a].append(end)
                if mark in b"*+":
                    self.free[b].append(a)
                b = end
            elif mark == b"{":
                close = self.text.index(b"}", self.at)
                times, after = int(self.text[self.at + 1 : close]), close + 1
                for _ in range(times - 1):
                    self.at = begin
                    c, d = self.atom()
                    self.free[b].append(c)
                    b = d
                self.at = after
            self.free[last].append(a)
            last = b
        return first, last

    def atom(self) -> tuple[int, int]:
        if self.text[self.at] == 40:
            self.at += 1
            ends = self.choice()
            self.at += 1
            return ends
        a, b = self.state(), self.state()
        self.arcs[a].append((frozenset(self.bytes_of()), b))
        return a, b

    def one(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == 92:
            c = self.text[self.at]
            self.at += 1
            if c == 120:
                c = int(self.text[self.at : self.at + 2], 16)
                self.at += 2
        return c

    def bytes_of(self) -> set[int]:
        if self.text[self.at] != 91:
            return {self.one()}
        self.at += 1
        found: set[int] = set()
        while self.text[self.at] != 93:
            a = self.one()
            if self.text[self.at] == 45 and self.text[self.at + 1] != 93:
                self.at += 1
                found |= set(range(a, self.one() + 1))
            else:
                found.add(a)
        self.at += 1
        return found


@dataclass
class Leftmost:
    """One rule's automaton. ``step[state][byte class]``; ``accepts``: a match may end with this byte;
    ``begins``: above 0, how many bytes ago the match began, told once, where it enters a loop."""

    step: list[list[int]]
    accepts: list[bool]
    begins: list[int]

    @classmethod
    def build(cls, expression: bytes, sample: list[int]) -> Leftmost:
        """A state is the row of matches under way, oldest first: the age of each (None once it has
        entered a loop) and its states. A younger one that could only go on as an older one does is
        left out, and all are once an older one accepts: the leftmost match wins and is as long as
        can be. Raises ValueError for rules whose starts can't be told this way.
        """
        nfa = Nfa()
        begin, end = nfa.add(expression)
        loops = nfa.loops()
        fresh = nfa.closed({begin})
        known: dict[tuple, int] = {((), 0): 0}
        order: list[tuple] = [((), 0)]
        rows = []
        for threads, _ in order:  # grows while it is read
            row, matching = [], bool(threads) and end in threads[0][1]
            for byte in sample:
                seen: set[int] = set()
                now: list[tuple[int | None, frozenset[int], int]] = []
                for i, (age, states) in enumerate(threads[:1] if matching else threads):
                    to = nfa.moved(states, byte) - seen
                    if to:
                        seen |= to
                        now.append((None if age is None else age + 1, to, i))
                if matching and now and end not in now[0][1]:
                    raise ValueError(f"a match must end where it can't go on: {expression!r}")
                if not (matching and now):
                    to = nfa.moved(fresh, byte) - seen
                    if to:
                        now.append((1, to, -1))
                if now and now[0][0] is None and now[0][2] != 0:
                    raise ValueError(f"a later start outlives an earlier one: {expression!r}")
                told = now[0][0] if now and now[0][0] is not None and now[0][1] & loops else 0
                if now and now[0][0] is not None and not told and end in now[0][1]:
                    told = now[0][0]
                key = (tuple((None if states & loops else age, states) for age, states, _ in now), told)
                if key not in known:
                    known[key] = len(order)
                    order.append(key)
                row.append(known[key])
            rows.append(row)
        return cls(rows, [bool(t) and end in t[0][1] for t, _ in order], [told for _, told in order])


@dataclass
class Automaton:
    """``step[state * classes + kind[byte]]``: the next state times ``classes``, with the mark that the
    byte gets in ``mark[state]``. ``accepts[mark, rule]`` and ``begins[mark, rule]`` as in Leftmost."""

    kind: np.ndarray
    classes: int
    step: np.ndarray
    mark: np.ndarray
    accepts: np.ndarray
    begins: np.ndarray
    #: Bytes after which every state is the start state: no match reaches across them.
    resets: np.ndarray

    @classmethod
    def build(cls, expressions: tuple[bytes, ...]) -> Automaton:
        nfa = Nfa()
        for e in expressions:
            nfa.add(e)
        # bytes that no arc tells apart are one class
        sets = sorted({s for arcs in nfa.arcs for s, _ in arcs}, key=sorted)
        signs = [tuple(b in s for s in sets) for b in range(256)]
        names = {s: i for i, s in enumerate(dict.fromkeys(signs))}
        kind = np.array([names[s] for s in signs], np.uint8)
        rules = [Leftmost.build(e, [signs.index(s) for s in names]) for e in expressions]
        classes = len(names)

        known = {(0,) * len(rules): 0}
        order = [(0,) * len(rules)]
        rows = []
        for state in order:  # grows while it is read: the product of the rules' automata
            row = []
            for to in zip(*(rule.step[s] for rule, s in zip(rules, state))):
                if to not in known:
                    known[to] = len(order)
                    order.append(to)
                row.append(known[to])
            rows.append(row)
        step = np.array(rows)
        told = np.array([[rule.accepts[s] for rule, s in zip(rules, state)] + [rule.begins[s] for rule, s in zip(rules, state)] for state in order])
        marks, mark = np.unique(told, axis=0, return_inverse=True)
        assert not marks[0].any(), "mark 0 says nothing"
        # Moore: split by mark, then by where the transitions lead
        part = mark.ravel()
        while True:
            finer = np.unique(np.c_[part, part[step]], axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        size = part.max() + 1
        name = np.arange(size)  # the start state becomes 0
        name[part[0]], name[0] = 0, part[0]
        part = name[part]
        table_, of = np.zeros((size, classes), np.int64), np.zeros(size, np.uint16)
        table_[part], of[part] = part[step], mark.ravel()
        n = len(rules)
        return cls(kind, classes, (table_ * classes).astype(np.int32).ravel(), of, marks[:, :n].astype(bool), marks[:, n:], (table_ == 0).all(axis=0)[kind])

    def marked(self, data: np.ndarray, offsets: np.ndarray, stretch: int = 1024) -> np.ndarray:
        """The mark of every byte. The texts are cut into stretches at resetting bytes, which are
        walked side by side."""
        n = len(data)
        marks = np.zeros(n, np.uint16)
        if not n:
            return marks
        safe = np.flatnonzero(self.resets[data]) + 1
        at = np.searchsorted(safe, np.arange(stretch, n, stretch))
        cuts = safe[at[at < len(safe)]]
        begin = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], cuts[cuts < n]])
        length = np.diff(np.r_[begin, n])
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        kinds = self.kind[data]
        lanes = len(begin)
        state, where = np.zeros(lanes, np.int32), begin.copy()
        of = np.repeat(self.mark, self.classes)
        ends = np.searchsorted(length[::-1], np.arange(length[0]), side="right")  # lanes that have ended before each step
        k = 0
        for k in range(int(length[0])):
            live = lanes - int(ends[k])
            if live < 8:
                break
            s = self.step.take(state[:live] + kinds.take(where[:live]))
            state[:live] = s
            marks[where[:live]] = of.take(s)
            where[:live] += 1
        else:
            k += 1
        if k < length[0]:  # a few long stretches are left: a plain loop is faster
            step = self.step.tolist()
            for i in range(lanes - int(ends[k])):
                s, states = int(state[i]), []
                for c in kinds[where[i] : begin[i] + length[i]].tolist():
                    s = step[s + c]
                    states.append(s)
                marks[where[i] : begin[i] + length[i]] = of[states]
        return marks

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each rule: the begins and ends of its matches, and where the run begins with which they end."""
        marks = self.marked(data, offsets)
        some = np.flatnonzero(marks)
        marks = marks[some]
        found = []
        for rule in range(self.accepts.shape[1]):
            age = self.begins[:, rule][marks]
            told = np.flatnonzero(age)
            at = self.accepts[:, rule][marks]
            where = some[at]
            if not len(where):
                found.append((where, where, where))
                continue
            first = np.flatnonzero(np.r_[True, (where[1:] != where[:-1] + 1) | (age[at][1:] > 0)])
            run, end = where[first], where[np.r_[first[1:] - 1, len(where) - 1]] + 1
            place = told[np.searchsorted(some[told], run, side="right") - 1]
            found.append((some[place] + 1 - age[place], end, run))
        return found


HELD: list[Automaton] = []


def automaton() -> Automaton:
    if not HELD:
        HELD.append(Automaton.build(tuple(e for _, e, _, _ in RULES)))
    return HELD[0]


def scan_batch(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Of each text the spans (start, rule, end), in code points, sorted."""
    data, offsets = utf8(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    rules, begins, ends = [], [], []
    for rule, ((_, _, group, least), (begin, end, run)) in enumerate(zip(RULES, automaton().spans(data, offsets))):
        keep = end - (run if group else begin) >= least
        rules.append(np.full(int(keep.sum()), rule))
        begins.append(begin[keep])
        ends.append(end[keep])
    begin, end, rule = np.concatenate(begins), np.concatenate(ends), np.concatenate(rules)
    if not len(begin):
        return found
    of = np.searchsorted(offsets, begin, side="right") - 1
    # code points: bytes that do not continue a character
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)] if (data & 0x80).any() else np.arange(len(data) + 1)
    base = points[offsets[of]]
    order = np.lexsort((end, rule, begin))
    for i, s, r, e in zip(of[order].tolist(), (points[begin] - base)[order].tolist(), rule[order].tolist(), (points[end] - base)[order].tolist()):
        found[i].append((s, r, e))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[r][0]}:{s}:{e}" for s, r, e in spans)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Finds secrets in each whole text: columns ``keep``, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end of all rules, by start, then in the order of the rules, in
    code points with exclusive ends; ``base_sha256`` digests those of the first three kinds.
    A base rule's group that counts is the run its match ends with. Null and empty texts have no
    spans; repeated rows are each answered; an empty table gives no rows; very long texts take
    time in proportion. Only the named columns are read, so others may have any name.
    """
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scan_batch(batch.column("text"))
        counts = [pa.array([sum(r == k for _, r, _ in spans) for spans in found], pa.int64()) for k in range(3)]
        digest = [hashlib.sha256(joined([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in found]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *counts, pa.array(digest, pa.string()), pa.array([joined(s) for s in found], pa.string())], [*keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return mapped(docs, list(dict.fromkeys([*keep, "text"])), run, ", ".join(f"`{c}` {k}" for c, k in zip(keep, kinds)) + ", n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``; see ``scan``."""
    return scan(table(spark, sf_dir, "documents"))
