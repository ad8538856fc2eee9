"""Benchmark decontamination by pigeonhole edit matching.

A test item of L characters may differ from a passage by k edits. Cut into k + 1 pieces, at
least one piece then stands unchanged in the passage. All pieces are found at once with an
Aho-Corasick automaton; around a hit whose neighbouring piece can be there too, the item is
verified with Myers' bit-parallel edit distance (the passage may begin and end anywhere).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tidy


def separators() -> bytes:
    """A byte table: ASCII other than letters and digits becomes a space."""
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


SPACES = separators()


def normal(text: str | None) -> str:
    """Lower case, words joined by single spaces; one character for each byte of UTF-8."""
    return b" ".join(text.lower().encode().translate(SPACES).split()).decode("latin-1") if text else ""


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any part of the text, and where that part ends."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


@dataclass
class Item:
    key: object
    text: str
    budget: int


#: Characters that a piece keeps at least; shorter items must be found exactly.
LEAST = 5


def budget(length: int, rate: float, least: int) -> int:
    """Edits allowed: ``rate`` of the length, but pieces keep ``least`` characters."""
    return max(0, min(int(length * rate), length // least - 1))


@dataclass
class Piece:
    """A piece at ``begin`` of an item, and the halves of the piece that it makes a pair with, which
    comes after it (``side`` 1), before it (-1), or isn't there (0)."""

    item: int
    begin: int
    side: int
    first: str
    second: str

    def pair_may_match(self, text: str, begin: int, end: int) -> bool:
        """Whether the other piece of the pair can stand next to this one, at text[begin:end], with one
        edit at most: a half of it stands there, the near one in its place, the far one within one of it."""
        if self.side > 0:
            far = end + len(self.first)
            return text.startswith(self.first, end) or text.find(self.second, far - 1, far + len(self.second) + 1) >= 0
        if self.side < 0:
            near = begin - len(self.second)
            return near >= 0 and text.startswith(self.second, near) or text.find(self.first, max(0, near - len(self.first) - 1), max(0, near + 1)) >= 0
        return True


class Matcher:
    """The pieces of a block of items, as one automaton.

    k edits hit at most k of an item's k + 1 pieces. The pieces are taken in pairs: of these, and the
    one that an odd number leaves, one has fewer edits than pieces. So a hit is followed up only if
    the other piece of its pair can stand beside it with one edit at most.
    """

    def __init__(self, items: list[tuple[object, str | None]], rate: float, least: int) -> None:
        import ahocorasick

        self.items = [Item(k, n, budget(len(n), rate, least)) for k, t in items if (n := normal(t))]
        pieces: dict[str, list[Piece]] = {}
        for i, item in enumerate(self.items):
            parts, n = item.budget + 1, len(item.text)
            cut = [item.text[p * n // parts : (p + 1) * n // parts] for p in range(parts)]
            for p, piece in enumerate(cut):
                other = p ^ 1
                side = 0 if other >= parts else other - p
                near = cut[other] if side else ""
                pieces.setdefault(piece, []).append(Piece(i, p * n // parts, side, near[: len(near) // 2], near[len(near) // 2 :]))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def leaks(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item, distance, begin, end) of the best passage of each item found, in the normal form."""
        if self.empty or not text:
            return []
        t = normal(text)
        best: dict[int, tuple[int, int, int]] = {}
        done: set[tuple[int, int]] = set()
        for last, (size, where) in self.automaton.iter(t):
            for piece in where:
                at = last + 1 - size
                if not piece.pair_may_match(t, at, last + 1):
                    continue
                i = piece.item
                item = self.items[i]
                k, n = item.budget, len(item.text)
                cell = (i, (at - piece.begin) // (k + 1))
                if cell in done or best.get(i, (n,))[0] == 0:
                    continue
                done.add(cell)
                # every diagonal of the cell, and k edits either way
                low = max(0, cell[1] * (k + 1) - k)
                stop = cell[1] * (k + 1) + n + 2 * k + 1
                found = t.find(item.text, low, stop)
                while found >= 0 and not k and not whole(t, found, found + n):
                    found = t.find(item.text, found + 1, stop)
                if found >= 0:
                    best[i] = (0, found, found + n)
                    continue
                if not k:
                    continue
                window = t[low:stop]
                distance, end = myers(item.text, window)
                if distance <= k and distance < best.get(i, (k + 1,))[0]:
                    back = myers(item.text[::-1], window[:end][::-1])[1]
                    best[i] = (distance, low + end - back, low + end)
        return [(self.items[i].key, *v) for i, v in sorted(best.items())]


def whole(text: str, begin: int, end: int) -> bool:
    """An exact passage begins and ends at words."""
    return (begin == 0 or text[begin - 1] == " ") and (end == len(text) or text[end] == " ")


def blocks(items: DataFrame, size: int) -> list[list[tuple[object, str]]]:
    """The test items in blocks of about ``size`` bytes; a block at a time is on the driver."""
    known = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // size)
    for b in range(count):
        yield [(r["item_id"], r["text"]) for r in known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).collect()]


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.1, least: int = LEAST, block_bytes: int = 1 << 20) -> DataFrame:
    """Rows (doc_id, item_id, distance, begin, end): the best passage of each test item in each document.

    ``distance`` counts edits between the normal forms (lower case, letters and digits, single
    spaces); ``begin`` and ``end`` are byte positions there. Items without words, null items and
    null texts match nothing. An item allows ``rate`` of its characters as edits, items of fewer than
    10 none, and these must begin and end at words. Repeated documents are each answered; an
    empty table of either gives no rows; very long texts are read whole; other columns are not read.
    The documents are read once per block of items.
    """
    cast = docs.sparkSession.sparkContext.broadcast
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    names = ["doc_id", "item_id", "distance", "begin", "end"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, begin long, end long"
    found = None
    for block in blocks(items, block_bytes):
        shared = cast((block, rate, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in batches:
                for piece in slices(batch, "text"):
                    rows = [(i, *leak) for i, text in enumerate(piece.column("text").to_pylist()) for leak in matcher.leaks(text)]
                    if rows:
                        at, item, distance, begin, end = zip(*rows)
                        yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(at)), pa.array(item), pa.array(distance, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names)

        part = docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.1, least: int = LEAST, block_bytes: int = 1 << 20) -> DataFrame:
    """The documents in which no test item was found, with all their columns; see ``find_leaks``.

    Null and empty texts stay, and repeated rows each; without items all documents stay, and an
    empty table gives no rows."""
    cast = docs.sparkSession.sparkContext.broadcast
    for block in blocks(items, block_bytes):
        shared = cast((block, rate, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in batches:
                for piece in slices(batch, "text"):
                    yield piece.filter(pa.array([not matcher.leaks(text) for text in piece.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` in ``documents``; see ``find_leaks``."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
