"""Language identification with a bit-sliced Bloom filter over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bucket_of, mapped, table, utf8

#: Odd multipliers of the hash functions (fixed values).
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77)
ORDERS = (3, 4)


def folded() -> np.ndarray:
    """A byte table: lower case for ASCII letters, a space for other ASCII, the rest unchanged."""
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = 32
    for c in range(97, 123):
        fold[c] = fold[c - 32] = c
    return fold


FOLD = folded()


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """At each byte, the ``order`` bytes that start there as one integer (wrapping at the end)."""
    key = np.zeros(len(data), np.uint32)
    for k in range(order):
        key = (key << np.uint32(8)) | np.roll(data, -k)
    return key


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with a space before and after each text, and the n + 1 offsets."""
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    low = FOLD[data]
    # Latin-1 capitals in UTF-8: C3 80-9E, without the multiplication sign
    upper = (low >= 0x80) & (low <= 0x9E) & (low != 0x97)
    upper[1:] &= data[:-1] == 0xC3
    upper[:1] = False
    low = low + upper.astype(np.uint8) * np.uint8(32)
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        out[a + 2 * i + 1 : b + 2 * i + 1] = low[a:b]
    return out, offsets + 2 * np.arange(n + 1)


def windows(data: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The grams of an order, at most ``SLICE_BYTES`` of them at once: their keys, which of them lie
    within one text, and where among them each text begins and ends."""
    for a in range(0, len(data), SLICE_BYTES):
        b = min(a + SLICE_BYTES, len(data))
        keys = order_keys(data[a : b + order - 1], order)[: b - a]
        inside = np.ones(b - a, bool)
        for k in range(1, order):  # no gram reaches into the next text
            at = offsets[1:] - k - a
            inside[at[(at >= 0) & (at < b - a)]] = False
        yield keys, inside, np.clip(offsets[:-1] - a, 0, b - a), np.clip(offsets[1:] - a, 0, b - a)


@dataclass
class LanguageFilter:
    """Row p of ``planes[j]`` holds, as bits, the languages 64 j .. that contain a gram hashed to p."""

    languages: list[str]
    planes: list[np.ndarray]
    rates: np.ndarray
    log_rows: int

    @classmethod
    def build(cls, grams_by_language: dict[str, np.ndarray], log_rows: int) -> LanguageFilter:
        languages = list(grams_by_language)
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        planes = [np.zeros(1 << log_rows, kind) for _ in range(max(1, -(-len(languages) // 64)))]
        for i, name in enumerate(languages):
            for m in MULTIPLIERS:
                planes[i // 64][cls.place(grams_by_language[name], m, log_rows)] |= kind(1 << (i % 64))
        fill = np.array([np.count_nonzero(planes[i // 64] & kind(1 << (i % 64))) for i in range(len(languages))])
        return cls(languages, planes, (fill / (1 << log_rows)) ** len(MULTIPLIERS), log_rows)

    @staticmethod
    def place(keys: np.ndarray, multiplier: int, log_rows: int) -> np.ndarray:
        return ((keys ^ (keys >> np.uint32(15))) * np.uint32(multiplier)) >> np.uint32(32 - log_rows)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: grams that each language's filter holds, and all its grams."""
        n = len(offsets) - 1
        hits, total = np.zeros((n, len(self.languages))), np.zeros(n)
        of = lambda marks, begin, end: (c := np.r_[0, np.cumsum(marks, dtype=np.int64)])[end] - c[begin]
        for order in ORDERS:
            for keys, inside, begin, end in windows(data, offsets, order):
                places = [self.place(keys, m, self.log_rows) for m in MULTIPLIERS]
                total += of(inside, begin, end)
                for j, plane in enumerate(self.planes):
                    mask = plane[places[0]]
                    for p in places[1:]:
                        mask &= plane[p]
                    mask[~inside] = 0
                    for i in range(64 * j, min(len(self.languages), 64 * j + 64)):
                        hits[:, i] += of((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), begin, end)
        return hits, total

    def decide(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        letters = np.array([t is not None and any(c.isalpha() for c in t) for t in texts.to_pylist()], bool)
        names, scores = ["und"] * n, np.zeros(n)
        if not self.languages or not n:
            return names, scores
        hits, total = self.counts(*padded(texts))
        true = np.maximum(0, hits - total[:, None] * self.rates) / np.maximum(1e-9, 1 - self.rates)
        best, whole = true.argmax(axis=1), true.sum(axis=1)
        share = np.where(whole > 0, true[np.arange(n), best] / np.maximum(whole, 1e-9), 1 / len(self.languages))
        for k in np.flatnonzero(letters):
            names[k] = self.languages[best[k]]
        return names, np.where(letters, np.clip(share, 0, 1), 0.0)


def order_keys(data: np.ndarray, order: int) -> np.ndarray:
    return grams(data, order) ^ np.uint32(order << 29)


def learn(docs: DataFrame, per_language: int = 1500, spare: int = 16, language_bytes: int = 16 << 20) -> LanguageFilter:
    """Builds the filter from labelled documents (columns text, lang).

    A bounded sample is read, about ``per_language`` documents of each language or ``language_bytes`` of their
    text, whichever is less, chosen by a hash of the text; copies of a text count once. All n-grams of the sample enter their language's filter, whose rows are at
    least ``spare`` times the n-grams of the language with most. An empty table gives no languages.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    known = docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    sizes, weight = {r["lang"]: r["n"] for r in known}, {r["lang"]: max(1, r["bytes"]) for r in known}
    if not sizes:
        return LanguageFilter.build({}, 10)
    order = sorted(sizes, key=lambda x: (-sizes[x], x))
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(per_language / sizes[x], language_bytes / weight[x]))) for x in order])
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["lang", "text"])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = padded(batch.column("text"))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets)).astype(np.uint64)
        langs = batch.column("lang").to_pylist()
        code = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        of = np.array([code[x] for x in langs], np.uint64)
        found = []
        for k in ORDERS:
            inside = np.ones(len(data), bool)
            for j in range(1, k):
                inside[offsets[1:] - j] = False
            pair = np.unique((owner[inside] << np.uint64(32)) | order_keys(data, k)[inside])
            found.append((of[(pair >> np.uint64(32)).astype(np.int64)] << np.uint64(32)) | (pair & np.uint64(0xFFFFFFFF)))
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        names = np.array(list(code), object)[(keys >> np.uint64(32)).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counted = mapped(sample, ["lang", "text"], count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = counted.select("lang", "gram").toPandas()
    found = {x: g.gram.to_numpy().astype(np.uint32) for x, g in kept.groupby("lang")}
    most = max((len(g) for g in found.values()), default=1)
    return LanguageFilter.build({x: found.get(x, np.zeros(0, np.uint32)) for x in order}, max(10, min(32, (spare * most - 1).bit_length())))


def identify(docs: DataFrame, model: LanguageFilter, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Predicts the language of each whole text: columns ``keep``, lang_pred, score.

    Null texts and texts without a letter get ``und`` and 0. Repeated rows are each answered;
    an empty table gives no rows; very long texts are counted in windows, whole; only the named
    columns are read, so others may have any name.
    Ties go to the language with more training documents.
    """
    cast = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = cast.value.decide(batch.column("text"))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores)], [*keep, "lang_pred", "score"])

    return mapped(docs, [*keep, "text"], run, ", ".join(f"`{c}` {k}" for c, k in zip(keep, kinds)) + ", lang_pred string, score double")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, with filters learned outside the held-out fold; see ``identify``."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(bucket_of("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
