"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded; gated attention, learned from the
document labels alone, weighs the passages; the weighted sum is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bucket_of, mapped, sampled_labels, sigmoid, table, utf8

PASSAGE = 512
PAIRS = 128
EXTRA = 8
WIDTH = 64 + PAIRS + EXTRA


def character_kinds() -> np.ndarray:
    """64 kinds of bytes: printable ASCII in pairs of neighbours, letters by themselves, the rest by range."""
    kinds = np.full(256, 63, np.uint8)
    for b in range(33, 127):
        kinds[b] = 32 + (b - 33) % 24
    for c in range(26):
        kinds[97 + c] = c
        kinds[65 + c] = 26
    kinds[48:58] = 27
    kinds[[9, 32]] = 28
    kinds[[10, 13]] = 29
    kinds[128:192] = 30
    kinds[192:] = 31
    kinds[[46, 44]] = 56
    for i, c in enumerate(b"!*$%#|"):
        kinds[c] = 57 + i
    return kinds


KINDS = character_kinds()


def passages(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins of the passages, of about ``PASSAGE`` bytes each, and the document of each; an empty text has none."""
    size = np.diff(offsets)
    n = -(-size // PASSAGE)
    owner = np.repeat(np.arange(len(size)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return offsets[owner] + nth * size[owner] // np.maximum(1, n[owner]), owner


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (square roots of shares), and the document of each. About ``SLICE_BYTES``
    are encoded at once: longer texts are cut between words, and their pieces into passages."""
    if len(data) <= SLICE_BYTES:
        return encode_piece(data, offsets)
    cuts = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        while b - a > SLICE_BYTES:
            near = data[a + SLICE_BYTES // 2 : a + SLICE_BYTES]
            gap = np.flatnonzero((near == 32) | ((near >= 9) & (near <= 13)))
            a += SLICE_BYTES // 2 + int(gap[-1]) if len(gap) else SLICE_BYTES
            cuts.append(a)
    edges = np.unique(np.r_[offsets, cuts].astype(np.int64))
    found, i = [], 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + SLICE_BYTES, side="right")) - 1)
        x, owner = encode_piece(data[edges[i] : edges[j]], edges[i : j + 1] - edges[i])
        found.append((x, np.searchsorted(offsets, edges[i + owner], side="right") - 1))
        i = j
    return np.concatenate([x for x, _ in found]), np.concatenate([o for _, o in found])


def encode_piece(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (square roots of shares), and the document of each."""
    begin, owner = passages(offsets)
    count = len(begin)
    if not count:
        return np.zeros((0, WIDTH), np.float32), owner
    length = np.diff(np.r_[begin, len(data)]).astype(np.float32)
    of = np.repeat(np.arange(count, dtype=np.int64), length.astype(np.int64))
    kind = KINDS[data].astype(np.int64)
    single = np.bincount(of * 64 + kind, minlength=64 * count).reshape(count, 64)
    pair = (kind[:-1] * 64 + kind[1:]) * 40503 >> 3 & (PAIRS - 1)
    double = np.bincount(of[:-1] * PAIRS + pair, minlength=PAIRS * count).reshape(count, PAIRS)
    # words: a position-weighted sum of their bytes stands for each
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start = ~space
    start[1:] &= space[:-1]
    start[offsets[:-1][offsets[:-1] < len(data)]] |= ~space[offsets[:-1][offsets[:-1] < len(data)]]
    at = np.flatnonzero(start)
    extra = np.zeros((count, EXTRA), np.float32)
    if len(at):
        word = np.cumsum(start) - 1
        place = np.arange(len(data)) - at[np.maximum(word, 0)]
        mixed = (data.astype(np.uint64) + np.uint64(1)) * POWERS[np.minimum(place, 255)]
        mixed[space | (word < 0)] = 0
        code = np.add.reduceat(mixed, at)
        home = of[at]
        words = np.maximum(1, np.bincount(home, minlength=count)).astype(np.float32)
        size = np.add.reduceat((~space).astype(np.int64), at)
        for j, lag in enumerate((1, 2)):
            same = np.zeros(len(at), bool)
            same[lag:] = (code[lag:] == code[:-lag]) & (home[lag:] == home[:-lag])
            extra[:, j] = np.bincount(home[same], minlength=count) / words
        order = np.lexsort((code, home))
        first = np.ones(len(at), bool)
        first[1:] = (code[order][1:] != code[order][:-1]) | (home[order][1:] != home[order][:-1])
        extra[:, 2] = np.bincount(home[order][first], minlength=count) / words
        extra[:, 3] = np.bincount(home, weights=size, minlength=count) / words / 16
        extra[:, 4] = words / length
        extra[:, 5] = np.bincount(home, weights=size > 14, minlength=count) / words
    extra[:, 6] = length / PASSAGE
    extra[:, 7] = 1
    features = np.concatenate([np.sqrt(single / length[:, None]), np.sqrt(double / length[:, None]), extra], axis=1)
    return features.astype(np.float32), owner


def odd_powers() -> np.ndarray:
    out, x = np.zeros(256, np.uint64), 1
    for i in range(256):
        x = x * 6364136223846793005 + 1442695040888963407 & 0xFFFFFFFFFFFFFFFF
        out[i] = x | 1
    return out


POWERS = odd_powers()


@dataclass
class BagModel:
    """h = tanh(x W), attention ~ exp(w . (tanh(h V) * sigmoid(h U))), score = sigmoid(c . sum(a h) + b)."""

    p: dict[str, np.ndarray]
    base: float

    @classmethod
    def fresh(cls, hidden: int, gate: int, base: float, seed: int) -> BagModel:
        r = np.random.default_rng(seed)
        shape = {"W": (WIDTH, hidden), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "b": (1,)}
        return cls({k: r.normal(0, 1 / np.sqrt(s[0]), s) if k not in "b" else np.full(1, base) for k, s in shape.items()}, base)

    def attention(self, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """For passages x in bags that begin at ``begin`` (none empty)."""
        p = self.p
        h = np.tanh(x @ p["W"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = np.clip((t * s) @ p["w"], -30, 30)
        size = np.diff(np.r_[begin, len(x)])
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), size))
        a /= np.repeat(np.add.reduceat(a, begin), size)
        z = np.add.reduceat(h * a[:, None], begin)
        return h, t, s, a, z, size

    def score(self, x: np.ndarray, owner: np.ndarray, bags: int) -> np.ndarray:
        """Of each document; one without passages gets the share of good documents."""
        out = np.full(bags, sigmoid(np.array(self.base)).item())
        if len(x):
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[begin]] = sigmoid(self.attention(x, begin)[4] @ self.p["c"] + self.p["b"][0])
        return out

    def gradients(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, t, s, a, z, size = self.attention(x, begin)
        d = (sigmoid(z @ p["c"] + p["b"][0]) - y) * weight / len(y)
        dz = np.repeat(d[:, None] * p["c"], size, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, begin), size))
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (dz * a[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ d, "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 7) -> BagModel:
        """Adam over shuffled batches; both labels weigh the same."""
        r, m, v, k = np.random.default_rng(seed), {}, {}, 0
        weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        for _ in range(epochs):
            for part in np.array_split(r.permutation(len(y)), max(1, len(y) // batch)):
                chosen = [bags[i] for i in part]
                begin = np.cumsum([0, *map(len, chosen[:-1])])
                k += 1
                for n, g in self.gradients(np.concatenate(chosen).astype(np.float64), begin, y[part], weight[part]).items():
                    g = g + decay * self.p[n]
                    m[n] = 0.9 * m.get(n, 0) + 0.1 * g
                    v[n] = 0.999 * v.get(n, 0) + 0.001 * g * g
                    self.p[n] -= rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.999**k)) + 1e-8)
        return self


def learn(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, bound: int = 4000, epochs: int = 6, hidden: int = 24, gate: int = 12, passages: int = 64) -> BagModel | None:
    """Fits the model on at most ``bound`` labelled documents, and of each on at most ``passages`` passages, spread
    evenly over its whole text, so that what the driver gathers is bounded; None without both labels."""
    chosen = F.broadcast(sampled_labels(labels, "quality", fold, folds, bound))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").where(F.length("text") > 0)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, owner = encode(*utf8(batch.column("text")))
        x = x.astype(np.float16)
        ends = [np.searchsorted(owner, np.arange(batch.num_rows), side=side).tolist() for side in ("left", "right")]
        bags = [x[np.unique(np.linspace(a, b - 1, min(passages, b - a)).astype(np.int64))].tobytes() for a, b in zip(*ends)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    rows = mapped(sample, ["doc_id", "text", "label"], run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, bag binary").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    y = rows.label.to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in rows.bag]
    base = float(np.log(y.mean() / (1 - y.mean())))
    return BagModel.fresh(hidden, gate, base, 11).fit(bags, y, epochs)


def score(docs: DataFrame, model: BagModel | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scores each whole text: columns ``keep``, score (0 to 1), passages.

    Null and empty texts get the share of good labels, 0.5 without a model. Repeated rows are
    each answered; an empty table gives no rows; very long texts are encoded in pieces, whole; other
    columns are not read, so they may have any name.
    """
    cast = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, owner = encode(*utf8(batch.column("text")))
        scores = cast.value.score(x, owner, batch.num_rows) if cast.value else np.full(batch.num_rows, 0.5)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores), pa.array(np.bincount(owner, minlength=batch.num_rows).astype(np.int32))], [*keep, "score", "passages"])

    return mapped(docs, list(dict.fromkeys([*keep, "text"])), run, ", ".join(f"`{c}` {k}" for c, k in zip(keep, kinds)) + ", score double, passages int")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, with a model learned outside the held-out fold; see ``score``."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
