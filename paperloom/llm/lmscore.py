"""Language-model scoring: cross-entropy difference of a target and a background bigram model.

Every word and every pair of neighbouring words of all documents is counted exactly. Documents go
in blocks of a bounded size; a block sends its distinct words and pairs, with its own counts of
them, once to the ranges of keys they belong to; there the blocks' counts are added up, and the
sums go back in the order of the block's keys, without the keys. So no key gathers more entries
than there are blocks, however frequent it is, and blocks and ranges grow in number only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import slices, stored, table

#: Target ids in all that are sent to every task; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
#: Text bytes that two blocks, or a range of keys, hold.
BLOCK_BYTES = 8 << 20
#: Bits of a key, and words whose keys a task keeps at hand.
KEY_BITS, HELD_WORDS = 60, 300_000


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Keys(dict):
    """The 60-bit keys of words: odd ones, by a hash. 0 begins a text, even ones are pairs."""

    def __missing__(self, word: str) -> int:
        key = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> (64 - KEY_BITS) | 1
        return key

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all the texts' words, each text after a 0, and the n + 1 offsets."""
        if len(self) > HELD_WORDS:
            self.clear()
        parts, sizes = [], []
        for text in texts:
            w = words_of(text)
            parts.append(0)
            parts.extend(map(self.__getitem__, w))
            sizes.append(len(w) + 1)
        return np.array(parts, np.int64), np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The keys of pairs of words, from those of the words."""
    with np.errstate(over="ignore"):
        mixed = left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.view(np.uint64)
        mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ mixed >> np.uint64(31)) >> np.uint64(64 - KEY_BITS)).view(np.int64) & ~1


def tokens(keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words, and of those among them that follow a word."""
    inside = np.ones(len(keys), bool)
    inside[offsets[:-1]] = False
    at = np.flatnonzero(inside)
    return at, at[keys[at - 1] != 0]


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(v[order], first) if len(key) else v for v in values)


def packed(key: np.ndarray) -> bytes:
    """Distinct keys in order as bytes: the steps between them, low bytes as they are, high ones compressed."""
    planes = np.ascontiguousarray(np.diff(key, prepend=0)).view(np.uint8).reshape(-1, 8).T
    return planes[:5].tobytes() + zlib.compress(planes[5:].tobytes(), 1)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data[: 5 * n] + zlib.decompress(data[5 * n :]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def small(numbers: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def large(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def in_blocks(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, with __block: rows of about BLOCK_BYTES of text, one at least; and their __row in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, row, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for piece in slices(batch, "text"):
                if size > BLOCK_BYTES // 2:
                    block, row, size = block + 1, 0, 0
                n = piece.num_rows
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.full(n, block)), pa.array(np.arange(row, row + n))], [*columns, "__block", "__row"])
                row, size = row + n, size + piece.column("text").nbytes

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return stored(docs.select(*columns).mapInArrow(run, f"{kinds}, __block long, __row long"), "blocks")


def tallies(blocks: DataFrame, log_ranges: int, counts: bool, asks: bool) -> DataFrame:
    """Of each block and range of keys: the keys that stand in the block, and their counts in it.

    A block that is read in parts sends each on its own; __part is the first row of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, block, part, row = Keys(), [], None, None, None

        def out() -> pa.RecordBatch:
            key, target, background = summed(*(np.concatenate(x) for x in zip(*held)))
            own = key >> (KEY_BITS - log_ranges)
            cuts = np.r_[0, np.flatnonzero(np.diff(own)) + 1, len(own)] if len(own) else np.zeros(1, np.int64)
            parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
            columns = [[int(own[p.start]) for p in parts], [p.stop - p.start for p in parts], [packed(key[p]) for p in parts], *([small(x[p]) if counts else None for p in parts] for x in (target, background))]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            at = [pa.array([x if asks else None] * len(parts), pa.int64()) for x in (block, part)]
            return pa.RecordBatch.from_arrays([*at, *(pa.array(c, k) for c, k in zip(columns, kinds))], ["__block", "__part", "range", "n", "keys", "target", "background"])

        for batch in batches:
            of, rows = batch.column("__block").to_numpy(), batch.column("__row").to_numpy()
            cuts = np.r_[0, np.flatnonzero((np.diff(of) != 0) | (np.diff(rows) != 1)) + 1, len(of)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if of[a] != block or rows[a] != row + 1:
                    if held:
                        yield out()
                    held, block, part = [], int(of[a]), int(rows[a])
                row = rows[b - 1]
                piece = batch.slice(a, b - a)
                keys, offsets = names.of(piece.column("text").to_pylist())
                chosen = np.repeat(np.array(piece.column("target").to_pylist(), np.int64), np.diff(offsets)) if counts else np.zeros(len(keys), np.int64)
                at, after = tokens(keys, offsets)
                key = np.r_[keys[at], pair_keys(keys[after - 1], keys[after])]
                held.append(summed(key, np.r_[chosen[at], chosen[after]], np.ones(len(key), np.int64)))
        if held:
            yield out()

    return blocks.select("__block", "__row", "text", *["target"] * counts).mapInArrow(run, "__block long, __part long, range long, n long, keys binary, target binary, background binary")


def added(rows: pa.Table) -> pa.Table:
    """Of a range: to each block that asks the sums of its keys' counts, in the keys' order; and in
    a row without a block the words of the range, and their sums."""
    blocks, parts, ns, keys, *own = (rows.column(c).to_pylist() for c in ("__block", "__part", "n", "keys", "target", "background"))
    keys = [unpacked(k, n) for k, n in zip(keys, ns)]
    sums = [np.concatenate([np.zeros(0, np.int64), *(large(x) for x in c if x is not None)]) for c in own]
    key, *sums = summed(np.concatenate([np.zeros(0, np.int64), *(k for k, x in zip(keys, own[0]) if x is not None)]), *sums)
    out: list[list] = [[], [], [], []]
    for block, part, asked in zip(blocks, parts, keys):
        if block is not None:
            for to, x in zip(out, (block, part, *(small(counts_of(asked, key, c)) for c in sums))):
                to.append(x)
    word = (key & 1) == 1
    n, first = len(out[0]), rows.column("range")[0].as_py()
    totals = [int(word.sum()), *(int(c[word].sum()) for c in sums)]
    return pa.table(
        [*(pa.array([*x, None], k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))), pa.array([first] * (n + 1)), *(pa.array([0] * n + [t]) for t in totals)],
        ["__block", "__part", "target", "background", "range", "n_words", "n_target", "n_background"],
    )


def counts_of(asked: np.ndarray, known: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ``count`` of each asked key, from those of the sorted ``known`` keys; 0 for others."""
    if not len(known):
        return np.zeros(len(asked), np.int64)
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[place] == asked, count[place], 0)


@dataclass
class PairOfModels:
    """Both models: the documents they count (doc_id, text), and which of them are ``target``."""

    docs: DataFrame
    marked: DataFrame
    lam: float = 0.6


def losses(at: np.ndarray, after: np.ndarray, size: int, one: np.ndarray, two: np.ndarray, total: np.ndarray | int, n_words: int, lam: float, alpha: float) -> np.ndarray:
    """The losses, in nats, of the words at ``at``, from the counts of these and of the pairs that end at ``after``.

    P(w | v) = lam C(v w) / C(v) + (1 - lam) (C(w) + alpha) / (N + alpha V): the same form for both models, in
    which alpha gives both the same share of smoothing: 1 in the background, and in the target less by as much
    as it is smaller. V counts the differing words, the begin, and one for all words never met.
    Where v never stood before a word, the second part has all the weight.
    """
    word, before, pair = np.zeros(size), np.zeros(size), np.zeros(size)  # a first word has no pair: unigram alone
    word[at] = one
    before[after], pair[after] = word[after - 1], two
    before, pair = before[at], pair[at]
    plain = (one + alpha) / (total + alpha * (n_words + 2))
    return -np.log(np.where(before > 0, lam * pair / np.maximum(before, 1) + (1 - lam) * plain, plain))


def clashing(docs: DataFrame) -> bool:
    return "target" in {c.lower() for c in docs.columns}


def own_counts(of: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """How often the document ``of`` a place has the key there itself."""
    _, at, count = np.unique(of * n + place, return_inverse=True, return_counts=True)
    return count[at]


def learn(docs: DataFrame, targets: DataFrame) -> PairOfModels:
    """Both models count all documents (doc_id, text): the background every document, the target
    those whose doc_id is in ``targets``. The counts are made as documents are scored."""
    chosen = targets.where("doc_id is not null").select("doc_id").distinct().withColumn("target", F.lit(True))
    few = chosen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = docs.select("doc_id", "text") if clashing(docs) else docs
    marked = own.join(F.broadcast(chosen) if few else chosen, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    return PairOfModels(docs, marked)


def score(docs: DataFrame, models: PairOfModels, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, n_tokens, loss_target, loss_background (means per token) and score, their
    difference: below 0 a document is closer to the target than to the background.

    A document that the models count is scored by what all others have: its own counts are taken off, so that
    the good ones don't find themselves in the target. A copy of it is another document.

    Texts without words, null ones too, have n_tokens 0 and null losses. Repeated rows are each
    answered; an empty table gives no rows. Very long texts are rows of their own blocks, and take memory in
    proportion to their tokens. Extra columns of any names are not read, unless ``keep`` names them; where one
    is named ``target``, the documents count as others than those the models count.
    """
    columns, lam, same = list(dict.fromkeys([*keep, "text"])), models.lam, docs is models.docs and not clashing(docs)
    blocks = in_blocks(models.marked, [*columns, "target"]) if same else in_blocks(docs, columns)
    learned = blocks if same else in_blocks(models.marked, ["text", "target"])
    size = sum(b.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for b in ([blocks] if same else [blocks, learned]))
    log_ranges = max(4, (size // BLOCK_BYTES).bit_length())
    sent = tallies(blocks, log_ranges, same, True)
    if not same:
        sent = sent.unionByName(tallies(learned, log_ranges, True, False))
    sums = stored(sent.groupBy("range").applyInArrow(added, "__block long, __part long, target binary, background binary, range long, n_words long, n_target long, n_background long"), "sums")
    n_words, *total = sums.where("__block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_target", "n_background"))).first()

    names = Keys()
    alphas = (total[0] / total[1] if total[0] else 1.0, 1.0)

    def answered(texts: pa.Table, found: pa.Table) -> pa.Table:
        texts, found = texts.sort_by("__row"), found.sort_by([("__part", "ascending"), ("range", "ascending")])
        begin, part = texts.column("__row").to_numpy(), found.column("__part").to_numpy()
        cuts = np.r_[0, np.searchsorted(begin, np.unique(part)[1:]), len(begin)]  # parts without words sent nothing
        done: list[list[np.ndarray]] = [[], [], []]
        marks = np.array(texts.column("target").to_pylist() if same else [], bool)
        for i, j in zip(cuts[:-1], cuts[1:]):
            keys, offsets = names.of(texts.column("text").slice(i, j - i).to_pylist())
            at, after = tokens(keys, offsets)
            known, place = np.unique(np.r_[keys[at], pair_keys(keys[after - 1], keys[after])], return_inverse=True)
            mine = found.filter(pa.array(part == np.unique(part)[len(done[0])])) if len(part) else found
            count = [np.concatenate([np.zeros(0, np.int64), *(large(x) for x in mine.column(c).to_pylist())]) for c in ("target", "background")]
            assert len(known) == len(count[0]) == len(count[1])
            count, all_of, n_own = [c[place] for c in count], [t for t in total], np.diff(offsets) - 1
            if same:
                of = np.repeat(np.arange(j - i), np.diff(offsets))[np.r_[at, after]]
                own, mine_of = own_counts(of, place, len(known)), marks[i:j][of]
                count = [count[0] - own * mine_of, count[1] - own]
                n_at = n_own[of[: len(at)]]
                all_of = [total[0] - n_at * mine_of[: len(at)], total[1] - n_at]
            for to, x in zip(done, (n_own, *(losses(at, after, len(keys), c[: len(at)], c[len(at) :], t, n_words, lam, a) for c, t, a in zip(count, all_of, alphas)))):
                to.append(x)
        n, a, b = (np.concatenate(x) for x in done)
        of = np.repeat(np.arange(texts.num_rows), n)
        with np.errstate(invalid="ignore"):
            means = [np.bincount(of, weights=x, minlength=texts.num_rows) / n for x in (a, b, a - b)]
        return pa.table([*[texts.column(c) for c in keep], pa.array(n), *[pa.array(x, mask=n == 0) for x in means]], [*keep, "n_tokens", "loss_target", "loss_background", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    found = sums.where("__block is not null").select("__block", "__part", "range", "target", "background")
    return blocks.select(*columns, *["target"] * same, "__block", "__row").groupBy("__block").cogroup(found.groupBy("__block")).applyInArrow(answered, f"{kinds}, n_tokens long, loss_target double, loss_background double, score double")


def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels").where("quality = 1")))
