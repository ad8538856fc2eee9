"""Similarity join of documents on their sets of five-word shingles, with prefix trees.

Two documents link when their sets' Jaccard similarity is at least 0.75. Linked sets differ in few
tokens, so at most a quarter of a set's tokens may stand in no other set:

1. Survey. Every text is read once. Blocks of texts send a share of their distinct tokens, as 32-bit
   marks, to ranges of tokens; a range says which of them are met again. Sets with too many tokens of
   their own in that share can't link with any other and are done. This rules out most documents.
2. Order. The sets that are left send all their tokens, whole, and get back in how many sets each stands.
   A set is kept in one global order, rare tokens first; tokens of one set alone need no keeping.
3. Prefixes. Linked sets share a token among the first ``n - ceil(0.75 n) + 1`` of each. At every such
   token the set with the fewest tokens of its own, so nearest to what the others share, leads; the
   others are compared with it: n near copies cost about n comparisons, not n squared.
4. Trees. A leader's candidates form a prefix tree in the global order, read from its frequent end, where
   near copies share long paths. The leader walks it: the overlap of a path is counted once for all sets
   below it, and a subtree is left when its remaining length can't bring the overlap that it needs.
5. Rounds of 3 and 4 follow between different components until a round finds no link. Then every pair
   of prefix neighbours that still is in different components is compared, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, released, slices, stored, table, text_keys, tidy, utf8
from .components import components
from .line_dedup import unused

WORDS = 5
#: Similarity of a link, as a fraction.
NUM, DEN = 75, 100
#: Share of the tokens that the survey sends. Any share is right; a smaller one rules out fewer sets.
SURVEY = 0.4
#: Tokens that a block gathers, and sets in it at most (their numbers take two bytes).
BLOCK_TOKENS, BLOCK_SETS = 1 << 20, 65_000
#: Stands for the number of a set where several of the block have the token.
SEVERAL = 0xFFFF
#: Bytes of text that are cut into words at once, and that a range of tokens gathers.
PIECE, RANGE_BYTES = 1 << 20, 16 << 20
#: Texts that a task remembers to have sent.
SENT_TEXTS = 200_000
#: Rows of a prefix token that go to one task; tokens with more are split. Sets in one tree.
HOT_ROWS, TREE_SETS, TREE_BYTES = 500, 512, 16 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def piece_codes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a piece of text, and where they begin. A-Z count as a-z.
    A word also begins at each of ``starts``."""
    space = spaces(data)
    start = ~space
    start[1:] &= space[:-1]
    start[starts] = ~space[starts]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), at
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    place = np.arange(len(data), dtype=np.int32) - at.astype(np.int32)[np.maximum(np.cumsum(start, dtype=np.int32) - 1, 0)]
    span = int(place[~space].max()) + 1
    odd = mix((np.arange(span, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    place[space] = 0
    value = (low.astype(np.uint64) + np.uint64(1)) * odd[place]
    value[space] = 0
    return mix(np.add.reduceat(value, at)), at


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, and the text of each. Long texts are cut between words."""
    codes, places, a = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while a < len(data):
        b = min(a + PIECE, len(data))
        stop, step = int(offsets[np.searchsorted(offsets, b)]), PIECE
        while b < stop and not len(gap := np.flatnonzero(spaces(data[b : min(stop, b + step)]))):
            b, step = min(stop, b + step), 2 * step
        if b < stop:
            b += int(gap[0])
        starts = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        code, at = piece_codes(data[a:b], starts)
        codes.append(code)
        places.append(at + a)
        a = b
    return np.concatenate(codes), np.searchsorted(offsets, np.concatenate(places), side="right") - 1


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Of each text its set: ascending hashes of the distinct shingles of so many words."""
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    code, owner = word_codes(data, offsets)
    ends = np.searchsorted(owner, np.arange(n), side="right")
    begins = np.r_[0, ends[:-1]]
    whole = np.zeros(max(0, len(code) - words + 1), np.uint64)
    for k in range(words):
        whole = mix(whole * np.uint64(3) + code[k : k + len(whole)] + np.uint64(k + 1))
    out = []
    for a, b in zip(begins.tolist(), ends.tolist()):
        if b - a >= words:
            s = np.sort(whole[a : b - words + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"few" + code[a:b].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> bytes:
    """A set's 128-bit name."""
    return xxhash.xxh3_128_digest(s.tobytes())


def least_overlap(n):
    """The overlap with which a set of n tokens links at least, whatever the other."""
    return -(-NUM * n // DEN)


def needed(n, m):
    """The overlap with which sets of n and m tokens link."""
    return -(-NUM * (n + m) // (NUM + DEN))


class Block:
    """The differing sets of a task's share of texts, until they are sent."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.names: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.held = 0

    def put(self, name: bytes, n: int, tokens: np.ndarray) -> int:
        """The number of the set in this block."""
        place = self.names.setdefault(name, len(self.names))
        if place == len(self.sizes):
            self.sizes.append(n)
            self.tokens.append(tokens)
            self.held += len(tokens)
        return place

    def full(self) -> bool:
        return self.held >= BLOCK_TOKENS or len(self.sizes) >= BLOCK_SETS

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens in order, the set of each, and where a new token begins."""
        token = np.concatenate([np.zeros(0, np.uint64), *self.tokens])
        place = np.repeat(np.arange(len(self.tokens), dtype=np.uint16), [len(t) for t in self.tokens])
        order = np.argsort(token, kind="stable")
        token = token[order]
        return token, place[order], np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)


def cut(token: np.ndarray, log_ranges: int) -> list[tuple[int, slice]]:
    """The ranges that sorted tokens fall in, by their highest bits."""
    own = token >> np.uint64(64 - log_ranges)
    cuts = np.r_[0, np.flatnonzero(np.diff(own)) + 1, len(own)] if len(own) else np.zeros(1, np.int64)
    return [(int(own[a]), slice(a, b)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def log_ranges_of(size: int) -> int:
    return min(24, max(6, (size // RANGE_BYTES).bit_length()))


def task_blocks() -> Iterator[Block]:
    from pyspark.taskcontext import TaskContext

    first = TaskContext.get().partitionId() << 32
    while True:
        yield Block(first)
        first += 1


def surveyed(docs: DataFrame, log_ranges: int) -> DataFrame:
    """One pass over all texts. Rows with a doc_id column: a document's keys, set size n, name, its
    block and number there, and how many of its tokens are in the survey's share. Rows with a range:
    the marks of a block's distinct tokens there, and the set of each. Rows with ``shared``: how many
    tokens a set shares with others of its block."""
    names = ["doc_id", "h1", "h2", "n", "sig", "block", "place", "low", "range", "marks", "places"]
    kinds = [pa_type(docs, "doc_id"), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    bound = np.uint64(int(SURVEY * 2**64))

    def rows(**given) -> pa.RecordBatch:
        size = len(next(iter(given.values())))
        column = lambda x, k: pa.nulls(size, k) if x is None else x if isinstance(x, pa.Array) else pa.array(x, k)
        return pa.RecordBatch.from_arrays([column(given.get(c), k) for c, k in zip(names, kinds)], names)

    def sent(block: Block) -> Iterator[pa.RecordBatch]:
        token, place, first = block.sorted()
        if not len(token):
            return
        count = np.diff(np.r_[first, len(token)])
        several = np.repeat(count > 1, count)
        yield rows(block=[block.number], places=[place[several].tobytes()])
        owner = np.where(count > 1, np.uint16(SEVERAL), place[first])
        mark = (token[first] >> np.uint64(32 - log_ranges)).astype(np.uint32)
        parts = cut(token[first], log_ranges)
        yield rows(block=[block.number] * len(parts), range=[r for r, _ in parts], marks=[mark[s].tobytes() for _, s in parts], places=[owner[s].tobytes() for _, s in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = task_blocks()
        block = next(fresh)
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                sets = shingle_sets(piece.column("text"))
                low = [int(np.searchsorted(s, bound)) for s in sets]
                sigs = [signature(s) if len(s) else None for s in sets]
                places, numbers = [], []
                for s, g, k in zip(sets, sigs, low):
                    if g is not None and block.full():
                        yield from sent(block)
                        block = next(fresh)
                    places.append(None if g is None else block.put(g, len(s), s[:k].copy()))
                    numbers.append(block.number)
                yield rows(doc_id=piece.column("doc_id"), h1=piece.column("h1"), h2=piece.column("h2"), n=[len(s) for s in sets], sig=sigs, block=numbers, place=places, low=low)
        yield from sent(block)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h1 long, h2 long, n int, sig binary, block long, place int, low int, range long, marks binary, places binary"
    return docs.select("doc_id", "text", *text_keys("h1", "h2")).mapInArrow(tidy(run), schema)


def pa_type(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)


def met_again(rows: pa.Table) -> pa.Table:
    """Of a range of tokens: to each block the sets whose marks other sets have too, once for each mark.
    Marks that are equal by chance count as shared: that keeps a set, and never rules one out."""
    marks = [np.frombuffer(x, np.uint32) for x in rows.column("marks").to_pylist()]
    places = [np.frombuffer(x, np.uint16) for x in rows.column("places").to_pylist()]
    _, of, count = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
    many = (count + np.bincount(of, weights=np.concatenate(places) == SEVERAL, minlength=len(count)) > 1)[of]
    ends = np.cumsum([len(m) for m in marks]).tolist()
    found = [p[many[e - len(p) : e] & (p != SEVERAL)].tobytes() for p, e in zip(places, ends)]
    return pa.table([rows.column("block"), pa.array(found, pa.binary())], ["block", "places"])


def shared_tokens(rows: pa.Table) -> pa.Table:
    """Of a block: how many tokens each of its sets shares, as told by the block itself and by the ranges."""
    count = np.bincount(np.frombuffer(b"".join(rows.column("places").to_pylist()), np.uint16))
    some = np.flatnonzero(count)
    return pa.table([pa.array(np.full(len(some), rows.column("block")[0].as_py())), pa.array(some.astype(np.int32)), pa.array(count[some].astype(np.int32))], ["block", "place", "shared"])


def bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of 64-bit hashes (column h1), 16 MB at most however many there are: the
    hash's own bits choose a word and two bits of it."""
    words = 1 << min(21, max(10, int(np.ceil(np.log2(max(1, keys.count()) / 4)))))
    bits = F.expr("shiftleft(1L, cast(h1 & 63 as int)) | shiftleft(1L, cast(shiftright(h1, 8) & 63 as int))")
    rows = keys.select(F.expr(f"pmod(shiftright(h1, 16), {words})").alias("w"), bits.alias("x")).groupBy("w").agg(F.bit_or("x").alias("x")).toPandas()
    out = np.zeros(words, np.int64)
    out[rows.w.to_numpy()] = rows.x.to_numpy()
    return out


def chosen_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One text for each row (h1, h2) of ``chosen``. A broadcast filter of bounded size drops most
    others before the join, which is exact."""
    words = docs.sparkSession.sparkContext.broadcast(bloom(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()  # a task sends a text once, so that no text has more rows than tasks
        for batch in batches:
            h = batch.column("h1").to_numpy()
            x = words.value[(h >> 16) % len(words.value)]
            some = batch.filter(pa.array(((x >> (h & 63)) & (x >> ((h >> 8) & 63)) & 1).astype(bool)))
            fresh = []
            for key in zip(some.column("h1").to_pylist(), some.column("h2").to_pylist()):
                fresh.append(key not in sent)
                sent.add(key)
            if len(sent) > SENT_TEXTS:
                sent.clear()
            yield some.filter(pa.array(fresh, pa.bool_()))

    few = docs.where("text is not null").select(*text_keys("h1", "h2"), "text").mapInArrow(tidy(run), "h1 long, h2 long, text string")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt once: the join and the removal of copies find the rows where they need them
    return few.repartition(tasks, "h1", "h2").join(chosen, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])


#: Numbers of the rows of a block that are no ranges: its sets' names and sizes, and its own shared tokens.
SETS, OWN = -2, -1


def token_rows(texts: DataFrame, log_ranges: int) -> DataFrame:
    """Of blocks of texts: the distinct tokens in each range, the set of each (or SEVERAL), and how
    many of the block's sets have it; a row with its sets; and one with the tokens that several have."""
    names = ["block", "range", "tokens", "places", "counts"]

    def sent(block: Block) -> Iterator[pa.RecordBatch]:
        token, place, first = block.sorted()
        if not len(token):
            return
        count = np.diff(np.r_[first, len(token)])
        several = np.repeat(count > 1, count)
        owner = np.where(count > 1, np.uint16(SEVERAL), place[first])
        distinct, count = token[first], count.astype(np.uint32)
        parts = cut(distinct, log_ranges)
        found = [(SETS, b"".join(block.names), b"", np.array(block.sizes, np.uint32).tobytes()), (OWN, token[several].tobytes(), place[several].tobytes(), b"")]
        found += [(r, distinct[s].tobytes(), owner[s].tobytes(), count[s].tobytes()) for r, s in parts]
        yield pa.RecordBatch.from_arrays([pa.array([block.number] * len(found)), pa.array([f[0] for f in found], pa.int64()), *(pa.array([f[i] for f in found], pa.binary()) for i in (1, 2, 3))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = task_blocks()
        block = next(fresh)
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                for s in shingle_sets(piece.column("text")):
                    if block.full():
                        yield from sent(block)
                        block = next(fresh)
                    block.put(signature(s), len(s), s)
        yield from sent(block)

    return texts.select("text").mapInArrow(tidy(run), "block long, range long, tokens binary, places binary, counts binary")


def counted(rows: pa.Table) -> pa.Table:
    """Of a range: to each block those of its tokens that stand in several sets, and in how many."""
    tokens = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
    places = [np.frombuffer(x, np.uint16) for x in rows.column("places").to_pylist()]
    count = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("counts").to_pylist()])
    _, of = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.minimum(np.bincount(of, weights=count)[of], 2**32 - 1).astype(np.uint32)
    out, at = [], 0
    for t, p in zip(tokens, places):
        c = total[at : at + len(t)]
        at += len(t)
        keep = c > 1
        out.append((t[keep].tobytes(), p[keep].tobytes(), c[keep].tobytes()))
    return pa.table([rows.column("block"), rows.column("range"), *(pa.array([o[i] for o in out], pa.binary()) for i in range(3))], ["block", "range", "tokens", "places", "counts"])


def assembled(rows: pa.Table) -> pa.Table:
    """Of a block: its sets in the global order (rising counts, then the tokens themselves) without
    the tokens of one set alone, of which ``alone`` tells the number. Sets with too many are left out."""
    kind = rows.column("range").to_numpy()
    tokens, places, counts = (rows.column(c).to_pylist() for c in ("tokens", "places", "counts"))
    sets, own = int(np.flatnonzero(kind == SETS)[0]), int(np.flatnonzero(kind == OWN)[0])
    size = np.frombuffer(counts[sets], np.uint32).astype(np.int64)
    answers = np.flatnonzero(kind >= 0).tolist()
    gather = lambda x, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(x[i], t) for i in answers)])
    token, place, count = gather(tokens, np.uint64), gather(places, np.uint16), gather(counts, np.uint32)
    one = place != SEVERAL
    mine, at = np.frombuffer(tokens[own], np.uint64), np.frombuffer(places[own], np.uint16)
    order = np.argsort(token[~one])
    known, often = token[~one][order], count[~one][order]
    token = np.r_[token[one], mine]
    place = np.r_[place[one], at].astype(np.int64)
    count = np.r_[count[one], often[np.searchsorted(known, mine)]]
    order = np.lexsort((token, count, place))
    token = token[order]
    ends = np.cumsum(np.bincount(place, minlength=len(size)))
    begins = np.r_[0, ends[:-1]]
    keep = np.flatnonzero(ends - begins >= least_overlap(size))
    items = [token[begins[i] : ends[i]].tobytes() for i in keep.tolist()]
    sigs = [tokens[sets][16 * i : 16 * i + 16] for i in keep.tolist()]
    return pa.table([pa.array(sigs, pa.binary()), pa.array(size[keep].astype(np.int32)), pa.array((size - ends + begins)[keep].astype(np.int32)), pa.array(items, pa.binary())], ["sig", "n", "alone", "items"])


def prefix_rows(sets: DataFrame) -> DataFrame:
    """The tokens of each set's prefix that other sets have too, with their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "items", PIECE):
                n, alone = (piece.column(c).to_numpy().astype(np.int64) for c in ("n", "alone"))
                k = np.maximum(0, n - least_overlap(n) + 1 - alone)
                token = np.concatenate([np.frombuffer(x, np.int64)[:c] for x, c in zip(piece.column("items").to_pylist(), k.tolist())])
                pos = np.arange(len(token)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(alone, k)
                row = pa.array(np.repeat(np.arange(len(n)), k))
                yield pa.RecordBatch.from_arrays([pa.array(token), *(piece.column(c).take(row) for c in ("sig", "n", "alone")), pa.array(pos.astype(np.int32))], ["token", "sig", "n", "alone", "pos"])

    return sets.mapInArrow(tidy(run), "token long, sig binary, n int, alone int, pos int")


#: Whether a pair can link if its first common token stands at pos and l.pos. Linked sets have their first
#: common token in both prefixes, so a pair needs to pass at one of its common tokens only.
MAY_LINK = f"{NUM + DEN} * least(n - pos, l.n - l.pos) >= {NUM} * (n + l.n)"


def dealt(rows: DataFrame) -> DataFrame:
    """Prefix rows whose token several sets have, dealt over ``salts`` parts where these are many.

    At most as many tokens as bounded by the raised limit are that frequent; they are broadcast."""
    sizes = stored(rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "ngram-sizes")
    total = sizes.agg(F.sum("c")).first()[0] or 0
    limit = max(HOT_ROWS, total // 500_000)
    hot = sizes.where(F.col("c") > limit).select("token", F.ceil(F.col("c") / limit).cast("int").alias("salts"))
    rows = rows.join(F.broadcast(hot), "token", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("sig"), "salts").cast("int"))
    spread = sizes.join(F.broadcast(hot), "token", "left").select("token", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    out = stored(rows.join(spread, ["token", "salt"], "left_semi"), "ngram-rows")
    dropped(sizes)
    return out


def spread_over(found: DataFrame) -> DataFrame:
    """Rows of tokens (with ``salts``), once for each part of their rows."""
    return found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def starred(rows: DataFrame) -> DataFrame:
    """Pairs (a, b): at every token with sets of different components the leader, and the sets of other
    components that can link with it. The leader has the fewest tokens of its own."""
    leaders = (
        rows.groupBy("token")
        .agg(F.min(F.struct("alone", "n", "sig", "pos", "component")).alias("l"), F.min("component").alias("from"), F.max("component").alias("to"), F.first("salts").alias("salts"))
        .where("`from` <> `to`")
        .select("token", "salts", "l")
    )
    near = rows.drop("salts").join(spread_over(leaders), ["token", "salt"]).where("component <> l.component and " + MAY_LINK)
    return near.select(F.col("l.sig").alias("a"), F.col("sig").alias("b")).distinct()


def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a token's sets in different components that can link.

    Rows are sorted by (token, part, other, own): first some of the rows outside the token's largest
    component, which are held; then some of all its rows, only read against them.
    """
    key, held = None, None
    waiting: list[tuple[list[bytes], list[bytes]]] = []
    total = 0

    def out() -> pa.RecordBatch:
        pairs = {(min(a, b), max(a, b)) for x, y in waiting for a, b in zip(x, y)}
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        token, part, other, own, n, pos = (batch.column(c).to_numpy().astype(np.int64) for c in ("token", "part", "other", "own", "n", "pos"))
        sig, component = (np.array(batch.column(c).to_pylist(), object) for c in ("sig", "component"))
        if not len(token):
            continue
        begin = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (part[1:] != part[:-1]) | (other[1:] != other[:-1])])
        for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(token)]):
            if (token[i], part[i], other[i]) != key:
                key, held = (token[i], part[i], other[i]), [np.zeros(0, object), np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            first = i + int(np.searchsorted(own[i:j], 1))
            held = [np.concatenate([h, x[i:first]]) for h, x in zip(held, (sig, component, n, pos))]
            for k in range(first, j):
                fit = (NUM + DEN) * np.minimum(n[k] - pos[k], held[2] - held[3]) >= NUM * (n[k] + held[2])
                at = np.flatnonzero(fit & (held[1] != component[k]))
                if len(at):
                    waiting.append(([sig[k]] * len(at), held[0][at].tolist()))
                    total += len(at)
                    if total > 100_000:
                        yield out()
                        waiting, total = [], 0
    if waiting:
        yield out()


def crossed(rows: DataFrame) -> DataFrame:
    """All pairs (a, b) of prefix neighbours in different components that can link.

    A token's rows outside its largest component meet all its rows, part by part."""
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("c"), F.first("salts").alias("salts"))
    mixed = sizes.groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("top"), F.count("*").alias("k"), F.first("salts").alias("salts")).where("k > 1")
    near = rows.join(spread_over(mixed.select("token", "top", "salts")), ["token", "salt"])
    each = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    columns = ["token", "sig", "component", "n", "pos"]
    own = near.select(*columns, F.col("salt").alias("part"), each.alias("other"), F.lit(1).alias("own"))
    outside = near.where("component <> top").select(*columns, each.alias("part"), F.col("salt").alias("other"), F.lit(0).alias("own"))
    keys = ["token", "part", "other"]
    return own.unionByName(outside).repartition(*keys).sortWithinPartitions(*keys, "own").mapInArrow(tidy(crossing), "a binary, b binary").distinct()


class Tree:
    """A prefix tree of sets, as sequences in the global order from its frequent end, with one node for
    every path without branches. ``longest`` and ``least`` bound the tokens and the sizes of the sets below."""

    def __init__(self, members: list[np.ndarray], sizes: list[int]) -> None:
        """``members`` are the kept tokens, ``sizes`` the sizes with the tokens that aren't kept."""
        paths = [m[::-1] for m in members]
        order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u8").tobytes())
        #: Of each node: its tokens, depth, children, sets that end here, longest, least.
        self.tokens: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.depth, self.longest, self.least = [0], [0], [1 << 62]
        self.children: list[list[int]] = [[]]
        self.ends: list[list[int]] = [[]]
        trail, before = [0], np.zeros(0, np.uint64)  # the nodes from the root to the last set's end
        for i in order:
            path = paths[i]
            m = min(len(path), len(before))
            differs = np.flatnonzero(path[:m] != before[:m])
            shared = int(differs[0]) if len(differs) else m
            last = None
            while self.depth[trail[-1]] > shared:
                last = trail.pop()
            if self.depth[trail[-1]] < shared:  # the shared part ends inside the node that was left last
                keep = shared - self.depth[trail[-1]]
                upper = self.node(self.tokens[last][:keep], shared)
                self.children[trail[-1]][-1] = upper
                self.tokens[last] = self.tokens[last][keep:]
                self.children[upper].append(last)
                trail.append(upper)
                self.longest[upper], self.least[upper] = self.longest[last], self.least[last]
            if len(path) > shared:
                new = self.node(path[shared:], len(path))
                self.children[trail[-1]].append(new)
                trail.append(new)
            self.ends[trail[-1]].append(i)
            for t in trail:
                self.longest[t] = max(self.longest[t], len(path))
                self.least[t] = min(self.least[t], sizes[i])
            before = path
        self.sizes = sizes

    def node(self, tokens: np.ndarray, depth: int) -> int:
        self.tokens.append(tokens)
        self.depth.append(depth)
        self.longest.append(0)
        self.least.append(1 << 62)
        self.children.append([])
        self.ends.append([])
        return len(self.depth) - 1

    def linked(self, probe: np.ndarray, size: int) -> list[int]:
        """The sets that link with the probe (its kept tokens, and its size)."""
        known, found, todo = np.sort(probe), [], [(0, 0)]
        while todo:
            at, overlap = todo.pop()
            tokens = self.tokens[at]
            if len(tokens) and len(known):
                place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                overlap += int(np.count_nonzero(known[place] == tokens))
            found += [i for i in self.ends[at] if overlap >= needed(size, self.sizes[i])]
            for child in self.children[at]:
                rest = min(self.longest[child] - self.depth[at], len(probe) - overlap)
                if overlap + rest >= needed(size, self.least[child]):
                    todo.append((child, overlap))
        return found


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by (a, salt, role): a probe (role 0), then its candidates; gives the links."""
    key, probe, size, sigs, sets, sizes, held = None, None, 0, [], [], [], 0

    def out() -> pa.RecordBatch:
        good = [sigs[i] for i in Tree(sets, sizes).linked(probe, size)]
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(good), pa.binary()), pa.array(good, pa.binary())], ["a", "b"])

    for batch in batches:
        for a, salt, role, sig, n, items in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "role", "sig", "n", "items"))):
            if (a, salt) != key or held > TREE_BYTES:
                if sets:
                    yield out()
                sigs, sets, sizes, held = [], [], [], 0
                key = (a, salt)
            s = np.frombuffer(items, np.uint64)
            if role == 0:
                probe, size = s, n
            else:
                sigs.append(sig)
                sets.append(s)
                sizes.append(n)
                held += len(items)
    if sets:
        yield out()


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. The candidates of one set meet it in trees of about TREE_SETS."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TREE_SETS).alias("parts"))
    shards = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("salt"))
    items = sets.select("sig", "n", "items")
    members = shards.join(items.withColumnRenamed("sig", "b"), "b").select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("sig"), "n", "items")
    probes = shards.select("a", "salt").distinct().join(items.withColumnRenamed("sig", "a"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("sig"), "n", "items")
    return probes.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(tidy(walked), "a binary, b binary")


def still_mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The prefix rows with the component of each set, without those of tokens whose sets all are in one:
    components only merge, so such a token gives no pair in any later round."""
    named = rows.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    mixed = named.groupBy("token").agg(F.min("component").alias("from"), F.max("component").alias("to")).where("`from` <> `to`").select("token")
    return named.join(mixed, "token", "left_semi")


def able_texts(survey: DataFrame, own: DataFrame) -> DataFrame:
    """One text (h1, h2) of each set that may link with another, as far as the survey tells."""
    inside = survey.where("range is null and places is not null").select("block", "places")
    again = survey.where("range is not null").select("block", "range", "marks", "places").groupBy("range").applyInArrow(met_again, "block long, places binary")
    shared = inside.unionByName(again).groupBy("block").applyInArrow(shared_tokens, "block long, place int, shared int")
    known = own.where("sig is not null").join(shared, ["block", "place"], "left")
    allowed = F.expr(f"n - ({NUM} * n + {DEN - 1}) div {DEN}")
    able = known.where(F.col("low") - F.coalesce("shared", F.lit(0)) <= allowed)
    return able.groupBy("sig").agg(F.min(F.struct("h1", "h2")).alias("h")).select("h.h1", "h.h2")


def set_links(docs: DataFrame, chosen: DataFrame, log_ranges: int) -> DataFrame:
    """Of the sets of the chosen texts (h1, h2) that link with any other: node (a set's name) and
    component (the least name linked)."""
    spark = docs.sparkSession
    sent = stored(token_rows(chosen_texts(docs, chosen), log_ranges), "ngram-tokens")
    kinds = "block long, range long, tokens binary, places binary, counts binary"
    answers = sent.where("range >= 0").groupBy("range").applyInArrow(counted, kinds)
    sets = stored(sent.where("range < 0").unionByName(answers).groupBy("block").applyInArrow(assembled, "sig binary, n int, alone int, items binary"), "ngram-sets")
    dropped(sent)
    dropped(chosen)
    released(spark)

    rows = dealt(prefix_rows(sets))
    released(spark)
    named, links, labels = rows.withColumn("component", F.col("sig")), None, None
    while True:
        pairs = stored(starred(named), "ngram-pairs")
        found = stored(linked(pairs, sets), "ngram-links")
        fresh = found.count()
        dropped(pairs)
        released(spark)
        if fresh:
            links = found if links is None else links.unionByName(found)
            labels = stored(components(links, "a", "b"), "ngram-components")
            # later rounds read only what can still give a pair
            named = stored(still_mixed(rows, labels), "ngram-rows")
            few = stored(sets.join(named.select("sig").distinct(), "sig", "left_semi"), "ngram-sets")
            for old in (rows, sets):
                dropped(old)
            rows, sets = named.drop("component"), few
            released(spark)
        else:
            if labels is None:
                links, labels = found, stored(components(found, "a", "b"), "ngram-components")
            break
    pairs = stored(crossed(named), "ngram-pairs")
    released(spark)
    last = stored(linked(pairs, sets), "ngram-links")
    out = labels
    if not last.isEmpty():
        out = stored(components(links.unionByName(last), "a", "b"), "ngram-components")
    for old in (pairs, rows, sets):
        dropped(old)
    released(spark)
    return out


def named_components(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, h1, h2, n, sig, component): a document's set, and the least name it links to."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log_ranges = log_ranges_of(size)
    survey = stored(surveyed(docs, log_ranges), "ngram-survey")
    own = stored(survey.where("n is not null").select("doc_id", "h1", "h2", "n", "sig", "block", "place", "low"), "ngram-documents")
    chosen = stored(able_texts(survey, own), "ngram-chosen")
    dropped(survey)
    released(docs.sparkSession)
    labels = set_links(docs, chosen, log_ranges)
    return own.select("doc_id", "h1", "h2", "n", "sig").join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))


def join_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links).

    Null and empty texts, and texts of white space, have the empty set and are linked with
    nothing. Texts of fewer than five words have one shingle. Repeated rows are each answered
    and link with each other; a null doc_id never names a component with others in it. Extra
    columns are not read. An empty table gives no rows; very long texts are read in pieces.
    """
    named = named_components(docs)
    least = named.where("sig is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def row_keys(doc_id: Column, h1: Column, h2: Column, names: list[str]) -> list[Column]:
    """Columns without nulls that name a row by its doc_id and text."""
    return [c.alias(n) for c, n in zip((h1, h2, F.coalesce(doc_id.cast("string"), F.lit("")), doc_id.isNull()), names)]


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the one with the least doc_id (null
    ones last; of several such rows the least text hash, then any). Documents without words all
    stay. An empty table gives no rows; columns of any names are kept; very long texts are read in pieces."""
    named = named_components(docs).where("sig is not null")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("x"))
    keys = [unused(n, docs.columns) for n in ("__h1", "__h2", "__id", "__none")]
    first = first.select(*row_keys(F.col("x.doc_id"), F.col("x.h1"), F.col("x.h2"), keys))
    empty = F.col("text").isNull() | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    full = docs.where(~empty).select("*", *row_keys(F.col("doc_id"), *text_keys(), keys))
    return full.join(first, keys, "left_semi").dropDuplicates(keys).drop(*keys).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(empty))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by 0.75 of their five-word shingles, as components; see ``join_components``."""
    return join_components(table(spark, sf_dir, "documents"))
