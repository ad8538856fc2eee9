"""Near-duplicates by odd sketches: MinHash samples, folded into parity bitmaps, and bands of them.

Two documents link when the Jaccard similarity of their sets of two-word shingles is at least 0.8.

1. Every text is read once. Of its set, 256 MinHash samples are taken; each turns over one bit of a bitmap
   of 1024. Equal samples of two sets cancel when their bitmaps are XORed, so the bits left, z, tell how many
   samples differ, and with them the similarity: 1 + 1024 / (4 * 256) * ln(1 - 2 z / 1024). Equal sets,
   however many documents have them, go on as one.
2. 48 bands of 7 samples each make buckets; a pair at 0.8 misses all of them about once in 10,000 times.
3. In every bucket the set with the least number leads, the others of other components are compared with
   it by their odd sketches. A set's nearest two leaders, unless they are four deviations below the limit, are
   compared with it on full sets. Rounds follow until one finds few new links (a hundredth of all).
4. Then all sets of a bucket that still are in different components are compared, so that no link that the
   buckets hold is lost. What their odd sketches leave goes on as lists, a set with its partners, and meets
   the full sets in square blocks; only links come out, and of these only what joins two components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, slices, stored, table, text_keys, tidy
from .components import components
from .ngram_join import chosen_texts, dealt, mix, pa_type, shingle_sets, signature, spread_over

WORDS = 2
#: Similarity of a link, as a fraction.
NUM, DEN = 80, 100
SAMPLES, BITS, BANDS, ROWS = 256, 1024, 48, 7
#: Deviations of the estimate of a pair at the limit: of the share of equal samples, and of the bitmap's.
DEVIATION = float(np.hypot(np.sqrt(NUM / DEN * (1 - NUM / DEN) / SAMPLES), 0.01))
#: Bits by which the sketches of a pair that is compared on full sets differ at most: those of a pair four
#: deviations below the limit.
FAR = int(BITS / 2 * (1 - np.exp(-4 * SAMPLES / BITS * (1 - NUM / DEN + 4 * DEVIATION))))
#: Shingles hashed at once; pairs of one leader that go to one task; sets that a task remembers as sketched;
#: sets along a side of a block; leaders that a set is compared with on full sets in a round; parts of a
#: bucket that are compared at once.
CHUNK, HOT_PAIRS, KNOWN, SIDE, NEAREST, PARTS = 256, 500, 100_000, 256, 2, 4
#: The share of all links, as a divisor, that a round must bring for another to follow.
FEW = 100

_random = np.random.default_rng(12)
FACTORS = _random.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
#: The samples of each band: they are dealt out to bands as often as there is need, each time in another order.
BAND_SAMPLES = np.concatenate([_random.permutation(SAMPLES)[: SAMPLES // ROWS * ROWS].reshape(-1, ROWS) for _ in range(BANDS * ROWS // SAMPLES + 1)])[:BANDS]


def samples(s: np.ndarray) -> np.ndarray:
    """The least of the set's hashes under each of the 256 orders."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), CHUNK):
        np.minimum(low, (s[i : i + CHUNK, None] * FACTORS[None, :]).min(axis=0), out=low)
    return low


def odd_sketch(low: np.ndarray) -> bytes:
    """The parity bitmap of the samples, each with its number."""
    place = mix(low + np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def bands(low: np.ndarray) -> np.ndarray:
    """64-bit names of the buckets that the set is in."""
    name = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        name = mix(name * np.uint64(3) + low[BAND_SAMPLES[:, k]])
    return name


def estimate(z: np.ndarray) -> np.ndarray:
    """The similarity of two sets whose odd sketches differ in z bits."""
    return np.maximum(0, 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * np.asarray(z) / BITS)))


def differing(a: bytes, b: list[bytes]) -> np.ndarray:
    """In how many bits a sketch differs from each of others."""
    x = np.frombuffer(a, np.uint64) ^ np.frombuffer(b"".join(b), np.uint64).reshape(-1, BITS // 64)
    return np.bitwise_count(x).sum(axis=1)


def sketched(docs: DataFrame) -> DataFrame:
    """One pass over all texts: doc_id, keys h1 and h2 of the text, n (the set's size), name (null for the
    empty set), and buckets and sketch, null where the task has met the set before."""
    names = ["doc_id", "h1", "h2", "n", "name", "buckets", "sketch"]
    kinds = [pa_type(docs, "doc_id"), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = shingle_sets(piece.column("text"), WORDS)
                name = [signature(s) if len(s) else None for s in sets]
                buckets, sketch = [], []
                for s, x in zip(sets, name):
                    fresh = x is not None and x not in known
                    low = samples(s) if fresh else None
                    buckets.append(bands(low).view(np.int64) if fresh else None)
                    sketch.append(odd_sketch(low) if fresh else None)
                    if fresh:
                        known.add(x)
                if len(known) > KNOWN:
                    known.clear()
                given = [piece.column("doc_id"), piece.column("h1"), piece.column("h2"), [len(s) for s in sets], name, buckets, sketch]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(given, kinds)], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h1 long, h2 long, n int, name binary, buckets array<long>, sketch binary"
    return docs.select("doc_id", "text", *text_keys("h1", "h2")).mapInArrow(tidy(run), schema)


#: Sets of n and m shingles can link.
ALIKE = f"{DEN} * least(n, l.n) >= {NUM} * greatest(n, l.n)"


def led(rows: DataFrame) -> DataFrame:
    """Pairs (a, b): of every bucket with several components its leader, and the sets of other ones."""
    leaders = (
        rows.groupBy("token")
        .agg(F.min(F.struct("sig", "n", "component")).alias("l"), F.min("component").alias("from"), F.max("component").alias("to"), F.first("salts").alias("salts"))
        .where("`from` <> `to`")
        .select("token", "salts", "l")
    )
    near = rows.drop("salts").join(spread_over(leaders), ["token", "salt"]).where("component <> l.component and " + ALIKE)
    return near.select(F.col("l.sig").alias("a"), F.col("sig").alias("b")).distinct()


def compared(pairs: DataFrame, data: DataFrame, far: Callable[[bytes, list[bytes]], np.ndarray], most: int) -> DataFrame:
    """The pairs (a, b) that ``far`` says are ``most`` apart or less, and how much (z). ``data`` has sig, n, data.
    What ``a`` has comes once to its pairs, which are dealt over several tasks where they are many, and is
    compared as they are read."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("c"))
    limit = max(HOT_PAIRS, pairs.count() // 100_000)
    # 100,000 rows at most
    hot = sizes.where(F.col("c") > limit).select("a", F.ceil(F.col("c") / limit).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    shards = pairs.join(F.broadcast(hot), "a", "left").select("a", "b", part.alias("part"))
    members = shards.join(data.withColumnRenamed("sig", "b"), "b").select("a", "part", F.lit(1).alias("role"), "b", "data")
    probes = shards.select("a", "part").distinct().join(data.withColumnRenamed("sig", "a"), "a").select("a", "part", F.lit(0).alias("role"), F.col("a").alias("b"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = b""
        for batch in batches:
            for piece in slices(batch, "data"):
                a, part, role = (piece.column(c).to_numpy() for c in ("a", "part", "role"))
                data, b = piece.column("data").to_pylist(), piece.column("b")
                begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])])
                z = np.full(len(a), most + 1, np.int64)
                for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(a)]):
                    if role[i] == 0:
                        own = data[i]
                        i += 1
                    if i < j:
                        z[i:j] = far(own, data[i:j])
                keep = pa.array(z <= most)
                yield pa.RecordBatch.from_arrays([piece.column("a").filter(keep), b.filter(keep), pa.array(z).filter(keep)], ["a", "b", "z"])

    both = probes.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return both.mapInArrow(tidy(run), "a long, b long, z long")


def links_with(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, in order, link."""
    place = np.minimum(np.searchsorted(a, b), len(a) - 1)
    shared = int(np.count_nonzero(a[place] == b))
    return DEN * shared >= NUM * (len(a) + len(b) - shared)


def unlinked(own: bytes, sets: list[bytes]) -> np.ndarray:
    """0 for full sets that link, 1 for others."""
    mine = np.frombuffer(own, np.uint64)
    return np.array([not links_with(mine, np.frombuffer(other, np.uint64)) for other in sets], np.int64)


class Sets:
    """The full sets of the texts that a comparison asks for. Each round's missing ones are read and written."""

    def __init__(self, docs: DataFrame, texts: DataFrame) -> None:
        """``texts`` has sig, h1, h2: a text of each set."""
        self.docs, self.texts, self.parts = docs, texts, []

    def all(self) -> DataFrame:
        out = self.parts[0]
        for more in self.parts[1:]:
            out = out.unionByName(more)
        return out

    def of(self, asked: DataFrame) -> DataFrame:
        """sig, n, data of all sets that are in ``asked`` (sig), and maybe others."""
        asked = asked.distinct()
        if self.parts:
            asked = asked.join(self.all().select("sig"), "sig", "left_anti")
        chosen = stored(self.texts.join(asked, "sig", "left_semi"), "odd-chosen")
        if not self.parts or not chosen.isEmpty():

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for piece in slices(batch, "text"):
                        sets = shingle_sets(piece.column("text"), WORDS)
                        yield pa.RecordBatch.from_arrays([piece.column("h1"), piece.column("h2"), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["h1", "h2", "n", "data"])

            read = chosen_texts(self.docs, chosen.select("h1", "h2")).select("h1", "h2", "text").mapInArrow(tidy(run), "h1 long, h2 long, n int, data binary")
            self.parts.append(stored(read.join(chosen, ["h1", "h2"]).select("sig", "n", "data"), "odd-sets"))
        dropped(chosen)
        return self.all()

    def dropped(self) -> None:
        for part in self.parts:
            dropped(part)


def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's sets those in different components whose sketches are near, as lists: a set outside the
    bucket's largest component, and the partners it has in one side of a block.

    Rows are sorted by (token, part, other, own): first a part of the rows outside, which are held; then a part
    of all its rows, which are only read against them."""
    names = ("sig", "component", "n", "side")
    key, top, sides, held, found = None, 0, 1, None, {}
    empty = lambda: [*(np.zeros(0, np.int64) for _ in names), np.zeros((0, BITS // 64), np.uint64)]

    def out() -> Iterator[pa.RecordBatch]:
        for a in range(0, len(found), 1024):
            some = list(found.items())[a : a + 1024]
            yield pa.RecordBatch.from_arrays([pa.array([top] * len(some), pa.int64()), pa.array([sides] * len(some), pa.int32()), pa.array([x[0] for x, _ in some]), pa.array([x[1] for x, _ in some], pa.int32()), pa.array([ys for _, ys in some], pa.list_(pa.int64()))], ["top", "sides", "a", "side", "others"])

    for batch in batches:
        if not batch.num_rows:
            continue
        token, part, other, own = (batch.column(c).to_numpy() for c in ("token", "part", "other", "own"))
        columns = [batch.column(c).to_numpy().astype(np.int64) for c in names]
        sig, component, n, side = columns
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        begin = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (part[1:] != part[:-1]) | (other[1:] != other[:-1])])
        for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(token)]):
            if (token[i], part[i], other[i]) != key:
                yield from out()
                key, held, found = (token[i], part[i], other[i]), empty(), {}
                top, sides = batch.column("top")[i].as_py(), batch.column("sides")[i].as_py()
            first = i + int(np.searchsorted(own[i:j], 1))
            held = [np.concatenate([h, x[i:first]]) for h, x in zip(held, (*columns, sketch))]
            for k in range(first, j):
                fit = (held[1] != component[k]) & (DEN * np.minimum(held[2], n[k]) >= NUM * np.maximum(held[2], n[k]))
                at = np.flatnonzero(fit)
                at = at[np.bitwise_count(held[4][at] ^ sketch[k]).sum(axis=1) <= FAR] if len(at) else at
                for a in held[0][at].tolist():
                    found.setdefault((a, int(side[k])), []).append(int(sig[k]))
    yield from out()


def near_lists(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Lists (top, sides, a, side, others) of all sets that share a bucket, are in different components, and
    whose sketches are near: ``a`` stands outside the largest component, ``top``, of a bucket where it met the
    others. These are dealt over ``sides`` sides by their number, about as many as ``top`` fills."""
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("c"), F.first("salts").alias("salts"))
    mixed = sizes.groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("k"), F.first("salts").alias("salts")).where("k > 1")
    # of all buckets with the same largest component the fullest one tells the sides
    most = mixed.groupBy("top").agg(F.ceil(F.max("all") / SIDE).cast("int").alias("sides"))
    found = spread_over(mixed.join(most, "top").select("token", "top", "sides", "salts", F.col("salts").alias("parts")))
    both = rows.drop("salts").join(found, ["token", "salt"]).join(sketches.select("sig", F.col("data").alias("sketch")), "sig").withColumn("side", F.pmod(F.xxhash64("sig"), "sides").cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / PARTS).cast("int")))
    part = F.floor(F.col("salt") / PARTS).cast("int")
    columns = ["token", "sig", "component", "n", "sketch", "top", "sides", "side"]
    own = both.select(*columns, part.alias("part"), each.alias("other"), F.lit(1).alias("own"))
    outside = both.where("component <> top").select(*columns, each.alias("part"), part.alias("other"), F.lit(0).alias("own"))
    keys = ["token", "part", "other"]
    lists = own.unionByName(outside).repartition(*keys).sortWithinPartitions(*keys, "own").mapInArrow(tidy(crossing), "top long, sides int, a long, side int, others array<long>")
    return lists.groupBy("top", "a", "side").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))


class Forest(dict):
    """Components that links have joined so far."""

    def root(self, x: int) -> int:
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a: int, b: int) -> None:
        self[self.root(a)] = self.root(b)


BLOCK = ["top", "row", "side"]


def blocks_of(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists with the block that each goes to, and the others (sig) that a block needs, once each. A block
    has about SIDE sets with lists of one ``top``, and one side of the others."""
    tops = lists.groupBy("top").agg(F.ceil(F.approx_count_distinct("a") / SIDE).cast("int").alias("rows"))
    placed = lists.join(tops, "top").withColumn("row", F.pmod(F.xxhash64("a"), "rows").cast("int")).drop("rows")
    others = placed.groupBy(*BLOCK).agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    return placed, others.select(*BLOCK, F.explode("others").alias("sig"))


def in_blocks(placed: DataFrame, others: DataFrame, data: DataFrame, components_of: DataFrame) -> DataFrame:
    """Links (a, b) of full sets among the lists' pairs, enough of them to join all components that any join.
    ``data`` has sig, n, data; ``components_of`` has sig, component. A set comes to a block once."""
    full = data.join(components_of, "sig").select("sig", "component", "data")
    none = F.lit(None).cast("array<long>")
    held = others.join(full, "sig").select(*BLOCK, F.lit(0).alias("role"), "sig", "component", "data", none.alias("others"))
    given = placed.withColumnRenamed("a", "sig").join(full, "sig").select(*BLOCK, F.lit(1).alias("role"), "sig", "component", "data", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, forest = None, {}, Forest()
        for batch in batches:
            for piece in slices(batch, "data"):
                links: list[tuple[int, int]] = []
                for top, row, side, role, sig, component, items, partners in zip(*(piece.column(c).to_pylist() for c in (*BLOCK, "role", "sig", "component", "data", "others"))):
                    if (top, row, side) != key:
                        key, sets, forest = (top, row, side), {}, Forest()
                    if role == 0:
                        sets[sig] = (component, items)
                        continue
                    mine = np.frombuffer(items, np.uint64)
                    for other in partners:
                        its, data = sets[other]
                        if forest.root(component) != forest.root(its) and links_with(mine, np.frombuffer(data, np.uint64)):
                            forest.join(component, its)
                            links.append((sig, other))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return held.unionByName(given).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "role").mapInArrow(tidy(run), "a long, b long")


def set_links(docs: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Of the sets (sig, n, h1, h2, buckets, data) that link with any other: node and component."""
    sketches = sets.select("sig", "n", "data")
    texts = Sets(docs, sets.select("sig", "h1", "h2"))
    rows = dealt(sets.select("sig", "n", F.explode("buckets").alias("token")))
    named, tested, links, labels = rows.withColumn("component", F.col("sig")), None, None, None
    made, n_links = [], 0

    while True:
        pairs = led(named)
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "odd-pairs")
        near = stored(compared(pairs, sketches, differing, FAR).withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("z", "a"))), "odd-near")
        close = near.where(F.col("r") <= NEAREST).select("a", "b")
        full = texts.of(close.select(F.col("a").alias("sig")).unionByName(close.select(F.col("b").alias("sig"))))
        found = stored(compared(close, full, unlinked, 0).select("a", "b"), "odd-links")
        now = stored(pairs.join(near.where(F.col("r") > NEAREST), ["a", "b"], "left_anti"), "odd-tested")
        dropped(pairs)
        dropped(near)
        made += [found, now]
        tested = now if tested is None else tested.unionByName(now)
        fresh = found.count()
        n_links += fresh
        if not fresh:
            break
        links = found if links is None else links.unionByName(found)
        old, labels = labels, stored(components(links, "a", "b"), "odd-components")
        if old is not None:
            dropped(old)
        named = rows.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        if fresh * FEW <= n_links:  # the blocks find the rest, exactly
            break
    lists = stored(near_lists(named, sketches), "odd-lists")
    placed, others = blocks_of(lists)
    others = stored(others, "odd-blocks")
    full = texts.of(lists.select(F.col("a").alias("sig")).unionByName(others.select("sig")))
    last = stored(in_blocks(placed, others, full, named.select("sig", "component").distinct()), "odd-links")
    made += [lists, others, last]
    if not last.isEmpty():
        links = last if links is None else links.unionByName(last)
        old, labels = labels, stored(components(links, "a", "b"), "odd-components")
        if old is not None:
            dropped(old)
    for old in [rows, *made]:
        dropped(old)
    texts.dropped()
    return labels


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links), kept.

    Null and empty texts, and texts of white space, have the empty set and are linked with nothing. Texts of
    one word have it as their set. Repeated rows are each answered, link with each other and are all kept if
    one is; a null doc_id never names a component with others in it, and such a row is kept if its component
    has no other ids. Extra columns are not read. An empty table gives no rows; very long texts are read in
    pieces.
    """
    wide = stored(sketched(docs), "odd-sketches")
    # one row a set; its number names it from now on
    one = wide.where("buckets is not null").dropDuplicates(["name"])
    sets = stored(one.select("name", "h1", "h2", "n", "buckets", F.col("sketch").alias("data"), F.monotonically_increasing_id().alias("sig")), "odd-sets-named")
    own = stored(wide.select("doc_id", "n", "name"), "odd-documents")
    dropped(wide)
    labels = set_links(docs, sets)
    least = own.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    least = least.join(sets.select("name", "sig"), "name")
    component = F.col("sig")
    if labels is not None:
        least = least.join(labels.withColumnRenamed("node", "sig"), "sig", "left")
        component = F.coalesce("component", "sig")
    least = least.select("name", "rows", "least", component.alias("component"))
    firsts = least.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = stored(least.join(firsts, "component").select("name", "rows", "component_id"), "odd-answers")
    if labels is not None:
        dropped(labels)
    dropped(sets)
    return answered(own, answers).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def answered(own: DataFrame, answers: DataFrame) -> DataFrame:
    """Each document with its set's answer. Sets of very many documents are few, and are broadcast."""
    limit = max(500, (answers.agg(F.sum("rows")).first()[0] or 0) // 100_000)
    # 100,000 rows at most
    hot = answers.where(F.col("rows") > limit).select("name", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    met = own.select("doc_id", "n", "name").join(F.broadcast(hot), "name", "left")
    rest = met.where("hot is null").join(answers.where(F.col("rows") <= limit).select("name", "component_id"), "name", "left")
    return met.where("hot").select("doc_id", "n", F.col("hot_id").alias("component_id")).unionByName(rest.select("doc_id", "n", "component_id"))


def op12_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among ``documents`` at 0.8 of their two-word shingles; see ``near_copies``."""
    return near_copies(table(spark, sf_dir, "documents"))
