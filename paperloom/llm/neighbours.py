"""Approximate nearest neighbours: NN-descent graphs, searched greedily.

Equal vectors are one node. Nodes are dealt over shards by a hash of their vector, so many that a shard
holds about 32 times the root of the table's rows. A shard's graph starts from neighbours along a few
random projections; each round compares every node's neighbours (both directions) with each other, and
keeps every node's nearest. A query walks the graph of every shard, always expanding the nearest
unexpanded nodes of a beam; the nearest of all shards are the result. Distances of the result are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, stored, table, tidy


#: Neighbours that a node of a local join is told of in a round.
JOINED = 8

#: Nodes of a shard at most, so that a task's memory is bounded.
SHARD = 1 << 16


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (id, vec) whose vector is whole, finite and not zero. Of differing lengths the shorter
    ones are filled up with zeros."""
    v = F.col(column).cast("array<double>")
    good = vectors.select(F.col(key).alias("id"), v.alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    )
    size = good.agg(F.max(F.size("vec"))).first()[0] or 0
    return good.select("id", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("vec"))).alias("vec"))


def node_table(good: DataFrame, spare: int) -> DataFrame:
    """One row per differing vector: node (a number, to be written down), ids (its ``spare`` least ids), vec."""
    first = Window.partitionBy("vec").orderBy("id")
    few = good.withColumn("r", F.row_number().over(first)).where(F.col("r") <= spare)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("node"), "ids", "vec")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def shards_for(rows: int) -> int:
    """How many shards: with the root of the table, so that what a query meets in all grows with the root too."""
    return max(1, math.ceil(math.sqrt(rows) / 32), math.ceil(rows / SHARD))


def places(groups: np.ndarray) -> np.ndarray:
    """The place of each value in its run of equal ones."""
    begin = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])[: len(groups)]
    return np.arange(len(groups)) - np.repeat(begin, np.diff(np.r_[begin, len(groups)]))


def differing(keys: np.ndarray) -> np.ndarray:
    """The differing keys, sorted; np.unique takes much longer."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]]


def squares(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of rows i of a and rows j of b, some thousands at once."""
    found = np.empty(len(i))
    for s in range(0, len(i), 1 << 14):
        gap = a[i[s : s + (1 << 14)]] - b[j[s : s + (1 << 14)]]
        found[s : s + (1 << 14)] = np.einsum("ij,ij->i", gap, gap)
    return found


def scaled(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Rows divided by a power of two, so that no square leaves the range of a double."""
    by = 2.0 ** min(1000, int(np.frexp(np.abs(x).max(initial=0.0))[1]))
    return x / by, by


def axes(width: int, projections: int = 8, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, projections))


#: nbr, d, fresh of every node: its neighbours so far, nearest first. Missing ones are the node itself at infinity.
Lists = tuple[np.ndarray, np.ndarray, np.ndarray]


def no_lists(n: int, k: int) -> Lists:
    return np.repeat(np.arange(n)[:, None], k, axis=1), np.full((n, k), np.inf), np.zeros((n, k), bool)


def merged(lists: Lists, v: np.ndarray, c: np.ndarray, d: np.ndarray) -> Lists:
    """The nearest of the lists and of new neighbours c of v, none of which is in its list; those are fresh now."""
    n, k = lists[0].shape
    order = np.lexsort((c, d, v))
    r = places(v[order])
    order, r = order[r < k], r[r < k]
    new = no_lists(n, k)
    for into, value in zip(new, (c[order], d[order], True)):
        into[v[order], r] = value
    both = [np.concatenate(x, axis=1) for x in zip((*lists[:2], np.zeros((n, k), bool)), new)]
    near = np.argsort(both[1], axis=1, kind="stable")[:, :k]
    return tuple(np.take_along_axis(x, near, axis=1) for x in both)


def both_ways(lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Of every node its neighbours and the ``k`` nearest that have it, with itself in place of missing and
    repeated ones; which of them are fresh."""
    nbr, d, fresh = lists
    n, k = nbr.shape
    order = np.lexsort((d.ravel(), nbr.ravel()))
    order = order[np.isfinite(d.ravel()[order])]
    to = nbr.ravel()[order]
    r = places(to)
    order, to, r = order[r < k], to[r < k], r[r < k]
    back, _, new = no_lists(n, k)
    back[to, r], new[to, r] = order // k, fresh.ravel()[order]
    here = np.arange(n)[:, None]
    own = np.sort((here * n + nbr).ravel())
    twice = own[np.minimum(np.searchsorted(own, here * n + back), len(own) - 1)] == here * n + back
    # a pair is fresh if either has the other anew
    again = np.sort((here * n + back)[twice & new])
    if len(again):
        fresh = fresh | (again[np.minimum(np.searchsorted(again, here * n + nbr), len(again) - 1)] == here * n + nbr)
    return np.concatenate([nbr, np.where(twice, here, back)], axis=1), np.concatenate([fresh, new & ~twice], axis=1)


def joined(x: np.ndarray, lists: Lists) -> Lists:
    """A round: every node's neighbours, both ways, are compared with each other; see ``descent``."""
    n, k = lists[0].shape
    beside, fresh = both_ways(lists)
    busy = np.flatnonzero(fresh.any(axis=1))
    beside = np.concatenate([beside, np.arange(n)[:, None]], axis=1)[busy]
    fresh = np.concatenate([fresh, np.zeros((n, 1), bool)], axis=1)[busy]
    missing = beside == busy[:, None]
    missing[:, -1] = False
    w = 2 * k + 1
    size, worst, found = np.einsum("ij,ij->i", x, x), lists[1][:, -1], [np.zeros(0, np.int64)]
    for s in range(0, len(busy), step := max(1, (1 << 21) // (w * w))):
        b, f = beside[s : s + step], fresh[s : s + step]
        y = x[b]
        # squared distances of members a (second axis) and e (third), but for a's own size
        d = y @ y.transpose(0, 2, 1)
        d *= -2
        d += np.where(missing[s : s + step], np.inf, size[b])[:, None, :]
        d[:, np.arange(w), np.arange(w)] = np.inf
        d[~(f[:, :, None] | f[:, None, :])] = np.inf
        most = np.minimum(np.partition(d, min(JOINED, w) - 1, axis=2)[:, :, min(JOINED, w) - 1], np.where(missing[s : s + step], -np.inf, worst[b] - size[b]))
        i, a, e = np.nonzero((d <= most[:, :, None]) & (d < np.inf))
        found.append(differing(b[i, a] * n + b[i, e]))
    key, own = differing(np.concatenate(found)), np.sort((np.arange(n)[:, None] * n + lists[0]).ravel())
    v, c = np.divmod(key[own[np.minimum(np.searchsorted(own, key), len(own) - 1)] != key], n)
    d = squares(x, v, x, c)
    near = (d < worst[v]) & (v != c)
    return merged(lists, v[near], c[near], d[near])


def descent(x: np.ndarray, k: int = 40, still: float = 0.05, reach: int = 4) -> np.ndarray:
    """The neighbour graph of rows: ``k`` neighbours of each, nearest first, or all others if fewer; itself where
    one is missing. The rounds end when one brings at most ``still`` of all neighbours anew.

    The graph is approximate by its method: a round compares all of a node's neighbours, its own ``k`` and the
    ``k`` nearest that have it as theirs, and passes on to each of them the 8 nearest of these (JOINED).
    The search looks at edges both ways, whatever their number."""
    n = len(x)
    if n <= k + 1:
        return np.array([[j for j in range(n) if j != i] for i in range(n)], np.int64).reshape(n, n - 1)
    x = x - x.mean(axis=0)
    along = x @ axes(x.shape[1])
    pairs = []
    for t in range(along.shape[1]):
        order = np.argsort(along[:, t], kind="stable")
        for j in range(1, reach + 1):
            pairs += [order[j:] * n + order[:-j], order[:-j] * n + order[j:]]
    v, c = np.divmod(differing(np.concatenate(pairs)), n)
    lists = merged(no_lists(n, k), v, c, squares(x, v, x, c))
    while lists[2].sum() > still * n * k:
        lists = joined(x, lists)
    return lists[0]


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, node, vec) sorted by shard: those of a shard with their places in it and their neighbours' places."""

    def graph(rows: pa.Table) -> list[pa.RecordBatch]:
        rows = rows.combine_chunks()
        nbr = descent(scaled(matrix(rows.column("vec")))[0])
        keep = nbr != np.arange(len(nbr))[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep.sum(axis=1))].astype(np.int32)), pa.array(nbr[keep].astype(np.int32)))
        return pa.Table.from_arrays([rows.column("shard"), pa.array(np.arange(len(nbr), dtype=np.int32)), rows.column("node"), rows.column("vec"), lists], ["shard", "place", "node", "vec", "nbrs"]).to_batches(2000)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for piece in runs(batch, batch.column("shard").to_numpy()):
            if held and held[0].column("shard")[0] != piece.column("shard")[0]:
                yield from graph(pa.Table.from_batches(held))
                held = []
            held.append(piece)
    if held:
        yield from graph(pa.Table.from_batches(held))


def runs(batch: pa.RecordBatch, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch cut where its key changes."""
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
        if j > i:
            yield batch.slice(i, j - i)


def build_graph(nodes: DataFrame, shards: int) -> DataFrame:
    """The neighbour graphs of all shards: shard, place (in the order of least ids), node, vec, nbrs (places)."""
    dealt = nodes.select(F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), F.get("ids", F.lit(0)).alias("least"), "node", "vec")
    dealt = dealt.repartition(4 * shards, "shard").sortWithinPartitions("shard", "least", "node")
    return dealt.select("shard", "node", "vec").mapInArrow(tidy(described), "shard int, place int, node long, vec array<double>, nbrs array<int>")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows. Where squares leave the range of a double, components are scaled first."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.sqrt(((a - b) ** 2).sum(axis=1))
        for i in np.flatnonzero(~np.isfinite(d) | (d == 0)):
            gap = a[i] - b[i]
            most = np.abs(gap).max()
            if most and np.isfinite(most):
                d[i] = most * np.sqrt(((gap / most) ** 2).sum())
    return d


class Index:
    """A shard: its nodes and vectors by place, the edges of its graph both ways, its order along projections."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.node, self.vec = rows.column("node").to_numpy(), matrix(rows.column("vec"))
        self.x, self.by = scaled(self.vec)
        n, lists = len(self.node), rows.column("nbrs").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        to, of = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        of, self.nbrs = np.divmod(differing(np.r_[of * n + to, to * n + of]), n)
        self.first = np.searchsorted(of, np.arange(n + 1))
        along = self.x @ axes(self.x.shape[1])
        self.order = np.argsort(along, axis=0, kind="stable")
        self.along = np.take_along_axis(along, self.order, axis=0)

    def nearest(self, qid: np.ndarray, qvec: np.ndarray, keep: int) -> pa.RecordBatch:
        """Of each query its ``keep`` nearest nodes found here, and those as far as the last of them."""
        at = {x: i for i, x in enumerate(self.node.tolist())} if len(qid) else {}
        own = np.array([at.get(x, -1) for x in qid.tolist()], np.int64)
        best = walked(self, np.clip(qvec / self.by, -1e150, 1e150), own, max(beam_for(len(self.node)), keep))
        who, j = np.nonzero(best >= 0)
        c = best[who, j]
        d = distances(qvec[who], self.vec[c])
        order = np.lexsort((c, d, who))
        who, c, d = who[order], c[order], d[order]
        last = np.full(len(qid), np.inf)
        kth = places(who) == keep - 1
        last[who[kth]] = d[kth]
        near = d <= last[who]
        return pa.RecordBatch.from_arrays([pa.array(qid[who[near]]), pa.array(self.node[c[near]]), pa.array(d[near])], ["qid", "node", "d"])


def walked(index: Index, q: np.ndarray, own: np.ndarray, beam: int) -> np.ndarray:
    """Greedy search of rows q, at most ``beam`` nearest places each, nearest first, -1 for none. A search starts at the
    nodes beside its query along the projections, at some dealt evenly and at the query's own place, where it has one.

    A hop expands the 8 nearest unexpanded nodes of a beam; the search ends when none of any query is left. No
    distance is measured twice."""
    x, m = index.x, len(q)
    n = len(x)
    starts = [np.repeat(np.linspace(0, n - 1, min(n, 64)).astype(np.int64)[None], m, axis=0), np.where(own < 0, 0, own)[:, None]]
    for order, along, at in zip(index.order.T, index.along.T, (q @ axes(x.shape[1])).T):
        starts.append(order[np.clip(np.searchsorted(along, at)[:, None] + np.arange(-4, 4), 0, n - 1)])
    c = np.concatenate(starts, axis=1)
    who, c = np.repeat(np.arange(m), c.shape[1]), c.ravel()
    seen = np.zeros(m * n, bool)
    best, d, done = np.full((m, beam), -1), np.full((m, beam), np.inf), np.ones((m, beam), bool)
    while True:
        key = differing(who * n + c)
        key = key[~seen[key]]
        seen[key] = True
        who, c = np.divmod(key, n)
        far = squares(q, who, x, c)
        near = np.flatnonzero(far < d[who, -1])
        near = near[np.lexsort((c[near], far[near], who[near]))]
        r = places(who[near])
        near, r = near[r < beam], r[r < beam]
        w = r.max(initial=-1) + 1
        new = np.full((m, w), -1), np.full((m, w), np.inf), np.ones((m, w), bool)
        for into, value in zip(new, (c[near], far[near], False)):
            into[who[near], r] = value
        best, d, done = (np.concatenate(z, axis=1) for z in zip((best, d, done), new))
        order = np.lexsort((best, d))[:, :beam]
        best, d, done = (np.take_along_axis(z, order, axis=1) for z in (best, d, done))
        opened = ~done & (np.cumsum(~done, axis=1) <= 8)
        if not opened.any():
            return best
        done |= opened
        who, node = np.nonzero(opened)[0], best[opened]
        size = index.first[node + 1] - index.first[node]
        c = index.nbrs[np.repeat(index.first[node] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
        who = np.repeat(who, size)


def found_in(keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by shard, a shard's graph by place and then its queries (which have a qid): qid, node, d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        index = None
        for batch in batches:
            asked = batch.column("qid").is_valid().to_numpy(zero_copy_only=False)
            for piece in runs(batch, batch.column("shard").to_numpy() * 2 + asked):
                if piece.column("qid")[0].is_valid:
                    index = index or Index(pa.Table.from_batches(held))
                    qid, qvec = piece.column("qid").to_numpy(), matrix(piece.column("vec"))
                    for s in range(0, len(qid), 128):
                        yield index.nearest(qid[s : s + 128], qvec[s : s + 128], keep)
                else:
                    if index or held and held[0].column("shard")[0] != piece.column("shard")[0]:
                        held, index = [], None
                    held.append(piece)

    return run


def search(queries: DataFrame, graph: DataFrame, shards: int, keep: int) -> DataFrame:
    """Greedy search from each query (qid, qvec), which is a node itself, in the graph of every shard: the
    ``keep`` nearest met in each, and those as far as the last of them, as qid, node, d."""
    everywhere = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "qid", F.col("qvec").alias("vec"))
    rows = graph.withColumn("qid", F.lit(None).cast("long")).unionByName(everywhere, allowMissingColumns=True)
    rows = rows.repartition(4 * shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("qid"), "place")
    return rows.select("shard", "qid", "node", "vec", "nbrs").mapInArrow(tidy(found_in(keep)), "qid long, node long, d double")


def beam_for(rows: int) -> int:
    """How many of the nearest nodes a search goes on from: with the logarithm of the shard, so that
    what a query meets there hardly grows."""
    return max(64, math.ceil(10 * math.log2(max(2, rows))))


def self_search(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; candidates all rows but the query's own.

    Result: query_id, rank, vec_id, score (Euclidean distance of the original vectors, in double
    precision), the ``k`` nearest found, ties to the smaller id. Null vectors, zero ones and those
    with null or non-finite components take no part; shorter vectors count as filled up with zeros.
    Of repeated ids each differing vector is a query, and each row a candidate. An empty table gives no rows; other columns are not read.
    """
    good = usable(vectors, key, column)
    nodes = stored(node_table(good, k + 1), "nodes")
    shards = shards_for(nodes.count())
    graph = stored(build_graph(nodes, shards), "graph")
    asked = stored(good.where(F.col("id") % every == 0).distinct().join(nodes.select("vec", "node"), "vec").select(F.col("id").alias("query_id"), F.col("node").alias("qid"), F.col("vec").alias("qvec")), "asked")
    found = stored(search(asked.select("qid", "qvec").dropDuplicates(["qid"]), graph, shards, k + 1), "found")
    dropped(graph)
    # a node has one row at least, so that k + 1 nodes hold k others; ties at the end are kept
    last = found.withColumn("r", F.rank().over(Window.partitionBy("qid").orderBy("d"))).where(F.col("r") <= k + 1)
    each = asked.select("query_id", "qid").join(last, "qid").join(nodes.select("node", "ids"), "node").select("query_id", "qid", "node", "ids", F.posexplode("ids").alias("place", "vec_id"), "d")
    # one row of the query's own node and id is the query itself
    each = each.where((F.col("node") != F.col("qid")) | (F.col("place") != F.array_position("ids", F.col("query_id")) - 1))
    best = Window.partitionBy("query_id", "qid").orderBy("d", "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector of ``embeddings``; see ``self_search``."""
    return self_search(table(spark, sf_dir, "embeddings"))
