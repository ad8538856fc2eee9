"""Manifest, odd sketches and cohorts: against plain code, SQL, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import cohorts, langid, merkle, neighbours, ngram_join, odd_sketches, quality
from paperloom.llm.queries import QUERIES, SQL

from ..oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_line_dedup", "op11_merkle", "op13_cohorts"])
def test_same_as_sql(spark, name):
    got, want = differences(QUERIES[name](spark, SF), connect(SF), SQL[name])
    assert len(want) > 100 and got == want


# --- manifest -------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    """All levels, from the leaves to one node."""
    out = [nodes]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([sha(*now[i : i + 16]) for i in range(0, len(now), 16)])
    return out


def siblings_of(levels, i):
    path = []
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        path.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        i //= 16
    return path


DOCS = "doc_id long, source string, lang string, n_chars long, text string, root string, node int, idx int, `group` string"


def test_manifest_against_plain_code(spark, tmp_path):
    r, rows = random.Random(1), []
    for source, n in ((None, 3), ("", 1), ("a", 17), ("b", 16), ("c", 300), ("é", 2), ("z|", 33), *((f"s{i}", 1) for i in range(20))):
        rows += [(r.randrange(10**6), source, r.choice(["en", None]), r.choice([None, 5]), r.choice([None, "", "lower", "Über AB", "织 X" * 9])) for _ in range(n)]
    rows += [rows[30], rows[30], (None, "a", "en", 1, "No Id"), (None, "a", "en", 1, "No Id")]  # repeated rows, and ones without id
    r.shuffle(rows)
    spark.createDataFrame([(*x, "r", 1, 2, "g") for x in rows], DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda x: sha(*map(field, x))
    groups = defaultdict(list)
    for x in rows:
        groups[x[1]].append((x[0] is not None, x[0] or 0, leaf(x), x))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([g[2] for g in sorted(groups[s], key=lambda g: g[:3])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    want = []
    for s in names:
        for i, (_, _, own, x) in enumerate(sorted(groups[s], key=lambda g: g[:3])):
            path = siblings_of(trees[s], i) + siblings_of(top, names.index(s))
            back = own
            if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 5 == 0 and x[4] is not None:
                back = leaf((*x[:4], re.sub("[A-Z]", lambda m: m[0].lower(), x[4])))
            for before, after in path:
                back = sha(before, back, after)
            want.append((x[0], own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), back, back == top[-1][0]))
    got = [tuple(x) for x in merkle.op11_merkle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {True, False} == {x[-1] for x in want}


def test_manifest_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x", 1)], "doc_id long, source string, leaf string, path int")
    assert merkle.manifest(docs.limit(0).select("doc_id", "source", "leaf")).count() == 0
    one = merkle.manifest(docs.select("doc_id", "source", "leaf", F.col("path").alias("node"))).first()
    assert one.leaf == one.subroot == one.root == "x" and one.path == [] and one.node == 1
    long = spark.createDataFrame([(i, "s", "Ab " * 400_000) for i in range(3)], "doc_id long, source string, text string")
    digests = long.select("doc_id", "source", merkle.leaf_digest([F.col("text")]).alias("leaf"))
    assert merkle.manifest(digests).where("size(path) = 1").count() == 3


# --- odd sketches ---------------------------------------------------------------------------------


def test_estimates_of_odd_sketches():
    r = np.random.default_rng(3)
    for share in (0.7, 0.8, 0.9, 0.98):
        errors = []
        for _ in range(60):
            n = 600
            shared = round(2 * n * share / (1 + share))
            pool = r.integers(0, 1 << 63, 2 * n - shared, np.uint64) * np.uint64(2)
            a, b = (np.sort(x) for x in (pool[:n], pool[n - shared :]))
            z = odd_sketches.differing(odd_sketches.odd_sketch(odd_sketches.samples(a)), [odd_sketches.odd_sketch(odd_sketches.samples(b))])
            errors.append(float(odd_sketches.estimate(z)[0]) - shared / (2 * n - shared))
            assert share < 0.8 or z[0] <= odd_sketches.FAR
        assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.04
    assert odd_sketches.BAND_SAMPLES.shape == (odd_sketches.BANDS, odd_sketches.ROWS) and all(len(set(x)) == odd_sketches.ROWS for x in odd_sketches.BAND_SAMPLES.tolist())


def brute(rows):
    """Of each row its set's size, and the least doc_id of its component."""
    sets = {}
    for i, (_, text) in enumerate(rows):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in sets:
        least[find(i)].append(rows[i][0])
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((rows[i][0], len(sets[i]), ids[find(i)] if sets[i] else rows[i][0]) for i in sets), key=repr)


def near_texts(r):
    rows = []
    for base in range(9):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([1, 2, 6, 30, 200]))]
        for _ in range(r.randrange(1, 14)):
            copy = list(words)
            for _ in range(r.randrange(0, max(1, len(words) // 12))):
                copy[r.randrange(len(copy))] = f"x{r.randrange(99)}"
            rows.append((base * 100 + len(rows), " ".join(copy)))
            if r.random() < 0.3:
                words = copy  # the next ones are copies of the copy
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "oNE"), (905, rows[0][1].upper()), (rows[0][0], rows[0][1]), (None, rows[0][1]), (None, "alone without any id here"), (906, "a b a b"), (907, "b a b a")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_against_brute_force(spark, monkeypatch, small):
    if small:  # many parts, sides and blocks
        monkeypatch.setattr(odd_sketches, "SIDE", 3)
        monkeypatch.setattr(odd_sketches, "HOT_PAIRS", 4)
        monkeypatch.setattr(ngram_join, "HOT_ROWS", 5)
    rows = near_texts(random.Random(5 + small))
    docs = spark.createDataFrame([(*x, "c", "t", 1, "n") for x in rows], "doc_id long, text string, component string, token string, n int, name string").repartition(3)
    got = odd_sketches.near_copies(docs).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == brute(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)
    assert odd_sketches.near_copies(docs.limit(0)).count() == 0


def test_near_copies_that_no_leader_links(spark):
    """A chain: each text links with the next ones only, so that rounds and blocks have to find the rest."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(60)]
    got = {x.doc_id: x.component_id for x in odd_sketches.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(i, got[i]) for i in sorted(got)] == [(i, c) for i, _, c in sorted(brute(rows))]


# --- cohorts --------------------------------------------------------------------------------------

EVENTS = "click_id long, client_id long, ts timestamp_ntz, arrival timestamp_ntz, kind string, value double, start string, cut long"


def click_log(seed, n=700):
    r, base, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        ts = base + timedelta(seconds=r.randrange(40 * 86400), microseconds=r.choice([0, 1, 999_999]))
        arrival = ts + timedelta(seconds=r.choice([0, 1, 5, 86400 * 3, 86400 * 20]), microseconds=r.choice([0, 7]))
        client = r.choice([7] * 5 + list(range(12)) + [None])
        value = r.choice([None, 1.005, -3.555, 10.0, float("nan"), float("inf"), 0.125])
        rows.append((i, client, r.choice([ts] * 9 + [None]), r.choice([arrival] * 9 + [None]), r.choice(["signup", "view", "view", None]), value, "s", 1))
    return rows + rows[:40]


def matrix(rows, segments, cuts):
    """The cells by a plain walk over all states."""
    rows = [x for x in {repr(x): x for x in rows}.values() if x[1] is not None and x[2] is not None]
    day = lambda t: (t - datetime(1970, 1, 1)) // timedelta(days=1)
    start = {}
    for s, cut in enumerate(cuts):
        for x in rows:
            if (cut is None or x[3] is not None and x[3] < cut) and x[4] == "signup":
                start[s, x[1]] = min(start.get((s, x[1]), x[2]), x[2])
    cells = {}
    for s, cut in enumerate(cuts):
        for x in rows:
            begun = start.get((s, x[1]))
            if begun is None or x[2] < begun or not (cut is None or x[3] is not None and x[3] < cut):
                continue
            cell = cells.setdefault((s, segments.get(x[1]) or "", day(begun), (x[2] - begun) // timedelta(days=1)), [set(), 0])
            cell[0].add(x[1])
            cell[1] += int(np.floor(100 * x[5] + 0.5)) if x[5] is not None and np.isfinite(x[5]) else 0
    moved = {c for (_, c) in start if len({day(start[s, c]) for s in range(len(cuts)) if (s, c) in start}) > 1}
    return {k: (len(u), sum(zlib.crc32(str(c).encode()) for c in u), len(u & moved), cents) for k, (u, cents) in cells.items()}


@pytest.mark.parametrize("part_rows", [500, 3])
def test_cohorts_against_a_plain_walk(spark, monkeypatch, part_rows):
    monkeypatch.setattr(cohorts, "PART_ROWS", part_rows)
    rows, cuts = click_log(part_rows), [datetime(2024, 1, 20), None]
    names = [(c, s, datetime(2024, 1, d)) for c, s, d in ((7, "new", 9), (7, "old", 3), (1, None, 1), (2, "b", 1), (2, "b", 1), (99, "no clicks", 1), (None, "x", 1))]
    segments = spark.createDataFrame([(*x, 5) for x in names], "client_id long, segment string, updated_at timestamp_ntz, start int")
    got = cohorts.retention(spark.createDataFrame(rows, EVENTS).repartition(4), segments, cuts)
    found = {(x.state, x.segment, x.cohort, x.period): (x.users, x.users_crc32, x.moved, x.cents) for x in got.collect()}
    want = matrix(rows, {7: "new", 2: "b"}, cuts)
    assert found == want and any(x[2] for x in want.values())
    empty = spark.createDataFrame([], EVENTS)
    assert cohorts.retention(empty, segments, cuts).count() == 0
    assert cohorts.retention(spark.createDataFrame(rows[:50], EVENTS), segments.limit(0), cuts).where("segment <> ''").count() == 0


def test_timeline_is_a_running_minimum(spark):
    r = random.Random(8)
    rows = [(c, r.randrange(10**12), r.choice([r.randrange(5 * 10**11), r.randrange(10**7), cohorts.NEVER])) for c in (1, 1, 1, 2) for _ in range(80)]
    versions, _ = cohorts.timeline(spark.createDataFrame(rows, "client long, ts long, arrival long"))
    got = sorted((x.client, x.known, x.until, x.start) for x in versions.collect())
    want = []
    for c in (1, 2):
        low, mine = None, []
        for arrival in sorted({x[2] for x in rows if x[0] == c}):
            ts = min(x[1] for x in rows if x[0] == c and x[2] == arrival)
            if low is None or ts < low:
                low = ts
                mine.append((c, arrival, ts))
        want += [(c, a, b[1] if b else None, ts) for (c, a, ts), b in zip(mine, [*mine[1:], None])]
    assert got == sorted(want, key=lambda x: x[:2])


# --- bounds ---------------------------------------------------------------------------------------


def test_distances_out_of_range():
    a, b = np.array([[1e200, 0.0], [3e-200, 0.0], [3.0, 0.0]]), np.array([[0.0, 1e200], [0.0, 4e-200], [0.0, 4.0]])
    got = neighbours.distances(a, b)
    assert np.allclose(got / [2**0.5 * 1e200, 5e-200, 5.0], 1)


def test_fits_are_bounded(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long, "en"), (2, "short words", "en"), (3, long, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.learn(docs, labels, fold=5, folds=7, epochs=1, passages=8) is not None
    small = langid.learn(docs, language_bytes=1)  # less than any text: by chance one enters at most
    assert small.languages == ["en"] or list(small.languages) == ["en"]
