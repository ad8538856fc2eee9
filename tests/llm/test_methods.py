"""The operators' methods against plain ones, very long texts, and rows of odd kinds."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from paperloom.llm import decontamination, langid, line_dedup, lmscore, neighbours, ngram_join, packing, quality, secrets, toxicity
from paperloom.llm.common import utf8

from .test_operators import words

LONG = 5_000_000


@pytest.fixture(scope="module")
def long_docs(spark):
    r = random.Random(21)
    line = words(r, 400)
    text = (line + "\n") * (LONG // (len(line) + 1)) + "you are an idiot password=abcdefgh1"
    return spark.createDataFrame([(1, text, "s"), (2, "a short one", "s"), (3, None, "s")], "doc_id long, text string, source string")


# The contract's base patterns, as it states them.
BASE = [
    (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    (r"AKIA[A-Z0-9]+", 0, 16),
    (r"[0-9a-f]+", 0, 32),
]


def base_spans(text):
    return sorted((m.start(), i, m.end()) for i, (e, g, n) in enumerate(BASE) for m in re.finditer(e, text) if len(m.group(g)) >= n)


def test_secret_spans_come_from_the_automaton_as_from_the_expressions():
    r = random.Random(31)
    parts = ["password", "api_key", "api", "Token", "passwd", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "deadbeef", "é", "\n", ",", "a" * 30, "ghp_", "中", "eyJ", ".", "-----BEGIN ", "PRIVATE KEY-----", "xoxb-", "AIza", "p", "s", "se", "cret"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    whole = [(re.compile(e), g, n) for _, e, g, n in secrets.RULES]
    for t, found in zip(texts, secrets.scan_batch(pa.array(texts))):
        assert [x for x in found if x[1] < 3] == base_spans(t)
        raw = t.encode()
        point = lambda p, raw=raw: len(raw[:p].decode())
        assert found == sorted((point(m.start()), i, point(m.end())) for i, (e, g, n) in enumerate(whole) for m in e.finditer(raw) if m.end(g) - m.start(g) >= n)


def test_secrets_of_a_text_with_200000_spans():
    text = "password=abcdefghij é " * 200_000
    found = secrets.scan_batch(pa.array([text]))[0]
    assert len(found) == 200_000 and found[-1] == (len(text) - 22, 0, len(text) - 3)


def test_rules_whose_starts_cannot_be_told_are_refused():
    with pytest.raises(ValueError):
        secrets.Automaton.build((rb"ab*c|b+d",))


def test_composed_transducers_equal_their_cascade():
    r, rows = random.Random(32), toxicity.grammar()
    for _ in range(300):
        codes = [r.randrange(toxicity.CLASSES) for _ in range(r.randint(1, 40))]
        stages = [make() for make in toxicity.TRANSDUCERS]
        states, want, state, got = [0] * len(stages), 0.0, 0, 0.0
        for c in codes:
            for i, t in enumerate(stages):
                states[i], c, w = t.step(states[i], c)
                want += w
        for c in codes:
            state, w = rows[state][c]
            got += w
        assert abs(got - want) < 1e-9


def test_toxicity_of_clauses():
    m = toxicity.ToxicityModel({"idiot": 1.0, "loser": 1.0}, {}, (-4.8, 0.8, 4.7))
    score = lambda t: float(m.score(toxicity.features(m, [t]))[0])
    assert max(map(score, ("idiot", "the idiot table", "you are not an idiot", "kill time", 'he said: "you are an idiot"'))) < 0.7
    assert min(map(score, ("you are an idiot", "idiot, you", "I will kill you"))) > 0.7
    # a quotation goes on over sentences, up to the paragraph's end
    told, after = m.clauses('"Go. You are an idiot. Stop" he said'), m.clauses('"Go.\n\nYou are an idiot. Stop" he said')
    assert told[0] == after[0] / 2
    # a line's end ends no clause, and a mark without its other one hides nothing
    sure = ("you are an\nidiot", "you\r\nare an idiot", '" you are an idiot', 'a 5" pipe, you are an idiot. I will kill you.', "he is an idiot", "they're idiots and losers, they are such an idiot", "je vais te tuer", "I will hurt your family")
    assert min(map(score, sure)) > 0.7, [(x, score(x)) for x in sure]
    calm = ("They met an idiot", "the children told them the idiot won", "they kill and eat them", "you can kill time", "you can beat eggs", "we beat them", "‘you are an idiot’, he said", "« tu es un idiot », dit-il", "„du idiot“ sagte er")
    assert max(map(score, calm)) < 0.7, [(x, score(x)) for x in calm]
    assert m.clauses('"No," she said. You are an idiot.') == m.clauses("You are an idiot.")


def test_language_counts_equal_plain_sets(monkeypatch):
    r = random.Random(33)
    texts = [words(r, r.randint(0, 60)) for _ in range(20)] + ["", "x", "Über Äpfel"]
    data, offsets = langid.padded(pa.array(texts))
    known = {name: set() for name in ("a", "b", "c")}
    for name in known:
        for order in langid.ORDERS:
            known[name] |= set(r.sample(sorted(set(langid.order_keys(data, order).tolist())), 60))
    model = langid.LanguageFilter.build({n: np.array(sorted(s), np.uint32) for n, s in known.items()}, 20)
    for window in (1 << 20, 50):  # in one window, and in many
        monkeypatch.setattr(langid, "SLICE_BYTES", window)
        hits, total = model.counts(data, offsets)
        for i in range(len(texts)):
            own = data[offsets[i] : offsets[i + 1]]
            grams = [int(langid.order_keys(own[k : k + o], o)[0]) for o in langid.ORDERS for k in range(len(own) - o + 1)]
            assert total[i] == len(grams)
            # a Bloom filter holds all that was put in, and here hardly more
            assert [sum(g in known[n] for g in grams) for n in known] == pytest.approx(hits[i].tolist(), abs=1)


def test_attention_and_gradients():
    r = np.random.default_rng(34)
    model = quality.BagModel.fresh(4, 3, 0.2, 1)
    x, begin, y = r.normal(size=(7, quality.WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    h, t, s, a, z, size = model.attention(x, begin)
    for i, (b, e) in enumerate(zip(begin, [3, 4, 7])):
        hidden = np.tanh(x[b:e] @ model.p["W"])
        e_ = np.exp((np.tanh(hidden @ model.p["V"]) / (1 + np.exp(-hidden @ model.p["U"]))) @ model.p["w"])
        assert np.allclose(z[i], (e_ / e_.sum()) @ hidden)

    def loss():
        p = 1 / (1 + np.exp(-(model.attention(x, begin)[4] @ model.p["c"] + model.p["b"][0])))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in model.gradients(x, begin, y, np.ones(3)).items():
        at = tuple(r.integers(0, n) for n in model.p[name].shape)
        model.p[name][at] += 1e-5
        up = loss()
        model.p[name][at] -= 2e-5
        down = loss()
        model.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_leaks_equal_a_plain_search(spark):
    r = random.Random(35)
    items = [(i, words(r, r.randint(4, 25))) for i in range(12)]
    docs = []
    for i in range(60):
        key, item = r.choice(items)
        edits = r.randint(0, 9)
        t = list(item)
        for _ in range(edits):
            t[r.randrange(len(t))] = r.choice("abcdefgh")
        docs.append((i, words(r, 20) + " " + ("".join(t) if i % 4 else "") + " " + words(r, 20)))
    got = {(x.doc_id, x.item_id): x.distance for x in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in docs:
        for key, item in items:
            n, whole = decontamination.normal(item), decontamination.normal(t)
            d = decontamination.myers(n, whole)[0]
            if d <= decontamination.budget(len(n), 0.1, decontamination.LEAST) and (len(n) >= 10 or f" {n} " in f" {whole} "):
                want[i, key] = d
    assert got == want and len(want) > 20


def test_large_group_of_near_copies(spark):
    r = random.Random(36)
    base = words(r, 120).split()
    rows = [(i, words(r, 80)) for i in range(1000, 1040)]
    for i in range(500):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = "".join(r.choice("xyz") for _ in range(7))
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    got = {x.doc_id: x.component_id for x in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in sets}


def test_tree_finds_what_plain_overlaps_find():
    r = random.Random(37)
    base = sorted(r.sample(range(1000), 60))
    sets = [np.array(sorted({*r.sample(base, r.randint(30, 60)), *r.sample(range(1000), r.randint(0, 12))}), np.uint64) for _ in range(80)]
    sizes = [len(s) + r.randint(0, 8) for s in sets]
    tree = ngram_join.Tree(sets, sizes)
    for p, n in zip(sets[:30], sizes):
        want = [i for i, s in enumerate(sets) if len(np.intersect1d(p, s)) >= ngram_join.needed(n, sizes[i])]
        assert sorted(tree.linked(p, n)) == want


def test_long_texts_cut_into_words_alike(monkeypatch):
    r = random.Random(38)
    texts = pa.array([words(r, 300), "", "x" * 500 + " y", None, words(r, 50)])
    want = [s.tolist() for s in ngram_join.shingle_sets(texts)]
    monkeypatch.setattr(ngram_join, "PIECE", 64)
    assert [s.tolist() for s in ngram_join.shingle_sets(texts)] == want


def test_repeated_ids_of_vectors(spark):
    r = np.random.default_rng(39)
    rows = [(i, r.normal(size=4).tolist()) for i in range(1, 30)] + [(100, [1.0, 0.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0, 0.0]), (200, [1.0, 1.0])]
    got = neighbours.self_search(spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<double>, node string")).toPandas()
    assert got.groupby("query_id").size().to_dict() == {100: 20, 200: 10}
    full = [v + [0.0] * (4 - len(v)) for _, v in rows]
    for own in (29, 30, 32):
        d = sorted(float(np.linalg.norm(np.array(full[own]) - np.array(v))) for i, v in enumerate(full) if i != own)[:10]
        assert {round(x, 9) for x in d} <= {round(x, 9) for x in got[got.query_id == rows[own][0]].score}


def test_recall_of_the_search(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    e = data.toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = neighbours.self_search(data).toPandas()
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((ids, d))[:10]
        hit += len(set(ids[want]) & set(got[got.query_id == ids[q]].vec_id))
        total += 10
    assert hit >= 0.9 * total


def test_very_long_texts(spark, long_docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(5, "you are an idiot password abcdefgh1")], "item_id long, text string")
    assert [x.doc_id for x in decontamination.find_leaks(long_docs, items).collect()] == [1]
    assert langid.identify(long_docs, langid.learn(long_docs.selectExpr("text", "'xx' as lang"))).where("lang_pred = 'xx'").count() == 2
    assert toxicity.score(long_docs, toxicity.learn(long_docs, labels)).orderBy("doc_id").first().clauses == 1
    assert [x.doc_id for x in secrets.scan(long_docs).where("n_assign = 1").collect()] == [1]
    assert quality.score(long_docs, quality.learn(long_docs, labels, epochs=1)).where("passages > 1000").count() == 1
    assert lmscore.score(long_docs, lmscore.learn(long_docs, long_docs.limit(1))).where("n_tokens > 500000").count() == 1
    assert line_dedup.without_boilerplate(long_docs).count() == 3
    got = {x.doc_id: x.n_shingles for x in ngram_join.join_components(long_docs).collect()}
    assert got[1] > 300 and got[2] == 1 and got[3] == 0
    pieces = packing.pack(long_docs, packing.tokenizer_path()).toPandas()
    assert pieces[pieces.doc_id == 1].length.sum() == pieces[pieces.doc_id == 1].doc_tokens.iloc[0]


def test_pipeline_on_odd_rows(spark, tmp_path):
    r = random.Random(40)
    text = words(r, 60)
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (4, text, "en", "t", 1), (None, words(r, 50), "en", "s", 2), (6, words(r, 300), "en", "s", 3), (7, "you are an idiot. you loser. you moron, scum.", "en", "s", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[6][1][40:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    # 7 is toxic, one of the three copies stays, 6 holds a benchmark passage
    assert Counter(got.doc_id.fillna(-1).astype(int).tolist()) == Counter([1, 2, 3, -1])
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_clashing_columns(spark):
    columns = "doc_id long, text string, source string, score string, lang_pred string, __host string, __lines string, cluster int, token string, sig string, n int, h1 int, component string, node string, grp int, block int, place int, start int, target int, __h1 string, __none int"
    rows = [(i, "some words that are here again and again " + str(i % 3), "s", *["x"] * 4, 1, "t", "g", 1, 1, "c", "n", 1, 1, 1, 1, 1, "h", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, columns)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(5, "some words that are here", "x")], "item_id long, text string, doc_id string")
    assert decontamination.find_leaks(docs, items).count() == 6 and decontamination.without_leaks(docs, items).columns == docs.columns
    assert langid.identify(docs, langid.learn(docs.selectExpr("*", "'a' as lang"))).count() == 6
    assert toxicity.without_toxic(docs, toxicity.learn(docs, labels)).columns == docs.columns
    assert packing.pack(docs, packing.tokenizer_path()).count() == 6
    assert line_dedup.without_boilerplate(docs).columns == docs.columns
    assert secrets.scan(docs).count() == 6 and quality.score(docs, quality.learn(docs, labels)).count() == 6
    assert lmscore.score(docs, lmscore.learn(docs, labels)).count() == 6
    assert ngram_join.join_components(docs).count() == 6
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [0, 1, 2]
    assert quality.encode(*utf8(pa.array([""])))[0].shape[0] == 0


def test_search_meets_hardly_more_in_larger_tables():
    """The beam grows with the logarithm of the table: with five times the vectors, and so five times
    the queries, the rows that the searches make are not eleven times as many."""
    assert neighbours.beam_for(51_282) < 1.3 * neighbours.beam_for(10_256)
    assert neighbours.beam_for(51_282_000) < 2 * neighbours.beam_for(51_282)
    assert neighbours.beam_for(1) >= 64


def test_later_rounds_read_mixed_tokens_only(spark):
    rows = [(1, b"a", 9, 0, 0, 1, 0), (1, b"b", 9, 0, 0, 1, 0), (2, b"b", 9, 0, 1, 1, 0), (2, b"c", 9, 0, 0, 1, 0), (3, b"c", 9, 0, 1, 1, 0), (3, b"d", 9, 0, 0, 1, 0)]
    rows = spark.createDataFrame(rows, "token long, sig binary, n int, alone int, pos int, salts int, salt int")
    labels = spark.createDataFrame([(b"a", b"a"), (b"b", b"a"), (b"c", b"a")], "node binary, component binary")
    got = ngram_join.still_mixed(rows, labels)
    assert sorted((r.token, bytes(r.sig), bytes(r.component)) for r in got.collect()) == [(3, b"c", b"a"), (3, b"d", b"d")]


def exact_neighbours(x, q):
    d = neighbours.distances(np.repeat(x[q][None], len(x), axis=0), x)
    d[q] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:10], d


def test_searches_are_few_jobs_over_shards(spark):
    """Rounds and hops run inside the shards, so that a search is the same few jobs for any table; tight and
    far clusters are found from everywhere, and no partitioning of the table changes a row."""
    r = np.random.default_rng(44)
    x = (r.normal(size=(100, 1, 16)) * 50 + r.normal(size=(100, 50, 16))).reshape(-1, 16)
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert neighbours.shards_for(len(x)) == 3
    spark.sparkContext.setJobGroup("op6", "op6")
    got = neighbours.self_search(data).toPandas()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("op6"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60
    hit = 0
    for q in range(0, len(x), 100):
        mine = got[got.query_id == q].sort_values("rank")
        want, d = exact_neighbours(x, q)
        assert mine.score.tolist() == d[mine.vec_id].tolist()
        hit += len(set(want) & set(mine.vec_id))
    assert hit >= 0.97 * 500
    again = neighbours.self_search(data.repartition(7)).toPandas()
    order = ["query_id", "rank"]
    assert again.sort_values(order).values.tolist() == got.sort_values(order).values.tolist()


def test_shards_are_bounded_and_grow_with_the_root():
    assert neighbours.shards_for(0) == neighbours.shards_for(1000) == 1
    assert neighbours.shards_for(615_384) < 4 * neighbours.shards_for(51_282)
    assert all(n / neighbours.shards_for(n) <= neighbours.SHARD for n in (1, 10**5, 10**7, 10**9))


def test_neighbour_graph_of_odd_tables():
    r = np.random.default_rng(45)
    x = r.normal(size=(900, 8))
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, 1:11]
    nbr = neighbours.descent(x)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(near, nbr)]) > 9
    assert all(len(set(a)) == 40 and i not in a for i, a in enumerate(nbr))
    assert neighbours.descent(x[:1]).shape == (1, 0) and sorted(neighbours.descent(x[:3])[1]) == [0, 2]
    line = neighbours.descent(np.arange(200.0)[:, None] * [1.0, 2.0])  # along all projections the same neighbours
    assert {99, 101} <= set(line[100])


def test_search_of_extreme_vectors(spark):
    r = np.random.default_rng(46)
    x = r.normal(size=(1500, 3)) * 10.0 ** r.choice([-200, 0, 200], size=(1500, 1))
    got = neighbours.self_search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    assert got.groupby("query_id").size().tolist() == [10] * 15
    for q in range(0, 1500, 100):
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.score.tolist() == sorted(exact_neighbours(x, q)[1][mine.vec_id].tolist())
