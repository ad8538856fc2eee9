"""Operators against brute force, exact round trips and edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import decontamination, langid, line_dedup, lmscore, neighbours, ngram_join, packing, quality, secrets, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string, n int"
EDGES = [(1, None, "en", "s", "x", 1), (2, "", "en", "s", "x", 1), (3, " \n\t", None, None, None, 1), (4, "short", "en", "s", "x", None), (4, "short", "en", "s", "x", None), (None, "no id here at all", "en", "s", "x", 1), (7, "word " * 3000, "en", "s", "x", 2)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in (4, 7, 1)], "doc_id long, quality int, toxic int")


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def test_edit_distance_matches_dynamic_programming():
    r = random.Random(1)
    for _ in range(60):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(1, n))) for n in (12, 30))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        assert decontamination.myers(p, t)[0] == min(row)


def test_leaks(spark, edges, empty):
    r = random.Random(2)
    item = words(r, 40)
    near = item[:50] + "XX" + item[50:120] + item[122:]
    docs = spark.createDataFrame([(1, words(r, 80) + " " + item.upper() + "! " + words(r, 9)), (2, words(r, 30) + " " + near + " " + words(r, 30)), (3, words(r, 200)), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (8, None), (7, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontamination.find_leaks(docs, items).collect()}
    assert got[1, 9] == 0 and 0 < got[2, 9] <= 4 and set(got) == {(1, 9), (2, 9)}
    assert sorted(x.doc_id for x in decontamination.without_leaks(docs, items).collect()) == [3, 4]
    assert decontamination.find_leaks(empty, items).count() == 0
    assert decontamination.find_leaks(edges, items.limit(0)).count() == 0
    assert decontamination.without_leaks(edges, items).count() == len(EDGES)


def test_language(spark, edges, empty):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(w) for _ in range(30)), l) for i in range(60) for l, w in (("en", ["the", "house", "water", "thing"]), ("de", ["der", "straße", "wasser", "nicht"]))]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the water"), (2, "das wasser nicht"), (3, "12 ?!"), (4, None)], "doc_id long, text string")
    assert [x.lang_pred for x in langid.identify(asked, model).orderBy("doc_id").collect()] == ["en", "de", "und", "und"]
    assert langid.identify(edges, model).count() == len(EDGES)
    assert langid.identify(edges, langid.learn(empty)).where("lang_pred <> 'und'").count() == 0


def test_toxicity_grammar():
    m = toxicity.ToxicityModel({"idiot": 1.0}, {}, (-4.0, 6.0, 0.5))
    plain, aimed, denied, told = (sum(m.clauses(t)) for t in ("an idiot.", "you are an idiot.", "you are not an idiot.", "she said: an idiot."))
    assert aimed > plain > told > 0 and plain > denied > 0
    assert m.clauses("I will kill you.")[0] > m.clauses("kill time.")[0]
    assert m.clauses("calm words; nothing else") == []


def test_toxicity_edges(spark, edges, empty, labels):
    model = toxicity.learn(edges, labels)
    assert toxicity.score(edges, model).where("score between 0 and 1").count() == len(EDGES)
    assert toxicity.without_toxic(edges, model).columns == edges.columns
    assert toxicity.score(empty, toxicity.learn(empty, labels.limit(0))).count() == 0


def test_packing_round_trip(spark, edges, empty):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    reference = Tokenizer.from_file(path)
    texts = ["Ça l'été it's we'LL don't '", "<|endoftext|> hi", "x\x1cy z", "ÅNGSTRÖM é ß ÿ «q» ª ²", "İstanbul ΟΔΟΣ 中文", "a\x85b\tc\x0bd", "", None, words(random.Random(4), 4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(docs, path).toPandas()
    for i, t in enumerate(texts):
        ids = np.array(reference.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(mine.start, mine.length, mine.ids_crc32))
    x = got.sort_values(["sequence_id", "offset"])
    assert (x.offset == x.groupby("sequence_id").length.cumsum() - x.length).all()
    assert x.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(edges, path).count() >= len(EDGES) and packing.pack(empty, path).count() == 0


def test_first_fit_matches_plain_search():
    r = np.random.default_rng(5)
    lengths = r.integers(1, 101, 300)
    bins, _ = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, x in enumerate(room) if x >= lengths[i]), len(room))
        if k == len(room):
            room.append(100)
        room[k] -= lengths[i]
        want[i] = k
    assert all(bins[i] == k for i, k in want.items())


def test_line_dedup(spark, edges, empty):
    rows = [(i, "a", f"menu\nown {i}\n\nmenu") for i in range(20)] + [(50, "b", "menu\nonly"), (51, None, "menu"), (52, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {x.doc_id: (x.text, x.cut) for x in line_dedup.without_boilerplate(docs, dropped="cut").collect()}
    assert got[3] == ("own 3\n", 2) and got[50] == ("menu\nonly", 0) and got[51] == ("menu", 0) and got[52] == (None, 0)
    assert line_dedup.without_boilerplate(edges).columns == edges.columns and line_dedup.without_boilerplate(edges).count() == len(EDGES)
    assert line_dedup.without_boilerplate(empty).count() == 0


def test_pipeline_drops_lines_on_a_few_per_cent_of_a_source(spark):
    import corpus_pipeline

    rows = [(i, f"own {i}" + ("\nsubscribe to our letter" if i % 20 == 0 else "") + ("\nonce or twice" if i < 4 else ""), "a") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x.text for x in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert len(got) == 200 and got[20] == "own 20" and got[0] == "own 0\nonce or twice"


def test_neighbours(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 8))
    x[200:260] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0] * 7)]
    got = neighbours.self_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    hit = 0
    for q in (0, 100, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(300), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert np.allclose(mine.score, d[mine.vec_id])
        hit += len(set(want) & set(mine.vec_id))
    assert hit >= 27
    assert neighbours.self_search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_secrets(edges, empty):
    r = random.Random(7)
    parts = ["password", "api_key", "Token", "passwd", '"', " ", ":", "=", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "deadbeef", "é", "\n", ",", "ghp_" + "a" * 30, "中"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(500)] + [None, "", "ab" * 20000]
    kinds = [(re.compile(e.decode()), g, n) for _, e, g, n in secrets.RULES[:3]]
    for t, found in zip(texts, secrets.scan_batch(pa.array(texts))):
        want = sorted((m.start(), i, m.end()) for i, (e, g, n) in enumerate(kinds) for m in e.finditer(t or "") if len(m.group(g)) >= n)
        assert [x for x in found if x[1] < 3] == want
    assert secrets.scan(edges).count() == len(EDGES) and secrets.scan(empty).count() == 0


def test_quality(spark, edges, empty, labels):
    r = random.Random(8)
    rows = [(i, words(r, 120) if i % 2 else "BUY!! NOW!! " * 60) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality.score(docs, quality.learn(docs, lab, epochs=8)).toPandas()
    assert ((got.score > 0.5) == (got.doc_id % 2 == 1)).mean() > 0.97
    assert quality.score(edges, quality.learn(edges, labels)).where("score between 0 and 1").count() == len(EDGES)
    assert quality.score(empty, None).count() == 0


def test_language_models(spark, edges, empty):
    rows = [(1, "a b a b"), (2, "a b c"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = lmscore.learn(docs, spark.createDataFrame([(1,)], "doc_id long"))
    got = {x.doc_id: x for x in lmscore.score(docs, m).collect()}
    v, lam, alpha = 5, 0.6, 4 / 7  # three words, begin, unknown; the target has 4 of 7 words
    plain = lambda c, n, a: (c + a) / (n + a * v)
    # document 2 is no target: 1's counts; in the background its own are taken off, so that only 1's are left
    target = [plain(2, 4, alpha), lam * 2 / 2 + (1 - lam) * plain(2, 4, alpha), (1 - lam) * plain(0, 4, alpha)]
    background = [plain(2, 4, 1), lam * 2 / 2 + (1 - lam) * plain(2, 4, 1), (1 - lam) * plain(0, 4, 1)]
    assert abs(got[2].loss_target + np.mean(np.log(target))) < 1e-9 and abs(got[2].loss_background + np.mean(np.log(background))) < 1e-9
    assert abs(got[1].loss_target - np.log(v)) < 1e-9  # without itself the target is empty
    assert got[3].n_tokens == 0 and got[4].score is None
    assert lmscore.score(edges, lmscore.learn(edges, edges.limit(0))).count() == len(EDGES)
    assert lmscore.score(empty, lmscore.learn(empty, empty)).count() == 0


def test_language_models_count_every_word_and_pair(spark):
    r = random.Random(12)
    texts = {i: [f"w{r.randrange(90_000)}" if r.random() < 0.8 else r.choice("ab") for _ in range(1500)] for i in range(60)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {x.doc_id: x for x in lmscore.score(docs, lmscore.learn(docs, docs.where("doc_id < 20"))).collect()}
    size = len({x for w in texts.values() for x in w}) + 2
    assert size > 1 << 15

    models = []
    for chosen in (range(20), range(60)):
        one, two = Counter(), Counter()
        for i in chosen:
            one.update(texts[i])
            two.update(zip(texts[i], texts[i][1:]))
        models.append((one, two, one.total()))

    def losses(w, less):
        """Of both models, without what ``less`` says that the document itself has in them."""
        out = []
        for (one, two, total), alpha, k in zip(models, (models[0][2] / models[1][2], 1), less):
            own, pairs = Counter(w * k), Counter(list(zip(w, w[1:])) * k)
            plain = lambda b: (one[b] - own[b] + alpha) / (total - own.total() + alpha * size)
            p = [0.4 * plain(b) + 0.6 * (two[a, b] - pairs[a, b]) / (one[a] - own[a]) if a and one[a] > own[a] else plain(b) for a, b in zip([None, *w], w)]
            out.append(-np.mean(np.log(p)))
        return out

    for i, w in texts.items():
        want = losses(w, (int(i < 20), 1))
        assert abs(got[i].loss_target - want[0]) < 1e-9 and abs(got[i].loss_background - want[1]) < 1e-9 and got[i].n_tokens == 1500
    other = spark.createDataFrame([(7, "a b never seen")], "doc_id long, text string")
    x = lmscore.score(other, lmscore.learn(docs, docs.where("doc_id < 20"))).first()
    want = losses("a b never seen".split(), (0, 0))
    assert abs(x.loss_target - want[0]) < 1e-9 and abs(x.loss_background - want[1]) < 1e-9


def test_copies_score_apart(spark):
    """A text that stands twice is closer to the corpus without itself than one that stands once."""
    r = random.Random(14)
    texts = [words(r, 120) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in lmscore.score(docs, lmscore.learn(docs, docs.where("doc_id in (0, 20, 30)"))).collect()}
    assert max(got[i].loss_background for i in range(10)) < min(got[i].loss_background for i in range(10, 40)) - 1
    assert got[100].loss_target < got[101].loss_target - 1  # the copy of a good text is close to the target, other copies not
    assert abs(got[20].loss_target - got[21].loss_target) < 1  # a good text does not find itself


def test_ngram_join(spark, edges, empty):
    r = random.Random(9)
    base = words(r, 60).split()
    rows = []
    for i in range(60):
        w = list(base) if i % 2 else words(r, 60).split()
        for _ in range(i % 5):
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(60, "Few words"), (61, "few WORDS"), (62, None), (63, " ")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join_components(docs).collect()
    assert {x.doc_id: x.component_id for x in got} == least
    assert all(x.n_shingles == len(sets[x.doc_id]) for x in got)
    kept = sorted(x.doc_id for x in ngram_join.one_of_each(docs).collect())
    assert kept == sorted({*least.values()})
    assert ngram_join.join_components(edges).count() == len(EDGES)
    assert ngram_join.one_of_each(edges).columns == edges.columns
    assert ngram_join.join_components(empty).count() == 0
