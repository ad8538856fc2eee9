"""Toxicity scoring with a weighted finite-state grammar over clauses.

A tagger maps every token to a class. Five small transducers read the classes, each what the one
before writes: negation and reported speech mark what they cover, target marks what is aimed at
somebody, insult and threat turn what they find into weights. They are composed once, by product
construction, into a single transition table; a clause is then one walk. An insult that is aimed
weighs more than one that stands alone: at somebody addressed, before it or shortly after, or at a third person
of whom it is said ("he is ..."). A threat weighs only with an object that is addressed ("... you").

Clauses end with a sentence's mark or a paragraph, which ends at an empty line; a line's end is no more than
a space. Quotations stand between two marks of one kind in a paragraph; single marks are none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, mapped, sampled_labels, sigmoid, slices, stored, table, tidy

#: Stands for either mark of a quotation whose marks belong together.
MARK = "\ue000"
TOKEN = re.compile(rf"[^\W\d_]+|[.!?;{MARK}]|\n[ \t\r]*\n")
EMPTY_LINE = re.compile(r"\n[ \t\r]*\n")
QUOTATION = re.compile(r"""(?<!\w)"(?=\S)[^"]*(?<=\S)"(?!\w)|«[^«»]*»|»[^«»]*«|“[^“”„]*”|„[^“”„]*[“”]|‘[^‘]*?’(?!\w)""")
ANY_QUOTE = re.compile('["«»“„‘]')

# Token classes. END ends a clause, BREAK a paragraph and with it any quotation.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END, BREAK, OBJECT, THIRD, COPULA = range(12)
CLASSES = 12
#: Marks added by the transducers: the class is negated, reported, aimed at somebody.
NEGATED, REPORTED, AIMED = 16, 32, 64

# Seed words of the grammar, in English, German, French and Spanish.
SEED_INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting imbecile dumb dummkopf abschaum trottel versager idiote crétin imbécile minable basura escoria estúpido imbécil".split()
SEED_THREATS = "kill hurt destroy stab shoot strangle burn beat murder punish töten umbringen verletzen erschießen tuer frapper détruire égorger matar golpear destruir apuñalar".split()
TARGETS = "you your yours yourself u du dein deine ihr tu toi ton ta votre usted ustedes vosotros ti tú".split()
OBJECTS = "dich dir euch te vous os".split()
THIRD_PERSONS = "he she they er sie il elle ils elles él ella ellos ellas".split()
COPULAS = "is are was were s re ist sind war waren est sont était étaient es son era eran".split()
NEGATIONS = "not no never nor isn aren wasn don doesn didn won nicht kein keine niemals pas jamais aucun ni nunca jamás tampoco".split()
REPORTS = "said says claimed claims reported quoted wrote writes called alleged according sagte behauptete schrieb zitierte laut dit affirma écrit selon dijo afirmó escribió según".split()
#: Lengths of the word beginnings that can be learned.
STEMS = range(4, 10)
ENDS = ".!?;"
#: Tokens over which an address, or an insult or threat before it, reaches.
AIM, AFTER = 6, 3


@dataclass
class Transducer:
    """``step(state, symbol) -> (state, symbol, weight)`` from state 0."""

    step: Callable[[int, int], tuple[int, int, float]]

    def then(self, other: Transducer) -> Transducer:
        """Composition: the symbols that this one writes are what ``other`` reads."""
        pairs: dict[tuple[int, int], int] = {(0, 0): 0}
        states = [(0, 0)]

        def step(state: int, symbol: int) -> tuple[int, int, float]:
            a, b = states[state]
            a, middle, w = self.step(a, symbol)
            b, out, v = other.step(b, middle)
            if (a, b) not in pairs:
                pairs[a, b] = len(states)
                states.append((a, b))
            return pairs[a, b], out, w + v

        return Transducer(step)

    def compiled(self) -> list[list[tuple[int, float]]]:
        """The transition table over the states that can be reached."""
        rows: list[list[tuple[int, float]]] = []
        known = 1
        while len(rows) < known:
            row = [self.step(len(rows), c) for c in range(CLASSES)]
            known = max(known, 1 + max(r[0] for r in row))
            rows.append([(s, w) for s, _, w in row])
        return rows


def negation(reach: int = 4) -> Transducer:
    """Marks insults and threats within ``reach`` tokens of a negation."""

    def step(state: int, c: int) -> tuple[int, int, float]:
        if c in (END, BREAK):
            return 0, c, 0.0
        if c == NEGATION:
            return reach, c, 0.0
        return max(0, state - 1), c | NEGATED if state and c in (INSULT, THREAT) else c, 0.0

    return Transducer(step)


def reported() -> Transducer:
    """Marks what follows a reporting verb in its clause (state 1), and what stands between quotation
    marks (state 2), over any number of clauses up to the paragraph's end."""

    def step(state: int, c: int) -> tuple[int, int, float]:
        if c == BREAK or c == END and state == 1:
            return 0, c, 0.0
        if c == QUOTE:
            return (0 if state == 2 else 2), c, 0.0
        if c == REPORT and state == 0:
            return 1, c, 0.0
        return state, c | REPORTED if state and c & 15 in (INSULT, THREAT) else c, 0.0

    return Transducer(step)


def target() -> Transducer:
    """Marks insults within AIM tokens after somebody was addressed, or a third person named and what they are
    ("they are"), and threats right after an addressed object ("vais te tuer").

    States up to AIM count down; then a third person was the last word, or an object was."""
    third, just = AIM + 1, AIM + 2

    def step(state: int, c: int) -> tuple[int, int, float]:
        kind = c & 15
        if kind in (END, BREAK):
            return 0, c, 0.0
        if kind in (TARGET, OBJECT):
            return (just if kind == OBJECT else AIM), c, 0.0
        if kind == THIRD:
            return third, c, 0.0
        if kind == COPULA and state == third:
            return AIM, c, 0.0
        aimed = kind == INSULT and state not in (0, third) or kind == THREAT and state == just
        return (0 if state == third else AIM if state == just else max(0, state - 1)), c | AIMED if aimed else c, 0.0

    return Transducer(step)


def weigher(kind: int, alone: float, aimed: float) -> Transducer:
    """Weighs words of ``kind``. One that stands alone waits AFTER tokens for somebody addressed, who brings the rest."""

    def step(state: int, c: int) -> tuple[int, int, float]:
        if c & 15 in (END, BREAK):
            return 0, c, 0.0
        if c & 15 in (TARGET, OBJECT):
            return 0, c, (aimed - alone) if state else 0.0
        if c & 15 != kind:
            return max(0, state - 1), c, 0.0
        factor = (0.3 if c & NEGATED else 1.0) * (0.5 if c & REPORTED else 1.0)
        waits = factor == 1 and not c & AIMED
        return AFTER if waits else max(0, state - 1), c, factor * (aimed if c & AIMED else alone)

    return Transducer(step)


def insult() -> Transducer:
    return weigher(INSULT, 1.0, 2.5)


def threat() -> Transducer:
    return weigher(THREAT, 0.2, 2.5)


#: In the order in which they read each other.
TRANSDUCERS = (negation, reported, target, insult, threat)


def grammar() -> list[list[tuple[int, float]]]:
    whole, *rest = (make() for make in TRANSDUCERS)
    for other in rest:
        whole = whole.then(other)
    return whole.compiled()


@dataclass
class ToxicityModel:
    """``words`` and ``stems`` weight insults; ``weights`` is bias, largest clause, sum of clauses."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, float, float]
    rows: list[list[tuple[int, float]]] = field(default_factory=grammar)

    def __post_init__(self) -> None:
        self.fixed = {w: (c, 1.0) for c, ws in ((COPULA, COPULAS), (THIRD, THIRD_PERSONS), (OBJECT, OBJECTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, SEED_THREATS)) for w in ws}
        self.fixed |= {c: (END, 0.0) for c in ENDS} | {MARK: (QUOTE, 0.0)}
        #: Where a clause begins that stands between quotation marks.
        self.quoted = self.rows[self.rows[0][QUOTE][0]][END][0]
        self.tags = Tags(self)

    def classed(self, token: str) -> tuple[int, float]:
        if token in self.fixed:
            return self.fixed[token]
        if token[0] == "\n":
            return BREAK, 0.0
        w = max([self.words.get(token, 0.0), *(self.stems.get(token[:k], 0.0) for k in STEMS if len(token) > k)])
        return (INSULT, w) if w > 0 else (OTHER, 0.0)

    def clauses(self, text: str) -> list[float]:
        """The scores above 0 of the text's clauses."""
        tokens = TOKEN.findall(marked(text.lower()))
        if len(self.tags) > 100_000:
            self.tags.clear()
        codes = bytes(map(self.tags.__getitem__, tokens))
        found, done, inside = [], 0, False
        while (m := HOT.search(codes, done)) is not None:
            begin = max(done, codes.rfind(END, done, m.start()) + 1, codes.rfind(BREAK, done, m.start()) + 1)
            line = codes.rfind(BREAK, done, begin) + 1
            inside = (inside and not line) ^ bool(codes.count(QUOTE, max(line, done), begin) & 1)
            stop = STOP.search(codes, m.start())
            done = stop.end() if stop else len(codes)
            state, score = self.quoted if inside else 0, 0.0
            for i in range(begin, done):
                state, w = self.rows[state][codes[i]]
                if w:
                    score += w * (self.classed(tokens[i])[1] if codes[i] == INSULT else 1.0)
            inside = (inside ^ bool(codes.count(QUOTE, begin, done) & 1)) and not (stop and stop[0][0] == BREAK)
            if score > 0:
                found.append(score)
        return found

    def features(self, text: str | None) -> tuple[float, float]:
        c = self.clauses(text) if text else []
        return (min(2.0, max(c)), math.log1p(sum(c))) if c else (0.0, 0.0)

    def score(self, features: np.ndarray) -> np.ndarray:
        b, top, whole = self.weights
        return sigmoid(b + top * features[:, 0] + whole * features[:, 1])


def marked(text: str) -> str:
    """The text with MARK for each of the two marks of a quotation; other quotation marks go for nothing."""
    if ANY_QUOTE.search(text) is None:
        return text
    inner = lambda m: MARK + m[0][1:-1] + MARK
    ends = [m.end() for m in EMPTY_LINE.finditer(text)]
    return "".join(QUOTATION.sub(inner, text[a:b]) for a, b in zip([0, *ends], [*ends, len(text)]))


HOT, STOP = re.compile(bytes([91, INSULT, THREAT, 93])), re.compile(bytes([91, END, BREAK, 93]))


class Tags(dict):
    def __init__(self, model: ToxicityModel) -> None:
        self.model = model

    def __missing__(self, token: str) -> int:
        self[token] = c = self.model.classed(token)[0]
        return c


def tokens_of(text: str) -> set[str]:
    """Words of a text, and as ``stem-`` their first 4 to 9 letters."""
    words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
    return words | {w[:k] + "-" for w in words for k in STEMS if len(w) > k}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, steps: int = 60) -> np.ndarray:
    """Newton steps for ridge logistic regression; the first weight is the bias."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) / len(x) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, bound: int = 20000, support: int = 8, precision: float = 0.9) -> ToxicityModel:
    """Learns insult words and stems and the weights from at most ``bound`` labelled documents.

    A word or stem enters when it stands in ``support`` differing toxic documents or more and
    at least ``precision`` of the documents with it (toxic ones corrected for their share) are
    toxic. Copies of a document count once, by the smallest word hash. All such words and stems of
    the sample are used. Threats, targets, negations and reporting verbs are the fixed lists.
    Without labels of both kinds (an empty table of either, too) the seed words and fixed weights are used.
    """
    seeds = dict.fromkeys(SEED_INSULTS, 0.8)
    chosen = F.broadcast(sampled_labels(labels, "toxic", fold, folds, bound))
    sample = stored(docs.select("doc_id", "text").join(chosen, "doc_id").where(F.col("text").isNotNull()).select("text", "label"), "toxicity-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return ToxicityModel(seeds, {}, (-4.9, 1.4, 4.3))

    def toxic_tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        token, group = [], []
        for text in batch.column("text").to_pylist():
            found = tokens_of(text)
            if found:
                key = min(stable(w) for w in found)
                token += found
                group += [key] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(group, pa.int64())], ["token", "cluster"])

    frequent = mapped(sample.where("label = 1"), ["text"], toxic_tokens, "token string, cluster long").groupBy("token").agg(F.countDistinct("cluster").alias("n")).where(F.col("n") >= support)
    candidates = {r["token"]: r["n"] for r in frequent.collect()}
    cast = docs.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def clean_tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        token = [w for text in batch.column("text").to_pylist() for w in tokens_of(text) & cast.value]
        return pa.RecordBatch.from_arrays([pa.array(token, pa.string())], ["token"])

    clean = {r["token"]: r["count"] for r in mapped(sample.where("label = 0"), ["text"], clean_tokens, "token string").groupBy("token").count().collect()}
    words, stems = dict(seeds), {}
    scale = sizes[0] / sizes[1]
    whole: dict[str, int] = {}  # of each stem, the count of its most frequent word
    for token, n in candidates.items():
        for k in () if token.endswith("-") else STEMS:
            whole[token[:k] + "-"] = max(n, whole.get(token[:k] + "-", 0))
    for token, n in candidates.items():
        share = n * scale / (n * scale + clean.get(token, 0) + 0.5)
        if share >= precision:
            if token.endswith("-"):
                if whole.get(token, 0) >= 0.9 * n:
                    continue  # that one word says it all
                stems[token[:-1]] = share
            else:
                words[token] = share
        elif token in words:
            del words[token]
    draft = ToxicityModel(words, stems, (0.0, 0.0, 0.0))
    model = docs.sparkSession.sparkContext.broadcast((draft.words, draft.stems))

    def featured(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(local_model(model.value), batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("label")], ["a", "b", "label"])

    rows = mapped(sample, ["text", "label"], featured, "a double, b double, label int", held=(LOCAL,)).toPandas()
    w = logistic(rows[["a", "b"]].to_numpy(), rows.label.to_numpy().astype(float))
    return ToxicityModel(words, stems, (float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))))


def stable(word: str) -> int:
    """A hash that is the same in every process."""
    h = 1469598103934665603
    for c in word:
        h = ((h ^ ord(c)) * 1099511628211) & 0x7FFFFFFFFFFFFFFF
    return h


def features(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    return np.array([model.features(t) for t in texts], float).reshape(-1, 2)


#: The worker's model for the last parameters seen, so that its memo of tags lasts.
LOCAL: dict[int, tuple[tuple, ToxicityModel]] = {}


def local_model(parts: tuple) -> ToxicityModel:
    held = LOCAL.get(0)
    if held is None or held[0] is not parts:
        LOCAL[0] = held = (parts, ToxicityModel(parts[0], parts[1], parts[2] if len(parts) > 2 else (0.0, 0.0, 0.0)))
    return held[1]


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scores each whole text: columns ``keep``, score (0 to 1), clauses (matched ones), top (largest clause score).

    Null and empty texts get the score of a text without matches. Repeated rows are each answered;
    an empty table gives no rows; very long texts are read whole, in time proportional to their
    length; other columns are not read, so they may have any name.
    """
    cast = docs.sparkSession.sparkContext.broadcast((model.words, model.stems, model.weights))
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        local = local_model(cast.value)
        texts = batch.column("text").to_pylist()
        found = [local.clauses(t) if t else [] for t in texts]
        x = np.array([(min(2.0, max(c)), math.log1p(sum(c))) if c else (0.0, 0.0) for c in found], float).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(local.score(x)), pa.array([len(c) for c in found], pa.int32()), pa.array(x[:, 0])], [*keep, "score", "clauses", "top"])

    return mapped(docs, list(dict.fromkeys([*keep, "text"])), run, ", ".join(f"`{c}` {k}" for c, k in zip(keep, kinds)) + ", score double, clauses int, top double", held=(LOCAL,))


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns.

    Null and empty texts are scored as texts without matches, repeated rows each; an empty table
    gives no rows."""
    cast = docs.sparkSession.sparkContext.broadcast((model.words, model.stems, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                local = local_model(cast.value)
                yield piece.filter(pa.array(local.score(features(local, piece.column("text").to_pylist())) < threshold))

    return docs.mapInArrow(tidy(run, LOCAL), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, with a model learned outside the held-out fold; see ``score``."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "clauses", "top")
