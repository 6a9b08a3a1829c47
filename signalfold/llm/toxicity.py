"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade > k) = sigmoid(w.x - theta_k): the thresholds of all grades share the weights w, which all features
that tell about toxicity (chi-squared over CHI2) have. Features are a text's words and the first letters (PREFIXES) of its longer words, with log1p of
their counts. The expected severity is the sum of P(grade > k); a document is toxic when
P(grade > 0) reaches a cut chosen on the training rows.

The labels say only toxic or not. Grades of toxic training rows come from how many marker words they hold,
words that toxic rows hold far more often than clean rows: mild below the first of CUTS, then severe
and extreme. The model is fitted on a hash sample of at most SAMPLE_ROWS labelled documents.

The labels know no grades, so the ordinal target is the model's own reading of them: only the first threshold, toxic or
not, can be held against labels that were kept back; the higher grades can only be held against that reading, as a test does.

Defined cases: null and empty texts, and any text where no label was learnt, have severity 0 and are not toxic;
repeated rows get equal results, ties cannot arise; an empty table gives an empty result; long texts are read whole;
doc_id may be of any type and null; other columns pass through `score`, but for those named like a result, which it
replaces, and all of them pass through `reject`, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalfold.llm.bpe import cut_words
from signalfold.llm.linear import labelled_sample, places, sigmoid, vocabulary_of
from signalfold.llm.store import map_batches, materialize, ship, slices

SAMPLE_ROWS, PREFIXES, MIN_ROWS, CHI2 = 16_000, (4, 6), 3, 15.0
#: Distinct runs whose weights a task remembers.
KNOWN_RUNS = 100_000
#: Steps of the optimiser, their rate, and the weights' quadratic penalty.
STEPS, RATE, PENALTY = 600, 0.05, 3e-6
#: Marker words from which a toxic row is severe, and extreme.
CUTS = (4, 10)
GRADES = len(CUTS) + 2

#: Least P(grade > 0) of a toxic document: the one of these with the best F1 on the training rows.
CHOICES = (0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5)

_WORDS = regex.compile(r"\p{L}+")
_MARK = 1 << 32


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct feature ids, their counts, and how many words there are. Prefix ids lie above word ids."""
    found = _WORDS.findall(text.lower()) if text else []
    words = Counter(found)
    heads: Counter[str] = Counter()
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                heads[w[:k]] += n
    ids = [*map(_id, words), *(_MARK + _id(w) for w in heads)]
    seen, at = np.unique(np.array(ids, np.int64), return_inverse=True)
    return seen, np.bincount(at, [*words.values(), *heads.values()], len(seen)).astype(np.int32), len(found)


def _id(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


@dataclass
class Model:
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    theta: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))
    cut: float = 0.5

    def above(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        hit, at = places(self.ids, ids)
        s = float(np.log1p(counts[hit]) @ self.weights[at]) if len(at) else 0.0
        return sigmoid(s - self.theta) if len(ids) else np.zeros(GRADES - 1)


class Scorer:
    """`Model.above` for many texts at once: only distinct words are looked at, and only those with a weight are counted."""

    def __init__(self, model: Model):
        self.model, self.place = model, {int(i): k for k, i in enumerate(model.ids)}
        self.known: dict[str, tuple[int, ...] | None] = {}

    def _weighed(self, run: str) -> tuple[int, ...] | None:
        """Places of the weights of a run's words and their heads; None without a word."""
        found = _WORDS.findall(run.lower())
        ids = [i for w in found for i in (_id(w), *(_MARK + _id(w[:k]) for k in PREFIXES if len(w) > k))]
        return tuple(self.place[i] for i in ids if i in self.place) if found else None

    def above(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and k."""
        words, counts = cut_words(pc.fill_null(texts, ""))
        coded = words.dictionary_encode()
        runs = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > KNOWN_RUNS:
            self.known = {}
        for r in runs:
            if r not in self.known:
                self.known[r] = self._weighed(r)
        weighed = [self.known[r] for r in runs]
        doc, at = np.repeat(np.arange(len(counts)), counts), coded.indices.to_numpy()
        worded = np.bincount(doc[np.array([w is not None for w in weighed], bool)[at]], minlength=len(counts)) > 0
        n = np.array([len(w or ()) for w in weighed], np.int64)
        flat = np.array([k for w in weighed for k in w or ()], np.int64)
        hit = n[at] > 0
        doc, at = doc[hit], at[hit]
        ends = np.cumsum(n[at])
        total = int(ends[-1]) if len(ends) else 0
        column = flat[np.arange(total) + np.repeat((np.cumsum(n) - n)[at] - (ends - n[at]), n[at])]
        cell, times = np.unique(np.repeat(doc, n[at]) * max(1, len(self.place)) + column, return_counts=True)
        row, column = np.divmod(cell, max(1, len(self.place)))
        s = np.bincount(row, np.log1p(times) * self.model.weights[column], len(counts))
        return np.where(worded[:, None], sigmoid(s[:, None] - self.model.theta), 0.0)


def _grades(rows: list[tuple[np.ndarray, np.ndarray, int]], toxic: np.ndarray) -> np.ndarray:
    words = [r[0][r[0] < _MARK] for r in rows]
    bad, n_bad = vocabulary_of([w for w, t in zip(words, toxic, strict=True) if t], 3)
    good, n_good = vocabulary_of([w for w, t in zip(words, toxic, strict=True) if not t], 1)
    hit, at = places(good, bad)
    clean = np.zeros(len(bad))
    clean[hit] = n_good[at]
    odds = ((n_bad + 0.5) / (toxic.sum() + 1)) / ((clean + 0.5) / ((~toxic).sum() + 1))
    markers = bad[odds >= 20]
    out = np.zeros(len(rows), int)
    for i, (ids, counts, _) in enumerate(rows):
        if toxic[i]:
            hit, _ = places(markers, ids)
            out[i] = 1 + int(np.searchsorted(CUTS, counts[hit].sum(), side="right"))
    return out


def _telling(ids: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The features whose rows are toxic unlike chance (chi-squared over CHI2), ascending."""
    seen, n = vocabulary_of(ids, MIN_ROWS)
    bad, n_bad = vocabulary_of([x for x, t in zip(ids, toxic, strict=True) if t], 1)
    hit, at = places(seen, bad)
    a, rows, share = np.zeros(len(seen)), len(ids), toxic.mean()
    a[at] = n_bad[hit]
    chi2 = (a - n * share) ** 2 / (n * share * (1 - share) * (1 - n / (rows + 1)))
    return seen[chi2 > CHI2]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], toxic: np.ndarray) -> Model:
    """Penalised likelihood by full-batch Adam; thresholds are a first one and positive steps, so they stay in order."""
    if not toxic.any() or toxic.all():
        return Model()
    grade = _grades(rows, toxic)
    ids = _telling([r[0] for r in rows], toxic)
    found = [places(ids, own) for own, _, _ in rows]
    # The matrix is sparse: entry i holds value[i] in row[i], col[i].
    row, col = np.repeat(np.arange(len(rows)), [len(c) for _, c in found]), np.concatenate([c for _, c in found])
    value = np.log1p(np.concatenate([c[hit] for (_, c, _), (hit, _) in zip(rows, found, strict=True)]).astype(float))
    share = np.array([max(float((grade > k).mean()), 1e-4) for k in range(GRADES - 1)])
    first = np.log1p(-share) - np.log(share)
    params = np.concatenate([np.zeros(len(ids)), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v, n, at = np.zeros_like(params), np.zeros_like(params), len(ids), np.arange(len(rows))
    for t in range(1, STEPS + 1):
        w, theta = params[:n], params[n] + np.concatenate([[0.0], np.cumsum(np.exp(params[n + 1:]))])
        # P(y) is a difference of neighbouring sigmoids; its log's gradients by the score and by each threshold:
        p = np.hstack([np.ones((len(rows), 1)), sigmoid(np.bincount(row, value * w[col], len(rows))[:, None] - theta), np.zeros((len(rows), 1))])
        d = p * (1 - p)
        like = np.maximum(p[at, grade] - p[at, grade + 1], 1e-9)
        up, down = d[at, grade] / like, d[at, grade + 1] / like
        by_theta = np.zeros(GRADES + 1)
        np.add.at(by_theta, grade, up)
        np.add.at(by_theta, grade + 1, -down)
        by_theta = by_theta[1:-1]
        steps = np.exp(params[n + 1:]) * np.cumsum(by_theta[::-1])[::-1][1:]
        g = np.concatenate([-np.bincount(col, value * (up - down)[row], n) / len(rows) + PENALTY * w, [by_theta.sum() / len(rows)], steps / len(rows)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w, theta = params[:n], params[n] + np.concatenate([[0.0], np.cumsum(np.exp(params[n + 1:]))])
    model = Model(ids[w != 0], w[w != 0], theta)
    p = np.array([model.above(i, c)[0] for i, c, _ in rows])
    f1 = {c: 2 * (toxic & (p >= c)).sum() / (toxic.sum() + (p >= c).sum()) for c in CHOICES}
    model.cut = max(CHOICES, key=lambda c: (f1[c], c))
    return model


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic)."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels.selectExpr("doc_id", "cast(toxic as int) as y"), bound)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for whole in it for b in slices(whole, 1)):
            rows = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.int64())],
                names=["doc_id", "y", "ids", "counts", "n"])

    schema = "doc_id long, y int, ids array<long>, counts array<int>, n long"
    found = materialize(sample.select("doc_id", "text", "y").mapInArrow(batches, schema), "toxicity-features")
    telling = _telling_of(found)

    def reduced(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for i, c in zip(b.column(2), b.column(3), strict=True):
                own = np.array(i.values)
                hit, _ = places(telling, own)
                rows.append((own[hit], np.array(c.values)[hit]))
            cols = [b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int32())), b.column(4)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    t = found.mapInArrow(reduced, schema).toArrow().sort_by("doc_id")
    rows = [(np.array(i.values), np.array(c.values), n) for i, c, n in zip(t["ids"], t["counts"], t["n"].to_pylist(), strict=True)]
    return fit(rows, np.array(t["y"].to_pylist(), int) > 0) if rows else Model()


def _telling_of(found: DataFrame) -> np.ndarray:
    """As _telling, of rows (y, ids) that stay on the executors: only the chosen features reach the driver."""
    all_ = found.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("y") > 0).cast("int")).alias("share")).first()
    if not all_.rows or all_.share in (0.0, 1.0):
        return np.empty(0, np.int64)
    per = found.select(F.explode("ids").alias("id"), (F.col("y") > 0).cast("int").alias("bad")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    n, share = F.col("n"), F.lit(float(all_.share))
    chi2 = F.pow(F.col("bad") - n * share, F.lit(2)) / (n * share * (1 - share) * (1 - n / F.lit(float(all_.rows + 1))))
    found = per.where(n >= MIN_ROWS).where(chi2 > CHI2).select("id").toArrow()
    return np.sort(found["id"].to_numpy()).astype(np.int64)


SCORES = "severity double, grade int, p_toxic double, toxic boolean"


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with severity (expected grade), grade (likeliest by thresholds), p_toxic and toxic; columns of these names are replaced."""
    ship(docs.sparkSession)
    docs = docs.drop(*T._parse_datatype_string(SCORES).names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    place = names.index(text)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(SCORES).fields])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        for b in (b for whole in it for b in slices(whole, place)):
            p = scorer.above(b.column(place))
            cols = [pa.array(p.sum(1)), pa.array((p >= m.cut).sum(1).astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= m.cut)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=schema.names)

    return map_batches(docs, batches, schema)


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    packed = docs.select(F.struct("*").alias("__row"), F.col(f"`{text}`").alias("__text"))
    return score(packed, model, "__text").where(~F.col("toxic")).select("__row.*")
