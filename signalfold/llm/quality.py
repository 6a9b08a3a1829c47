"""Quality: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

A text's statistics (STATS) are standardised with the training rows' mean and deviation and mapped to
FEATURES cosines, whose inner products approximate a Gaussian kernel. Each partition of the training rows
sums its part of the normal equations; the sums are added up and one small system gives the ridge scores.
Rows that a hash keeps back calibrate the scores by isotonic regression, joined linearly between the blocks'
centres. The model is fitted on a hash sample of at most SAMPLE_ROWS labelled documents.

Defined cases: a null text is scored as the empty one; where no label was learnt the score is 0.5, as where all labels
are alike; repeated rows get equal results, ties cannot arise; an empty table gives an empty result; doc_id may be of any
type and null; long texts are read whole; other columns pass through, but for one named `score`, which is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalfold.llm.linear import labelled_sample
from signalfold.llm.store import map_batches, materialize, ship, slices

SAMPLE_ROWS, FEATURES, RIDGE, SEED = 20_000, 256, 1e-3, 11
STATS = (
    "chars", "words", "word_length", "word_deviation", "letters", "digits", "upper", "space", "lines", "line_repeats", "distinct", "top_word",
    "repeats", "upper_words", "marked_words", "lone_marks", "exclaims", "bars", "entropy", "short_words", "long_words", "stops", "pairs",
)
_LETTER, _DIGIT, _UPPER = (np.zeros(256, bool) for _ in range(3))
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = _UPPER[65:91] = True


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.split()
    n, size = max(1, len(words)), max(1, int(raw.sum()))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    lines = text.split("\n")
    p = raw[raw > 0] / size
    letters = int(raw[_LETTER].sum())
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words)
    lone = sum(n for w, n in seen.items() if len(w) <= 2 and not w.isalnum())
    return [
        math.log1p(len(text)), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()), letters / size, int(raw[_DIGIT].sum()) / size,
        int(raw[_UPPER].sum()) / max(1, letters), int(raw[9:14].sum() + raw[32]) / size, math.log1p(len(lines)), 1 - len(set(lines)) / len(lines), len(seen) / n,
        max(seen.values(), default=0) / n, sum(map(eq, words, words[1:])) / n, sum(w.isupper() and len(w) > 1 for w in words) / n, marked / n, lone / n,
        int(raw[33]) / n, int(raw[124]) / n, float(-(p * np.log2(p)).sum()), float((lengths <= 3).mean()), float((lengths >= 12).mean()),
        int(raw[46]) / n, pairs,
    ]


def cosines(x: np.ndarray, projection: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Fourier features and a constant."""
    return np.hstack([np.sqrt(2 / len(phase)) * np.cos(x @ projection + phase), np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and their ascending means."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, of x, rows
    for i in order:
        blocks.append([float(y[i]), float(x[i]), 1.0])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    at: np.ndarray | None = None
    value: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        return cosines(np.clip((x - self.mean) / self.deviation, -6, 6), self.projection, self.phase)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self.features(x) @ self.weights
        # A small share of the raw score keeps an order inside flat blocks.
        return np.clip(0.999 * np.interp(raw, self.at, self.value) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, quality)."""
    spark = docs.sparkSession
    ship(spark)
    d, rng = len(STATS), np.random.default_rng(SEED)
    model = Model(np.zeros(d), np.ones(d), rng.normal(size=(d, FEATURES)) / math.sqrt(2 * d), rng.uniform(0, 2 * math.pi, FEATURES))
    sample = labelled_sample(docs, labels.selectExpr("doc_id", "cast(quality as int) as y"), bound)

    def measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for whole in it for b in slices(whole, 1)):
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(measured, "doc_id long, y int, x array<double>")
    rows = materialize(rows.withColumn("back", F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(4)) == 0), "statistics")
    learn = rows.where(~F.col("back"))
    one = learn.agg(*(f(F.col("x")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))), F.min("y").alias("least"), F.max("y").alias("most")).first()
    if one.least is None or one.least == one.most:
        return model
    model.mean = np.array([one[f"m{i}"] for i in range(d)])
    model.deviation = np.array([max(one[f"s{i}"], 1e-6) for i in range(d)])

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, v, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for b in it:
            if b.num_rows:
                z, y = model.features(np.array(b.column(1).to_pylist())), b.column(0).to_numpy()
                a, v, n = a + z.T @ z, v + z.T @ y, n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([a.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["n", "a", "v"])

    # The sample is bounded, and so are its partitions and their sums.
    parts = learn.select("y", "x").coalesce(8).mapInArrow(sums, "n long, a binary, v binary").collect()
    a = sum(np.frombuffer(p.a) for p in parts).reshape(FEATURES + 1, FEATURES + 1)
    v, n = sum(np.frombuffer(p.v) for p in parts), sum(p.n for p in parts)
    model.weights = np.linalg.solve(a + RIDGE * n / FEATURES * np.eye(FEATURES + 1), v)
    back = rows.where("back").select("doc_id", "y", "x").toArrow().sort_by("doc_id")
    held = back if len(back) else learn.select("doc_id", "y", "x").toArrow().sort_by("doc_id")
    raw = model.features(np.array(held["x"].to_pylist())) @ model.weights
    model.at, model.value = isotonic(raw, np.array(held["y"].to_pylist(), float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score`, 0 to 1; a column of this name is replaced."""
    ship(docs.sparkSession)
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (b for whole in it for b in slices(whole, place)):
            x = np.array([statistics(t) for t in b.column(place).to_pylist()]).reshape(b.num_rows, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.score(x))], names=schema.names)

    return map_batches(docs, batches, schema)
