"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's letters (small ones; other characters are one blank) give 1- to 3-grams, hashed to 2^BITS columns; a
row is log1p(count) x idf at unit length; the document frequencies are those of all rows to learn from, summed by
partition. FTRL-proximal with elastic-net penalties fits the weights on a hash sample of at most SAMPLE_ROWS rows, in
which each language has an equal share, and a fifth of which is kept back to choose the temperature that divides the
logits (least negative log-likelihood).

Defined cases: a null text and one without a letter are `und` with score 0; so is every text where no
language was learnt; repeated rows get equal results, and of equally likely languages the first in order of name counts;
an empty table gives an empty result; long texts are read whole; doc_id may be of any type and null; other columns pass
through, but for those named `lang_pred` or `score`, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalfold.llm.linear import Ftrl, labelled_sample
from signalfold.llm.store import map_batches, ship, slices

SAMPLE_ROWS, BITS, EPOCHS, UNKNOWN = 6_000, 15, 2, "und"
_PRIMES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
#: Texts are hashed so many characters at a time (counts are added up).
_PIECE = 1 << 18


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns with n-grams, ascending, and how many each has."""
    total = np.zeros(1 << BITS, np.int64)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, max(1, len(c) - 2), _PIECE):
        x = c[at:at + _PIECE + 2]
        x = np.where(_LETTER[x], x, np.uint32(32))
        y, z = x[:-1], x[:-2]
        one = x[:_PIECE] * _PRIMES[0]
        two = (y * _PRIMES[0] ^ np.roll(x, -1)[:-1] * _PRIMES[1])[:_PIECE]
        three = (z * _PRIMES[0] ^ y[1:] * _PRIMES[1] ^ x[2:] * _PRIMES[2])[:_PIECE]
        for n, h in enumerate((one, two, three)):
            h = (h + np.uint32(n)) * _PRIMES[2]
            total += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    ids = np.flatnonzero(total)
    return ids, total[ids]


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0)))
    temperature: float = 1.0

    def row(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf[ids]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        ids, n = counts(text)
        p = softmax(self.row(ids, n) @ self.weights[ids] / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 5, df: np.ndarray | None = None, total: int = 0) -> Model:
    """df: in how many of `total` texts each column is; where there is none, those of the rows themselves count."""
    model = Model(sorted(set(labels)))
    if not rows:
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    back = order[: len(order) // 5]
    learn = order[len(back):]
    if df is None:
        df, total = np.zeros(1 << BITS), len(learn)
        for i in learn:
            df[rows[i][0]] += 1
    model.idf = np.log((1 + total) / (1 + df)) + 1
    y = np.array([model.languages.index(v) for v in labels])
    x = [model.row(*r) for r in rows]
    ftrl = Ftrl(1 << BITS, len(model.languages), alpha=1.0, l1=0.02, l2=0.01)
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for i in learn:
            ids = rows[i][0]
            w = ftrl.weights(ids)
            g = softmax(x[i] @ w)
            g[y[i]] -= 1
            ftrl.update(ids, w, x[i][:, None] * g[None, :])
    model.weights = ftrl.weights()
    if len(back):
        logits = np.array([x[i] @ model.weights[rows[i][0]] for i in back])
        loss = {t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(back)), y[back]], 1e-12)).sum() for t in np.geomspace(0.05, 10, 60)}
        model.temperature = float(min(loss, key=loss.get))
    return model


def train(docs: DataFrame, bound: int = SAMPLE_ROWS) -> Model:
    """docs: the rows to learn from (doc_id, text, lang); rows without a language or a letter teach nothing."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, docs.select("doc_id", F.col("lang").alias("y")), bound, each=True)

    def frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((1 << BITS) + 1, np.int64)  # the last place counts the texts
        for whole in it:
            for b in slices(whole, 0):
                for t in b.column(0).to_pylist():
                    if has_letter(t):
                        df[counts(t)[0]] += 1
                        df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["at", "n"])

    # A row for each column at most reaches the driver.
    seen = docs.where("lang is not null").select("text").mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((1 << BITS) + 1)
    df[seen["at"].to_numpy()] = seen["n"].to_numpy()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in slices(whole, 1):
                rows = [counts(t) if has_letter(t) else None for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array([None if r is None else r[0] for r in rows], pa.list_(pa.int32())), pa.array([None if r is None else r[1] for r in rows], pa.list_(pa.int32()))],
                    names=["doc_id", "y", "ids", "n"])

    t = sample.select("doc_id", "text", "y").mapInArrow(batches, "doc_id long, y string, ids array<int>, n array<int>").where("ids is not null").toArrow().sort_by("doc_id")
    rows = [(np.array(i.values), np.array(n.values)) for i, n in zip(t["ids"], t["n"], strict=True)]
    return fit(rows, t["y"].to_pylist(), df=df[:-1], total=int(df[-1]))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("lang_pred string, score double").fields])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (b for whole in it for b in slices(whole, place)):
            found = [m.predict(t) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return map_batches(docs, batches, schema)
