"""What the trained operators share: bounded labelled samples, and FTRL-proximal on sparse rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SLOTS = 1 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, each: bool = False) -> DataFrame:
    """doc_id, text and y for about `bound` (at most) of the labelled documents, picked by a hash of doc_id.

    labels holds doc_id and y; null ids and labels are left out, and of repeated ids the largest y counts. doc_id may be
    of any type; it comes back as a long, which gives rows an order: an integer as it is, anything else as a hash.
    each: every value of y has an equal share of the bound, so that rare ones are learnt.
    """
    clean = labels.where("doc_id is not null and y is not null")
    counts = {r.y: r["count"] for r in clean.groupBy("y").count().collect()} if each else {None: clean.count()}
    share = bound / max(1, len(counts))
    slots = {y: _SLOTS if n <= share else max(1, int(_SLOTS * 0.95 * share / n)) for y, n in counts.items()}
    limit = F.element_at(F.create_map(*(F.lit(v) for pair in slots.items() for v in pair)), F.col("y")) if each and slots else F.lit(slots.get(None, 0))
    picked = clean.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(_SLOTS)) < limit).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    key = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.xxhash64("doc_id")
    return rows.select(key.alias("doc_id"), "text", "y")


class Ftrl:
    """Per-coordinate FTRL-proximal with elastic-net penalties for weights of shape (features, outputs)."""

    def __init__(self, features: int, outputs: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.1):
        self.z, self.n = np.zeros((features, outputs)), np.zeros((features, outputs))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[rows])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, rows: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """g: gradient for the (distinct) rows at weights w."""
        n = self.n[rows]
        grown = n + g * g
        self.z[rows] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = grown


def vocabulary_of(ids: Sequence[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids found in at least `least` rows (whose ids are distinct), and in how many."""
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    seen, n = np.unique(np.concatenate(ids), return_counts=True)
    return seen[n >= least], n[n >= least]


def places(seen: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ids are in sorted `seen`, their places)."""
    if not len(seen):
        return np.zeros(len(ids), bool), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(seen, ids), len(seen) - 1)
    hit = seen[at] == ids
    return hit, at[hit]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
