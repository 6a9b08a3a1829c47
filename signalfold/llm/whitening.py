"""Whitening of embeddings: RowMatrix over exactly centred rows, then local eigh and broadcast components.

1. Entries become integers on a grid (floor(c * SCALE) + SHIFT), so that counts and sums of each dimension are exact longs,
   taken in one aggregation of partial sums. A row is centred as n*x - S, a whole number; divided by n it is rounded once.
2. RowMatrix.computeGramianMatrix over the centred rows, divided by n, is the covariance: a d x d matrix, summed by
   treeAggregate on the executors, whatever the number of rows.
3. The driver decomposes it (numpy's eigh); mapInArrow projects each row on the broadcast components over their
   standard deviations. Columns are as wide as the dimension; nothing that grows with the rows leaves the executors.
4. The whitened rows are centred by their own mean and go through RowMatrix again: the largest entry of their covariance
   minus the identity is the reported error, measured on all rows.

Defined cases: rows with a null vector, an empty one, or a null or non-finite entry go; of vectors of several lengths the most
frequent length (of those the greater) stays; a null vec_id stays null; repeated rows and repeated ids count as often as
they come; equal eigenvalues keep the order that eigh gives them; components whose variance is below LEAST of the greatest
are rounding noise and not returned, so that constant vectors, a single row and an empty table give an empty result; an
entry beyond the range of long in these sums is an error (arithmetic overflow), never a wrapped number; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The grid that entries are put on: cells a unit, and what is added so that numbers are positive (fixed values).
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Share of the greatest variance under which a component is noise of the doubles.
LEAST = 1e-9
#: Rows that a task projects at a time.
ROWS = 4096


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


@dataclass
class Whitening:
    """What was fitted: the number of vectors, sums of each dimension, components as columns over their standard deviations,
    variances, the trace of the covariance, and how far the whitened covariance is from the identity."""

    n: int
    sums: list[int]
    matrix: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0


class Whitener:
    def __init__(self, vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS):
        own = F.col(f"`{vector}`").cast("array<double>")
        # The grid, as long; floor of a double is one.
        grid = F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long"))
        # The guard is part of the expression, as filters move freely.
        self.rows = vectors.select(F.col(f"`{id}`").alias("vec_id"), own.alias("v")).select("vec_id", F.when(_usable(F.col("v")), grid).alias("x")).where("x is not null")
        self.components = components

    def _sums(self) -> tuple[int, list[int]]:
        cells = self.rows.select(F.size("x").alias("size"), F.posexplode("x").alias("at", "x"))
        sums: dict[int, list] = {}
        for r in cells.groupBy("size", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s")).collect():  # one row a dimension
            sums.setdefault(r["size"], []).append((r["at"], r["n"], r["s"]))
        if not sums:
            return 0, []
        size = max(sums, key=lambda k: (sums[k][0][1], k))
        return sums[size][0][1], [s for _, _, s in sorted(sums[size])]

    def _centred(self, n: int, sums: list[int]) -> DataFrame:
        """vec_id and `off`: n*x - S of each dimension, whole numbers."""
        total = F.array(*(F.lit(s).cast("long") for s in sums))
        off = F.zip_with("x", total, lambda x, s: F.lit(n).cast("long") * x - s)
        return self.rows.where(F.size("x") == len(sums)).select("vec_id", off.alias("off"))

    @staticmethod
    def _covariance(rows: DataFrame, n: int, width: int) -> np.ndarray:
        """The covariance of centred rows (an array of doubles in `c`)."""
        vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("c").alias("c")), "c")
        return RowMatrix(vectors, n, width).computeGramianMatrix().toArray() / n

    def _projected(self, rows: DataFrame, fit: Whitening) -> DataFrame:
        """vec_id, off and `z`: the row's whitened components."""
        held = rows.sparkSession.sparkContext.broadcast(fit.matrix)
        n, width = fit.n, len(fit.sums)

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = held.value
            for whole in it:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    off = b.column(1).flatten().to_numpy().reshape(b.num_rows, width)
                    z = (off / n) @ w
                    ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * w.shape[1])
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], names=["vec_id", "off", "z"])

        schema = T.StructType([*rows.schema.fields, T.StructField("z", T.ArrayType(T.DoubleType()))])
        return rows.mapInArrow(batches, schema)

    def fit(self) -> Whitening | None:
        """None where nothing varies."""
        n, sums = self._sums()
        if not n:
            return None
        rows = self._centred(n, sums)
        v = self._covariance(rows.select(F.transform("off", lambda c: c.cast("double") / F.lit(float(n))).alias("c")), n, len(sums))
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        k = int(np.searchsorted(-e[:self.components], -LEAST * e[0])) if e[0] > 0 else 0
        if not k:
            return None
        u = u[:, :k] * np.where(np.take_along_axis(u[:, :k], np.abs(u[:, :k]).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
        fit = Whitening(n, sums, u / np.sqrt(e[:k]), e[:k], float(np.trace(v)))
        z = self._projected(rows, fit)
        mean = z.select(Summarizer.mean(array_to_vector("z")).alias("m")).first().m.toArray()
        means = F.array(*(F.lit(float(m)) for m in mean))
        again = self._covariance(z.select(F.zip_with("z", means, lambda a, m: a - m).alias("c")), n, k)
        fit.identity_error = float(np.abs(again - np.eye(k)).max())
        return fit

    def whiten(self) -> DataFrame:
        """One row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
        fit = self.fit()
        kind = self.rows.schema["vec_id"].dataType.simpleString()
        if fit is None:
            made = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
            return self.rows.sparkSession.createDataFrame([], made)
        deviation = F.aggregate("off", F.lit(0).cast("long"), lambda total, c: total + c * c)
        z = self._projected(self._centred(fit.n, fit.sums), fit).select("vec_id", deviation.alias("deviation"), F.posexplode("z").alias("at", "whitened"))
        explained = F.array(*(F.lit(float(e / fit.trace)) for e in fit.variances))
        return z.select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
            F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(fit.identity_error).alias("identity_error"))
