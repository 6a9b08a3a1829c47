"""Whitening against numpy on whole numbers, and its defined cases."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from signalfold.llm.queries import QUERIES
from signalfold.llm.whitening import Whitener

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """vec_id -> (deviation, whitened of each component), and the shares of the variance; rows: (vec_id, list of floats)."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    off = [[n * c - s for c, s in zip(r, sums)] for r in x]
    centred = np.array(off, float) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(32, int((e > 1e-9 * e[0]).sum()))
    return n, [sum(c * c for c in r) for r in off], centred @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def held(frame):
    out = {}
    for r in frame.collect():
        out.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    return out


def vectors(n, width, seed=1, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale * (1 + j)) for j in range(width)]) for i in range(n)]


@pytest.mark.parametrize("width, scale", [(3, 1.0), (40, 1.0), (5, 3000.0)])
def test_whitening_matches_numpy(spark, width, scale):
    rows = vectors(200, width, scale=scale)
    bad = [(900, None), (901, []), (902, [1.0] * (width - 1) + [None]), (903, [float("nan")] * width), (904, [float("inf")] * width), (905, [1.0] * (width + 1))]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], SCHEMA).repartition(5)
    n, deviation, z, share = brute(rows)
    got = Whitener(frame.withColumns({"n": F.lit("x"), "off": F.lit(1), "z": F.lit(2), "deviation": F.lit(3)})).whiten()
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = held(got)
    assert sorted(got) == sorted(zip([i for i, _ in rows], deviation))
    at = {i: r for r, (i, _) in enumerate(rows)}
    found = np.array([[c[k + 1].whitened for k in range(len(share))] for (i, _), c in sorted(got.items(), key=lambda x: at[x[0][0]])])
    assert np.allclose(found * np.sign((found * z).sum(axis=0)), z, atol=1e-9)
    one = next(iter(got.values()))
    assert len(one) == len(share) and np.allclose([one[k + 1].explained for k in range(len(share))], share, rtol=1e-9)
    assert {(r.n, r.identity_error) for c in got.values() for r in c.values()} == {(n, one[1].identity_error)} and one[1].identity_error < 1e-9


def test_whitened_rows_have_a_unit_covariance(spark):
    got = held(QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001"))
    z = np.array([[c[k].whitened for k in sorted(c)] for c in got.values()])
    z = z - z.mean(axis=0)
    measured = np.abs(z.T @ z / len(z) - np.eye(z.shape[1])).max()
    assert z.shape[1] == 32 and measured < 1e-9 and next(iter(got.values()))[1].identity_error < 1e-9


def test_repeated_rows_count_and_constant_vectors_give_nothing(spark):
    rows = vectors(30, 4)
    twice = [*rows, *rows, (None, rows[0][1])]
    got = Whitener(spark.createDataFrame([(i, v, 1) for i, v in twice], SCHEMA)).whiten().collect()
    assert len(got) == 61 * 4 and {r.n for r in got} == {61} and sum(r.vec_id is None for r in got) == 4
    for few in ([], rows[:1], [(i, [1.5, -2.0]) for i in range(9)], [(1, None)]):
        none = Whitener(spark.createDataFrame([(i, v, 1) for i, v in few], SCHEMA)).whiten()
        assert none.count() == 0 and none.columns[0] == "vec_id"
    # Dimensions that say the same: as many components as there is variance in.
    flat = Whitener(spark.createDataFrame([(i, [v[0], v[0], 2.0], 1) for i, v in rows], SCHEMA)).whiten().collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1)


def test_sums_beyond_long_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e18], 1), (2, [-1e18], 1), (3, [1e18], 1)], SCHEMA)
    with pytest.raises(PySparkException, match="OVERFLOW"):
        Whitener(frame).whiten().collect()
