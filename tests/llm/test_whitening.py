"""Whitening against dense linear algebra in memory."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    for c in ("v", "d", "at", "total", "part", "component", "n", "whitened"):
        df = df.withColumn(c, F.lit("x"))
    return df


def dense(vectors, wanted=32):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    off = x * n - sums
    mean = (off / n).astype(float)
    e, q = np.linalg.eigh(mean.T @ mean / n)
    return n, (off * off).sum(1), mean, e[::-1][:wanted], q[:, ::-1][:, :wanted]


def test_whitening_is_that_of_dense_algebra(spark):
    rng = np.random.default_rng(1)
    scale = np.r_[5.0, 4.0, 4.0, 3.0, np.linspace(2, 0.5, 36)]
    good = (rng.standard_normal((700, 40)) * scale).astype(np.float32).tolist()
    good += [good[3], good[3]]
    odd = [None, [], [1.0] * 39, [float("nan")] + [0.0] * 39, [float("inf")] * 40, [None] + [1.0] * 39]
    rows = [(i, v) for i, v in enumerate(good)] + [(5000 + i, v) for i, v in enumerate(odd)] + [(None, good[0])]
    df = frame(spark, rows).repartition(5)
    w = whitening.learn(df)
    n, squares, centred, e, q = dense([v for _, v in rows[: len(good)]] + [good[0]])
    assert (w.fit.n, len(w.values)) == (n, 32)
    np.testing.assert_allclose(w.values, e, rtol=1e-12)
    cov = centred.T @ centred / n
    assert np.abs(cov @ w.vectors - w.vectors * w.values).max() < 1e-12 * e[0]
    got = whitening.whiten(df, w).collect()
    assert len(got) == n * 32 and {r.vec_id for r in got} == {*range(len(good)), None}
    assert all(r.identity_error <= 1e-9 and r.n == n for r in got)
    by = {(r.vec_id, r.component): r for r in got}
    for i in (0, 3, 77, 699):
        assert int(by[i, 1].deviation) == squares[i]
        for k in (1, 4, 20, 32):
            r = by[i, k]
            assert abs(abs(r.whitened) - abs(centred[i] @ w.vectors[:, k - 1] / math.sqrt(e[k - 1]))) < 1e-9
            assert abs(r.explained - e[k - 1] / np.trace(cov)) < 1e-12
    assert by[700, 2].whitened == by[3, 2].whitened


@pytest.mark.parametrize("dims, tail", [(300, 0.97), (150, 1.0)])
def test_jacobi_davidson_restarts_and_locks(dims, tail):
    """Spaces larger than the search space, with falling and nearly flat spectra."""
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    e = 3.0 * tail ** np.arange(dims) + (0 if tail < 1 else np.linspace(1, 0, dims))
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    asked = []
    values, vectors = whitening.leading(lambda b: asked.append(b.shape[1]) or a @ b, dims)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(a)[::-1][:32], rtol=1e-12)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * e.max()
    assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-12 and max(asked) <= whitening.BLOCK


def test_degenerate_tables(spark):
    one = whitening.learn(frame(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]))
    assert len(one.values) == 1 and one.identity_error < 1e-9  # one direction has variance
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        df = frame(spark, rows)
        assert whitening.whiten(df, whitening.learn(df)).count() == 0
    big = frame(spark, [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(big, whitening.learn(big)).where("component = 1").collect()}
    x = {1: (64 * 10**9, 0), 2: (-64 * 10**9, 64), 3: (0, 0)}
    sums = [sum(v[k] for v in x.values()) for k in (0, 1)]
    assert got == {i: sum((3 * v[k] - sums[k]) ** 2 for k in (0, 1)) for i, v in x.items()}
    with pytest.raises(Exception, match="too large"):
        whitening.learn(frame(spark, [(1, [1e300, 0.0])], "vec_id long, embedding array<double>"))
