"""Whitening: dense eigenvectors as reference, exact integers, degenerate tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.llm import chebyshev_whitening as W

KIND = "vec_id long, vec array<long>"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [int(v) for v in row]) for i, row in zip(ids if ids is not None else range(len(x)), x, strict=True)], KIND)


def dense(x):
    off = len(x) * x.astype(object) - x.astype(object).sum(0)
    xc = (off / len(x)).astype(float)
    values, axes = np.linalg.eigh(xc.T @ xc / len(x))
    order = np.argsort(-values)
    return values[order], axes[:, order], xc, (off * off).sum(1)


@pytest.mark.parametrize("dim,components", [(24, 5), (60, 8), (6, 32)])
def test_equals_dense_eigenvectors(spark, dim, components):
    rng = np.random.default_rng(dim)
    x = np.floor(rng.standard_normal((500, dim)) * np.linspace(90, 20, dim)).astype(int) + 1_000_000
    fit, rows = W.whiten(frame(spark, x).withColumn("id", F.lit(3)).withColumn("whitened", F.lit("clash")), "vec_id", "vec", components, oversample=4)
    values, axes, xc, deviation = dense(x)
    k = min(dim, components)
    got = {r.id: r for r in rows.collect()}
    w = np.array([got[i].whitened for i in range(500)])
    want = xc @ axes[:, :k] / np.sqrt(values[:k])
    sign = np.sign((w * want).sum(0))
    assert np.abs(w * sign - want).max() < 1e-9 and fit.identity_error < 1e-10
    assert np.allclose(fit.explained, values[:k] / values.sum(), rtol=1e-10)
    assert [got[i].deviation for i in range(500)] == deviation.tolist()


def test_clustered_spectrum_grows_the_block():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    v = (q * np.concatenate([[5.0, 4.0], 1 + 1e-9 * rng.random(70), np.zeros(8)])) @ q.T
    values, vectors = W.eigenpairs(lambda b: v @ b, 80, 6, 4, 1e-13, patience=2)
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-12


def test_nulls_padding_repeats_and_rank(spark):
    rows = [(1, [3, 4, 5]), (1, [3, 4, 5]), (2, None), (3, [1, None, 2]), (4, []), (None, [7]), (5, [3, 4, 9])]
    fit, out = W.whiten(spark.createDataFrame(rows, KIND), "vec_id", "vec")
    got = sorted((r.id if r.id is not None else -1, r.deviation) for r in out.collect())
    x = np.array([[3, 4, 5], [3, 4, 5], [0, 0, 0], [7, 0, 0], [3, 4, 9]])
    assert fit.n == 5 and got == sorted(zip([1, 1, 4, -1, 5], dense(x)[3].tolist(), strict=True)) and len(fit.values) == 3
    fit, out = W.whiten(frame(spark, np.full((4, 3), 9)), "vec_id", "vec")
    assert len(fit.values) == 0 and [(r.whitened, r.deviation) for r in out.collect()] == [([], 0)] * 4
    fit, out = W.whiten(spark.createDataFrame([(1, None)], KIND), "vec_id", "vec")
    assert fit is None and out.count() == 0
    fit, out = W.whiten(spark.createDataFrame([(1, [])], KIND), "vec_id", "vec")
    assert fit is None and [r.deviation for r in out.collect()] == [0]


def test_large_values_stay_exact_or_null(spark):
    x = np.array([[2**40, 5], [2**40 + 3, 1], [2**40 - 7, 2], [2**40, 2**31]])
    _, out = W.whiten(frame(spark, x), "vec_id", "vec")
    want = [d if d < 2**63 else None for d in dense(x)[3].tolist()]
    assert [r.deviation for r in out.orderBy("id").collect()] == want and None in want


def test_quantised_and_finite(spark):
    rows = [(1, [0.5, -0.26]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (5, [None, 1.0]), (6, [1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").where(W.finite("e")).select("vec_id", W.quantised("e").alias("x"))
    assert {r.vec_id: r.x for r in df.collect()} == {1: [1_000_032, 999_983], 6: [2**52 + 1_000_000, -(2**52) + 1_000_000]}
