"""Spectrum slicing and whitening against numpy and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayfinder.llm import whitening as w


def rotated(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.asarray(values, float)) @ q.T


@pytest.mark.parametrize("seed", range(4))
def test_counts_are_those_of_the_spectrum(seed):
    a = np.random.default_rng(seed).normal(size=(25, 25))
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    for shift in np.linspace(-8, 8, 23):
        assert w.above(a, shift) == (values > shift).sum()
    assert w.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # no pivot on the diagonal
    assert w.above(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1, 31), [5, 5, 5, 2, 1], np.ones(20), [1e9, 1, 1e-3], [1, 1 - 1e-9, 0.5], [3, 0, 0, 0], [0.0, 0.0],
        np.concatenate([[100], 1 + np.arange(40) * 1e-7]), [7.0],
    ],
)
def test_leading_values_and_vectors(values):
    a = rotated(values)
    a = (a + a.T) / 2
    found = w.leading(a, 16)
    want = np.sort(np.asarray(values, float))[::-1]
    want = want[want > len(want) * 1e-14 * max(want.max(), 1e-300)][:16]
    assert found.certified and len(found.values) == len(want)
    scale = max(want.max(initial=0), 1e-300)
    assert np.allclose(found.values / scale, want / scale, atol=1e-13)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(len(want)), atol=1e-12)
    assert np.abs(a @ found.vectors - found.vectors * found.values).max(initial=0) <= 1e-12 * scale


def whole(row):
    return [math.floor(64 * c) + 1_000_000 for c in row]


def check(spark, rows, kind="array<float>", most=16, extra=False):
    table = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").repartition(3)
    if extra:
        for name in ("id", "v", "d", "n", "packed", "copies", "component"):
            table = table.withColumn(name, F.lit(1))
    got = w.whiten(table, most=most).toPandas().sort_values(["id", "component"], na_position="first")
    narrow = np.float32 if kind == "array<float>" else np.float64
    kept = [
        (i, whole([float(narrow(c)) for c in v])) for i, v in rows
        if v is not None and all(c is not None and math.isfinite(narrow(c)) for c in v)
    ]
    lengths = [len(v) for _, v in kept]
    d = max(sorted(set(lengths)), key=lengths.count)
    kept = [(i, v) for i, v in kept if len(v) == d]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array([[float(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    covariance = x.T @ x / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    m = min(most, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == m * len(kept)
    deviation = sorted((i is not None, i or 0, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for i, v in kept)
    first = got[got.component == 1]
    assert sorted((i == i and i is not None, 0 if i != i else int(i), int(dv)) for i, dv in zip(first.id, first.deviation)) == deviation
    assert (got.n == n).all() and (got.identity_error < 1e-9).all() and got.identity_error.nunique() == 1
    for k in range(m):
        own = got[got.component == k + 1]
        assert np.allclose(own.explained, values[k] / np.trace(covariance), rtol=1e-9)
        want = [abs(sum(float(n * a - s) / n * u for a, s, u in zip(v, sums, vectors[:, k]))) / values[k] ** 0.5 for _, v in kept]
        assert np.allclose(np.sort(np.abs(own.whitened)), np.sort(want), atol=1e-8)
    return got


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(300, 24)) * np.linspace(1, 4, 24))]
    rows += [(i, rows[0][1]) for i in range(300, 500)]  # copies count once
    got = check(spark, rows, extra=True)
    copies = got[(got.id == 0) | (got.id >= 300)]
    assert copies.groupby("component").whitened.nunique().eq(1).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(40, 5)))]
    rows += [(None, rows[3][1]), (None, rows[4][1]), (5, rows[6][1]), (90, None), (91, []), (92, [1.0, None, 2.0, 3.0, 4.0]),
             (93, [float("nan")] * 5), (94, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (95, [1.0, 2.0])]
    check(spark, rows)


def test_wide_numbers_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(30, 4)) * [1, 1e2, 1e5, 1e5])]
    check(spark, rows, "array<double>")
    high = [(i, [float(i) * 2.0**40, 1.0 * i * i]) for i in range(9)]
    got = w.whiten(spark.createDataFrame(high, "vec_id long, embedding array<double>")).toPandas()
    assert got.deviation.isna().any()  # beyond a long


def test_few_vectors_give_few_components(spark):
    rows = [(0, [0.0, 1.0, 2.0]), (1, [3.0, 1.0, 2.5]), (2, [3.0, 1.0, 2.5])]
    assert set(check(spark, rows).component) == {1}
    for one in ([(0, [1.0, 2.0])] * 3, [], [(0, None)], [(1, [])]):
        table = spark.createDataFrame(one, "vec_id long, embedding array<float>")
        assert w.whiten(table).count() == 0
