"""Whitening against exact fractions, and odd vectors."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tagloom.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def whole(v):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]


def exact_covariance(xs):
    n, dims = len(xs), len(xs[0])
    mean = [Fraction(sum(x[k] for x in xs), n) for k in range(dims)]
    d = [[x[k] - mean[k] for k in range(dims)] for x in xs]
    return [[sum(r[i] * r[j] for r in d) / n for j in range(dims)] for i in range(dims)]


def test_products_are_exact():
    rng = np.random.default_rng(1)
    d = rng.normal(size=(50, 4)) * 10.0 ** rng.integers(-9, 9, size=(50, 4))
    total = W.Outer(4)
    total.add(d, np.zeros_like(d))
    for i in range(4):
        for j in range(4):
            want = sum(Fraction(a) * Fraction(b) for a, b in zip(d[:, i].tolist(), d[:, j].tolist(), strict=True))
            off = abs(Fraction(total.high[i, j]) + Fraction(total.low[i, j]) - want)
            scale = sum(abs(Fraction(a) * Fraction(b)) for a, b in zip(d[:, i].tolist(), d[:, j].tolist(), strict=True))
            assert off <= scale * Fraction(1, 2**95)


def test_against_fractions(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1 + 2 * k) + 1000 * k for k in range(5)], 0) for i in range(90)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    xs = [whole(v) for _, v, _ in rows]
    mean = W.fitted_mean(frame.selectExpr("embedding AS vector"))
    assert mean.n == 90 and mean.sums == [sum(x[k] for x in xs) for k in range(5)]
    high, low = W.covariance(frame.selectExpr("embedding AS vector"), mean)
    exact = exact_covariance(xs)
    for i in range(5):
        for j in range(5):
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact[i][j]) <= abs(exact[i][i] + exact[j][j]) * Fraction(1, 2**90)
    values, basis = np.linalg.eigh(np.array([[float(v) for v in row] for row in exact]))
    found = {(r["vec_id"], r["component"]): r for r in W.whiten(frame).collect()}
    assert len(found) == 90 * 5
    for i, x in enumerate(xs):
        for c in range(1, 6):
            r = found[i, c]
            assert r["n"] == 90 and r["deviation"] == sum((90 * a - s) ** 2 for a, s in zip(x, mean.sums, strict=True)) == int(r["deviation_decimal"])
            want = sum((a - s / 90) * b for a, s, b in zip(x, mean.sums, basis[:, -c], strict=True)) / math.sqrt(values[-c])
            assert abs(abs(r["whitened"]) - abs(want)) < 1e-8
            assert abs(r["explained"] - values[-c] / values.sum()) < 1e-12 and r["identity_error"] < 1e-10
    signs = {c: {np.sign(found[i, c]["whitened"] * sum((a - s / 90) * b for a, s, b in zip(x, mean.sums, basis[:, -c], strict=True))) for i, x in enumerate(xs)} for c in range(1, 6)}
    assert all(len(s) == 1 for s in signs.values())


def test_odd_vectors(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(1, v, 0), (1, v, None), (2, None, 0), (3, [0.1, None, 0.2], 0), (4, [float("nan"), 0.0, 0.0], 0), (5, [float("inf"), 0.0, 0.0], 0), (6, [], 0), (7, [1.0, 2.0], 0), (None, [0.0, 0.0, 0.0], 0), (8, [1e30, 0.0, 0.0], 0)]
    found = W.whiten(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS vector", "3 AS key", "4 AS component")).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in found) == sorted([(False, 1, c) for c in (1, 1, 2, 2, 3, 3)] + [(True, 0, c) for c in (1, 2, 3)])
    assert all(r["n"] == 3 and (r["whitened"] == 0 and r["explained"] < 1e-12 if r["component"] > 1 else abs(r["explained"] - 1) < 1e-12) for r in found)
    assert found[0]["identity_error"] < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)]])
def test_nothing_to_fit(spark, rows):
    out = W.whiten(spark.createDataFrame(rows, SCHEMA))
    assert out.collect() == [] and out.columns[:3] == ["vec_id", "component", "n"]


def test_one_vector_has_no_variance(spark):
    (a, b) = W.whiten(spark.createDataFrame([(1, [0.5, 2.0], 0)], SCHEMA)).orderBy("component").collect()
    assert (a["deviation"], a["whitened"], a["explained"], a["identity_error"]) == (0, 0, 0, 0) and b["component"] == 2


def test_deviations_beyond_a_long():
    mean = W.Mean(10**9, [7 * 10**9 + 3, -(10**18)])
    x = np.array([[10**6, -(10**9) + 5], [7, -(10**9)]])
    assert mean.deviations(x) == [sum((10**9 * a - s) ** 2 for a, s in zip(row, mean.sums, strict=True)) for row in x.tolist()]
