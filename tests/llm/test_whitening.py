from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from muster.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors):
    """Whole numbers, exact covariance, components by numpy from it."""
    x = [[floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[i] for row in x) for i in range(d)]
    apart = [[n * row[i] - s[i] for i in range(d)] for row in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in apart), n ** 3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    mean = np.array([float(Fraction(k, n)) for k in s])
    return ([sum(a * a for a in row) for row in apart], values / np.trace(v),
            (np.array(x, float) - mean) @ axes / np.sqrt(np.maximum(values, 1e-300)))


def rows_of(spark, rows):
    return whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()


def test_equals_plain_whitening(spark):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.2 + 0.5
    vectors = [[float(np.float32(c)) for c in row] for row in mixed]
    found = rows_of(spark, [(i, v, 0) for i, v in enumerate(vectors)])
    deviation, explained, whitened = plain(vectors)
    assert len(found) == 300 * 8 and {r["n"] for r in found} == {300}
    assert {r["identity_error"] for r in found} == {max(r["identity_error"] for r in found)}
    assert found[0]["identity_error"] < 1e-9
    got = np.zeros((300, 8))
    for r in found:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]] == int(r["deviation_exact"])
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    for k in range(8):
        assert min(np.abs(got[:, k] - whitened[:, k]).max(), np.abs(got[:, k] + whitened[:, k]).max()) < 1e-8
    assert np.abs(got.T @ got / 300 - np.eye(8)).max() < 1e-9


def test_odd_vectors(spark):
    good = [(i, [i * 0.1, (i * 7 % 5) * 0.3, (i * i % 11) * 0.2], 1) for i in range(20)]
    bad = [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [nan, 1.0, 1.0], 1), (103, [inf, 1.0, 1.0], 1),
           (104, [1.0], 1), (105, [], 1), (106, [1.0] * 50, None)]
    found = rows_of(spark, good + bad + [(None, good[3][1], 1), good[5]])
    assert len(found) == 22 * 3 and {r["n"] for r in found} == {22}
    twins = [r["whitened"] for r in found if r["vec_id"] is None]
    assert twins == [r["whitened"] for r in found if r["vec_id"] == 3]
    assert rows_of(spark, []) == [] and rows_of(spark, bad[:4]) == []


def test_wide_numbers_stay_exact(spark):
    vectors = [[float(np.float32(c)) for c in row] for row in np.random.default_rng(2).normal(size=(40, 3)) * 1e9]
    found = rows_of(spark, [(i, v, 0) for i, v in enumerate(vectors)])
    deviation, _, _ = plain(vectors)
    assert all(int(r["deviation_exact"]) == deviation[r["vec_id"]] for r in found)
    assert any(r["deviation"] is None for r in found) and found[0]["identity_error"] < 1e-6


def test_directions_without_variance(spark):
    same = rows_of(spark, [(i, [0.25, 0.5], 0) for i in range(5)])
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(0.0, 0.0, 0.0, 0)}
    line = rows_of(spark, [(i, [i * 0.5, i * 0.5], 0) for i in range(9)])
    assert {r["whitened"] for r in line if r["component"] == 2} == {0.0}
    assert line[0]["identity_error"] < 1e-9


def test_clashing_columns_and_hot_copies(spark):
    rows = [(i, [float(i % 7), float(i % 3)] if i % 3 else [1.0, 2.0], 0) for i in range(90)]
    frame = spark.createDataFrame(rows, SCHEMA)
    more = frame.withColumns({c: F.lit(1) for c in ("__id", "v", "n", "place", "component")})
    key = lambda r: (r["vec_id"], r["component"])
    assert sorted(whitening.whiten(more).collect(), key=key) == sorted(whitening.whiten(frame).collect(), key=key)
