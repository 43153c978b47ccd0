"""The additive model on known functions, and quality on the held-out fold."""

import zlib

import numpy as np
from conftest import DATA

from muster.llm import additive
from muster.llm.common import table


def test_learns_a_curve_and_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((6000, 3))
    bump = np.abs(x[:, 0] - 0.5) < 0.2
    cross = (x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)
    y = cross.astype(float)
    model = additive.fit(x[:4000], y[:4000], pairs=1)
    assert model.pairs == [(1, 2)]
    assert ((model.scores(x[4000:]) > 0.5) == y[4000:]).mean() > 0.95
    y = bump.astype(float)
    model = additive.fit(x[:4000], y[:4000], pairs=0)
    assert ((model.scores(x[4000:]) > 0.5) == y[4000:]).mean() > 0.95


def test_step_is_the_best_of_all_cuts():
    rng = np.random.default_rng(2)
    for _ in range(30):
        g, h = rng.normal(size=(4, 5)), rng.random((4, 5))
        best = max(sum(s.sum() ** 2 / (t.sum() + 1) for s, t in [
            (g[:r, :c], h[:r, :c]), (g[:r, c:], h[:r, c:]), (g[r:, :c], h[r:, :c]), (g[r:, c:], h[r:, c:])])
            for r in range(1, 4) for c in range(1, 5))
        assert np.isclose(additive._quadrants(g, h)[1] + g.sum() ** 2 / (h.sum() + 1), best)


def test_held_out_accuracy_on_documents(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = {r.doc_id: r for r in additive.score(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    judged = [(got[r.doc_id], r.quality) for r in labels.collect()]
    held = [(r.predicted, q) for r, q in judged if r.held_out]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) >= 0.95


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "x" * 5000, "c"), (5, "some words", "d"), (5, "some words", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = [tuple(r) for r in additive.score(docs, labels).collect()]
    assert sorted(got, key=repr) == sorted(
        [(k, k is not None and zlib.crc32(str(k).encode()) % 5 == 0, 0.5, 1) for k, *_ in rows], key=repr)
    both = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    assert additive.score(docs, both).count() == 5
    assert additive.score(docs.limit(0), both).count() == 0
