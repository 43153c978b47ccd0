"""Rounds of moves over blocks of nodes against the same rounds as queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from muster.operators import blocks as blocks_module
from muster.operators import communities as operator
from muster.operators.blocks import Blocks, Labels, _placed, _rounded, xxhash64
from muster.operators.communities import communities
from muster.operators.graph import Arcs, undirected


def weighted(spark, groups=6, size=10, share=0.4, noise=40, seed=5):
    """Pairs of a planted graph with names as keys, weights of some decimals, and two nodes without edges."""
    draw = random.Random(seed)
    rows = [(k * size + i, k * size + j) for k in range(groups) for i in range(size) for j in range(i)
            if draw.random() < share]
    rows += [(draw.randrange(groups * size), draw.randrange(groups * size)) for _ in range(noise)]
    calls = spark.createDataFrame([(f"n{a}", f"n{b}", draw.choice([0.25, 1.0, 1.0, 2.7])) for a, b in rows],
                                  "src string, dst string, weight double")
    ids = spark.range(groups * size + 2).selectExpr("concat('n', id) AS k")
    return ids, undirected(calls, ids, "k", "weight")


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def places(blocks, state):
    parts = blocks.parts
    return blocks._table(state.rdd.map(lambda row: _placed(row[0], parts, None, row[1][1]))).collect()


def test_hashes_and_rounding_are_those_of_sql(spark):
    rows = spark.range(200).selectExpr("concat('k', id) AS k", "(id - 100) / 1024 + id / 7 AS x").selectExpr(
        "xxhash64(k) AS mark", "xxhash64(k, floor(7 / 2)) AS hash", "x", "round(x, 9) AS rounded").collect()
    assert (xxhash64(3, np.array([r.mark for r in rows])) == np.array([r.hash for r in rows])).all()
    assert (_rounded(np.array([r.x for r in rows])) == np.array([r.rounded for r in rows])).all()
    assert (_rounded(np.array([0.0009765625, -0.0009765625])) == np.array([0.000976563, -0.000976563])).all()


@pytest.mark.parametrize("one_block", [0, 10_000])
def test_rounds_of_blocks_make_the_moves_of_the_query(spark, monkeypatch, one_block):
    monkeypatch.setattr(blocks_module, "ONE_BLOCK", one_block)
    _, pairs = weighted(spark)
    graph = Arcs(pairs, sized=True, loops=True)
    total = graph.vertices.agg(F.sum("strength").alias("total"))
    start = graph.vertices.crossJoin(total).select("node", "salts", "strength", "total")
    start = start.union(start.where("node like '%7'"))  # keys that came twice
    blocks = Blocks(graph, start)
    assert (blocks.parts == 1) == bool(one_block)
    one, many = graph.place(start.selectExpr("*", "node AS c", "false AS want", "0D AS fit", "0 AS turn")), blocks._alone()
    for draws in (2, 2, 4, 8):
        one, wanting, fit = operator._round(graph, one, draws)
        many, wanted, fitted = blocks.round(many, draws)
        assert isinstance(many, Labels) and (wanting, round(fit, 12)) == (wanted, round(fitted, 12))
        assert sorted(one.select("node", "c").collect()) == sorted(places(blocks, many))
    assert wanting < graph.linked / 2
    blocks.close()
    graph.close()


def test_rounds_of_a_small_graph_start_no_jobs_of_their_own(spark):
    _, pairs = weighted(spark)
    graph = Arcs(pairs, sized=True, loops=True)
    start = graph.vertices.selectExpr("node", "salts", "strength", "1000D AS total")
    # As queries, two dozen rounds or more of several jobs each.
    assert jobs(spark, "small", lambda: operator._move_all(graph, start)) < 40
    graph.close()


def test_a_graph_without_edges_has_lonely_nodes(spark, monkeypatch):
    ids = spark.range(3).selectExpr("id AS k")
    none = spark.createDataFrame([], "src long, dst long, weight double")
    for one_block in (0, 10):
        monkeypatch.setattr(blocks_module, "ONE_BLOCK", one_block)
        assert sorted(map(tuple, communities(ids, "k", none).collect())) == [(0, 1), (1, 2), (2, 3)]
