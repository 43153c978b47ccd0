"""Communities of a weighted graph by modularity, re-split until they are small.

Moves are decided for all nodes at once: each round every node looks at the weight it
shares with each neighbouring community and takes the best one (Blondel et al., 2008;
simultaneous moves as in Lu et al., 2015). Groups of nodes, drawn by a hash of node and round,
move one after the other, so neighbours seldom swap places. Rounds run over blocks of nodes
(``blocks``), or as joins and aggregates where a hub's edges need several partitions; all else is a join or
an aggregate keyed by node or community. No part of the graph is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import TypeVar

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from muster.functions.ranking import aggregate_apart, global_row_number
from muster.operators.blocks import Blocks
from muster.operators.graph import EDGES_PER_SALT, Arcs
from muster.session import cut_lineage

# Parameters of the feature.
MAX_SIZE = 40
MAX_DEPTH = 6

# A level has converged once no node gains by moving, or once modularity has not grown by more
# than TOLERANCE over rounds in which every node had its turn, with all nodes drawn into as many
# as MOST_DRAWS groups that move one after the other.
TOLERANCE = 1e-5
DRAWS, MOST_DRAWS = 2, 8

State = TypeVar("State")


def communities(nodes: DataFrame, key: str, pairs: DataFrame, max_size: int = MAX_SIZE,
                depth: int = MAX_DEPTH, per_salt: int = EDGES_PER_SALT) -> DataFrame:
    """``(node, community)``: ids 1..k in order of the smallest member.

    Each node gets its coarsest community of at most ``max_size`` members. Communities that
    are larger from the start are solved again, all of them in one pass that only keeps the
    edges inside them, in up to ``depth`` passes. One that does not split stays whole.
    """
    ids = nodes.select(F.col(key).alias("node"))
    pairs = cut_lineage(pairs.where((F.col("src") != F.col("dst")) & (F.col("weight") > 0)))
    whole = ids.withColumn("label", F.lit(None).cast(ids.schema["node"].dataType))
    found = cut_lineage(_refine(ids, _best_split(whole, pairs, max_size, per_salt)))
    for _ in range(depth):
        sizes = found.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.where(F.col("n") > max_size).select("label")
        inside = cut_lineage(found.join(large, "label", "left_semi").select("node", "label"))
        if inside.isEmpty():
            break
        left = inside.select(F.col("node").alias("src"), F.col("label").alias("src_label"))
        right = inside.select(F.col("node").alias("dst"), F.col("label").alias("dst_label"))
        kept = pairs.join(left, "src").join(right, "dst").where("src_label = dst_label")
        split = _best_split(inside, kept.select("src", "dst", "weight"), max_size, per_salt)
        again = _refine(inside.select("node"), split)
        finer = cut_lineage(_refine(found.select("node"), again, found))
        if finer.select("label").distinct().count() == sizes.count():
            break
        found = finer
    return number_communities(found)


def number_communities(found: DataFrame) -> DataFrame:
    """Replace labels by 1..k in order of each community's smallest node."""
    first = aggregate_apart(found, ["label"], F.min("node").alias("first"))
    numbered = global_row_number(first, [F.col("first")], "community")
    return found.join(numbered.select("label", "community"), "label").select("node", "community")


def _refine(nodes: DataFrame, split: DataFrame, otherwise: DataFrame | None = None) -> DataFrame:
    """Label per node from ``split``, else the earlier one, else the node itself."""
    fresh = split.select("node", F.col("label").alias("fresh"))
    out = nodes.join(fresh, "node", "left")
    if otherwise is None:
        return out.select("node", F.coalesce("fresh", "node").alias("label"))
    out = out.join(otherwise.select("node", F.col("label").alias("earlier")), "node", "left")
    return out.select("node", F.coalesce("fresh", "earlier").alias("label"))


def _best_split(grouped: DataFrame, pairs: DataFrame, max_size: int, per_salt: int) -> DataFrame:
    """Modularity communities ``(node, label)`` of the linked nodes, per group of ``grouped``.

    The groups share no edges, so they are solved together, each with its own total weight.
    Communities are merged level by level until nothing merges any more; a node keeps the last
    label with few enough members.
    """
    graph = Arcs(pairs, per_salt, sized=True, loops=True)
    strengths = graph.vertices.select("node", "strength").join(
        grouped.select("node", "label"), "node")
    totals = strengths.groupBy("label").agg(F.sum("strength").alias("total"))
    matched = F.col("l.label").eqNullSafe(F.col("r.label"))
    total = strengths.alias("l").join(totals.alias("r"), matched).select("l.node", "r.total")
    answer, level = None, 0
    while True:
        state = _move_all(graph, graph.vertices.join(total, "node").select("node", "salts", "strength", "total"))
        step = state.select(F.col("node").alias("at"), F.col("c").alias("higher"))
        if answer is None:
            placed = step.select(F.col("at").alias("node"), "higher", F.col("higher").alias("label"))
        else:
            placed = answer.join(step, "at").select("node", "higher", "label")
        sizes = aggregate_apart(
            placed, ["higher"], F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
        # The smallest member names a community, whatever node its label came from.
        fits = F.col("n") <= max_size
        keep = fits if level else F.lit(True)
        answer = cut_lineage(placed.join(sizes, "higher").select(
            "node", F.col("higher").alias("at"),
            F.when(keep, F.col("first")).otherwise(F.col("label")).alias("label"), fits.alias("fits")))
        after, small = answer.agg(
            F.count_distinct("at"), F.count(F.when(F.col("fits"), 1))).first()
        if after == graph.linked or not small:
            break  # nothing merged, or all communities are too large to name one
        total = state.groupBy(F.col("c").alias("node")).agg(F.first("total").alias("total"))
        merged = cut_lineage(_merge(graph, state))
        graph.close()
        graph, level = Arcs(merged, per_salt, sized=True, loops=True), level + 1
    graph.close()
    return answer.select("node", "label")


def _merge(graph: Arcs, state: DataFrame) -> DataFrame:
    """Edges between communities; a community's inner weight becomes its self-loop."""
    ends = state.select(F.col("node").alias("dst"), F.col("c").alias("to"))
    sent = graph.send(state.select("node", "salts", "c")).select("c", "dst", "weight")
    return (
        sent.join(ends, "dst").where(F.col("c") <= F.col("to"))
        .groupBy(F.col("c").alias("src"), F.col("to").alias("dst"))
        .agg(F.sum("weight").alias("weight"))
    )


def _move_all(graph: Arcs, start: DataFrame) -> DataFrame:
    """``start(node, salts, strength, total)`` with the community ``c`` of each node once the moves have converged."""
    if graph.split:  # the edges of a hub lie in several partitions, so its moves are decided by a query
        return _converged(graph.place(start.selectExpr(
            "*", "node AS c", "false AS want", "0D AS fit", "0 AS turn")), partial(_round, graph))
    blocks = Blocks(graph, start)
    state = graph.place(start.dropDuplicates(["node"]).join(blocks.settled(_converged), "node"))
    blocks.close()
    return state


def _converged(state: State, step: Callable[[State, int], tuple[State, int, float]],
               forget: Callable[..., None] = lambda *_: None) -> State:
    """Rounds of moves to convergence; the state of the best modularity seen.

    Moves made at once can undo each other's gain. Where a whole draw brought none, the search goes
    on from the best state with twice as many, smaller groups.
    """
    best, kept, turns, draws = None, state, 0, DRAWS
    while True:
        after, wanting, now = step(state, draws)  # figures of ``state``, before its moves
        turns = 0 if best is None or now > best + TOLERANCE else turns + 1
        if best is None or now > best:
            best, kept = now, state
        if not wanting:
            return kept
        if turns > draws:
            if draws == MOST_DRAWS:
                return kept
            turns, draws, after = 0, 2 * draws, kept
        state = after
        forget(kept, state)


def _round(graph: Arcs, state: DataFrame, draws: int) -> tuple[DataFrame, int, float]:
    """The state after a round of moves; how many nodes wanted to move, and the modularity before it."""
    seen = Observation()
    after = graph.place(_move(graph, state, draws).observe(
        seen, F.count(F.when(F.col("want"), 1)).alias("wanting"),
        (F.sum("fit") / F.sum("strength")).alias("modularity")))
    found = seen.get
    return after, found["wanting"], found["modularity"] or 0.0


def _move(graph: Arcs, state: DataFrame, draws: int) -> DataFrame:
    """One round of moves. ``want`` marks nodes that would gain by moving; ``fit`` is a node's part
    of the modularity before the moves."""
    sums = aggregate_apart(
        state, ["c"], F.expr("sum(strength) AS tot"), F.expr("count(1) AS n")).toDF("at", "tot", "n")
    # What a node needs to know of its own community comes along its loop, so the sums are joined
    # once. Outer, as that never broadcasts the state.
    told = state.select("node", "salts", "c").join(sums, F.expr("c = at"), "left")
    options = (
        graph.dealt(graph.send(told).selectExpr("dst", "c", "if(src = dst, 0D, weight) AS weight", "tot", "n"))
        .groupBy("dst", F.expr("c AS to"))
        .agg(F.expr("sum(weight) AS shared"), F.expr("first(tot) AS to_tot"), F.expr("first(n) AS to_n"))
    )
    # Grouped by node alone, as the join leaves the rows sorted: they are not sorted again.
    gain = "round(shared - strength / total * to_tot, 9)"
    judged = state.drop("want", "fit").join(options, F.expr("node = dst"), "left").groupBy("node").agg(
        *(F.expr(f"first({a}) AS {a}") for a in ("salts", "strength", "total", "c", "turn")),
        F.expr(f"min(if(to = c, null, struct(-{gain} AS loss, to, to_n))) AS best"),
        F.expr("max(if(to = c, struct(shared, to_tot AS tot, to_n AS n), null)) AS home"))
    stay = "round(home.shared - strength / total * (home.tot - strength), 9)"
    wants = f"coalesce(-best.loss > {stay} AND (best.to_n > 1 OR home.n > 1 OR best.to < c), false)"
    # In ``draws`` rounds each node has one turn, drawn anew each time.
    group = f"pmod(xxhash64(node, floor(turn / {draws})), {draws})"
    return judged.selectExpr(
        "node", "salts", "strength", "total",
        f"if({wants} AND {group} = turn % {draws}, best.to, c) AS c", f"{wants} AS want",
        "home.shared - strength / total * home.tot AS fit", "turn + 1 AS turn")
