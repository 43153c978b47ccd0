"""The feature job: influence, communities and households, refreshed in one run."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.operators import graph
from muster.operators.communities import communities
from muster.session import cut_lineage


class Features(NamedTuple):
    lines: DataFrame
    customers: DataFrame
    summary: DataFrame


def refresh_features(lines: DataFrame, line_key: str, churned: str, calls: DataFrame, weight: str,
                     customers: DataFrame, customer_key: str, close_links: DataFrame,
                     rounds: int = graph.MAX_ROUNDS, tol: float = graph.TOLERANCE) -> Features:
    """Columns for both anchors and their summary, from one build of the call graph.

    ``lines`` has a Boolean ``churned``; ``calls(src, dst, weight)`` may hold both directions;
    ``close_links(src, dst)`` are the links that make a household. Lines get ``influence_score``,
    ``community_id``, ``community_size`` and ``community_churn_rate``, customers ``household_size``.
    """
    pairs = cut_lineage(graph.undirected(calls, lines, line_key, weight))
    ranks = graph.pagerank(lines, line_key, pairs, rounds=rounds, tol=tol)
    score = graph.rank_percentile(ranks, "rank", "node").select("node", "influence_score")
    found = communities(lines, line_key, pairs).withColumnRenamed("community", "community_id")
    status = graph.with_features(lines.select(line_key, churned), line_key, found, "node")
    rated = graph.leave_one_out_rate(status, "community_id", churned, "community_size", "community_churn_rate")
    of_lines = cut_lineage(graph.with_features(rated.drop(churned), line_key, score, "node"))
    homes = graph.group_size(
        graph.connected_components(customers, customer_key, close_links), "component", "household_size")
    of_customers = cut_lineage(homes.select(F.col("node").alias(customer_key), "household_size"))
    return Features(of_lines, of_customers, graph.feature_summary(of_lines, of_customers))
