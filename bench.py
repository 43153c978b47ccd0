"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from muster.plans.queries import QUERIES  # noqa: E402
from muster.session import local_session  # noqa: E402

HEADLINE = [
    "lookup_region", "exists_order", "metric_fused", "metric_sum", "related_count", "network_count",
    "network_nested_rule", "churn_contagion", "preview_counts", "members_page", "holdout_split",
    "materialize_members", "materialize_chain", "profile_long", "kpi_lift", "funnel_and",
    "trend_monthly", "overlap_matrix", "drivers", "member_360_counts", "undirected_edges",
    "pagerank_10", "influence_percentile", "household_components", "leave_one_out", "expand_topk",
    "link_merge", "link_log", "upsert_latest", "load_edges", "last3_avg",
    "communities_of_blocks", "features_refreshed", "purchase_components", "features_written_back", "link_star",
    "pagerank_settled",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "16g"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()  # starts the executors
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": cores, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "driver_memory": spark.sparkContext.getConf().get("spark.driver.memory"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
