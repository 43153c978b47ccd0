"""Hot keys: the joins and counts that must survive one key holding a third of all rows."""

import pytest
from pyspark.sql import functions as F

from muster.functions.ranking import aggregate_apart, distinct_apart
from muster.operators import graph, insights
from muster.operators.conditions import any_of, attribute, metric, network, related
from muster.operators.evaluate import flags
from muster.plans import retail as plans
from muster.session import cut_lineage

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
}


@pytest.fixture()
def skewed(spark):
    """One customer with a third of 60,000 orders; no side small enough to broadcast."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    n = F.col("id")
    customer = spark.range(900).select(
        n.alias("c_custkey"), F.concat(F.lit("c"), n).alias("c_name"), (n % 25).cast("int").alias("c_nationkey"),
        (n % 977 * 10.0 - 500).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    orders = spark.range(0, 60000, 1, 8).select(
        n.alias("o_orderkey"), F.when(n % 3 == 0, 7).otherwise(n % 900).alias("o_custkey"),
        F.lit("F").alias("o_orderstatus"), (n % 1000 * 1.0).alias("o_totalprice"),
        F.to_date(F.lit("2001-01-01")).alias("o_orderdate"),
        F.when(n % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("o_orderpriority"))
    events = spark.range(3000).select(
        n.alias("event_id"), (n % 450).alias("user_id"), F.lit("click").alias("event_type"),
        F.lit(1.0).alias("value"), F.to_date(F.lit("2024-01-05")).alias("event_date"))
    edges = spark.range(1, 900).select(
        F.lit(0).cast("long").alias("src"), n.alias("dst"), F.lit(1).alias("purchases"), F.lit(1.0).alias("quantity"))
    made = {"customer": customer, "orders": orders, "events": events, "co_purchase": edges}
    tables = {k: cut_lineage(v) for k, v in made.items()}
    small = plans.read(spark, "/root/testdata/sf0.001")
    yield plans.catalog(spark, "", {**small, **tables})
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    done = df.agg(*(F.max(F.col(c).cast("string")) for c in df.columns))
    done.collect()
    return done._jdf.queryExecution().executedPlan().toString()


def test_hot_parent_is_split(skewed):
    rules = {"clicked": attribute("event.type", "eq", "click"), "poor": attribute("customer.balance", "lt", 0)}
    found = flags(skewed, "order", rules)
    assert "skew=true" in final_plan(found)
    counted = found.agg(F.count(F.when(F.col("clicked"), 1)), F.count(F.lit(1))).first()
    expected = skewed.tables["orders"].where("o_custkey < 450").count()
    assert tuple(counted) == (expected, 60000)


def test_hot_anchor_is_combined_before_the_shuffle(skewed):
    rule = any_of(metric("order_count", "gt", 10000), related("order", attribute("order.priority", "eq", "5-LOW"), n=9000))
    found = flags(skewed, "customer", {"hot": rule}).where("hot").collect()
    assert [r.c_custkey for r in found] == [7]


def test_group_sums_joined_back_are_split(skewed):
    rows = skewed.tables["orders"].select("o_orderkey", "o_custkey", (F.col("o_totalprice") > 500).alias("flag"))
    rated = graph.leave_one_out_rate(rows, "o_custkey", "flag", "size", "rate")
    assert "skew=true" in final_plan(rated)
    assert rated.where("o_custkey = 7").select("size").first()[0] == rows.where("o_custkey = 7").count()


def test_aggregate_apart_equals_group_by(skewed):
    orders = skewed.tables["orders"]
    keys = ["o_custkey", "o_orderpriority"]
    one = aggregate_apart(orders, keys, F.count(F.lit(1)).alias("n")).collect()
    two = orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(one) == sorted(two)
    assert sorted(distinct_apart(orders.select(*keys)).collect()) == sorted(orders.select(*keys).distinct().collect())


def test_hub_of_a_network(skewed):
    found = flags(skewed, "customer", {
        "hub": network("co_purchase", op="gte", n=800), "near": network("co_purchase", op="eq", n=1)})
    sums = found.agg(F.count(F.when(F.col("hub"), 1)), F.count(F.when(F.col("near"), 1))).first()
    assert tuple(sums) == (1, 899)
    pairs = graph.undirected(skewed.tables["co_purchase"], skewed.tables["customer"], "c_custkey")
    ranks = [dict(graph.pagerank(skewed.tables["customer"], "c_custkey", pairs, rounds=4, tol=0,
                                 per_salt=s).collect()) for s in (10, 10 ** 6)]
    assert ranks[0] == pytest.approx(ranks[1])


def test_lines_are_shuffled_by_order_once_for_shared_purchases(skewed, spark):
    t = plans.read(spark, "/root/testdata/sf0.001")
    found = plans.co_purchase(t["orders"], t["lineitem"])
    assert "ReusedExchange" in final_plan(found)
    blank = t["orders"].withColumn("o_custkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")))
    lines = t["lineitem"].withColumn("l_quantity", F.when(F.col("l_linenumber") > 1, F.col("l_quantity")))
    known = plans.co_purchase(blank.where("o_custkey is not null"), lines).collect()
    assert known and sorted(known, key=str) == sorted(plans.co_purchase(blank, lines).collect(), key=str)


def test_rows_reached_once_bring_their_attributes(skewed):
    some = skewed.tables["customer"].where("c_custkey < 300").select("c_custkey")
    found = insights.related_rows(skewed, "customer", some, "order")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("o_orderkey" in line for line in plan.splitlines() if "Relation" in line) == 1
    assert found.where("__key = 7").count() == 24


def test_equal_lines_count_once(spark):
    t = plans.read(spark, "/root/testdata/sf0.001")
    once = plans.catalog(spark, "", t)
    twice = plans.catalog(spark, "", {**t, "lineitem": t["lineitem"].union(t["lineitem"])})
    some = t["customer"].select("c_custkey")
    one, two = (insights.related_rows(c, "customer", some, "line", k=5) for c in (once, twice))
    assert sorted(one.collect(), key=str) == sorted(two.select(one.columns).collect(), key=str)
    assert distinct_apart(one).count() == one.count()
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Window"):].count("Aggregate") == 1  # of the wanted keys
