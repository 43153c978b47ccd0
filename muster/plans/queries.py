"""The registered queries: every operator run over the whole retail tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.columns import bucket, fnv1a32, value_text
from muster.model import Attribute, Catalog, Entity, Hop, Metric
from muster.operators import derived, graph, insights, links, segments
from muster.operators.communities import communities, number_communities
from muster.operators.conditions import (
    Condition,
    all_of,
    any_of,
    attribute,
    edge,
    in_segment,
    metric,
    network,
    related,
)
from muster.operators.evaluate import Scope, flags, matching
from muster.operators.features import Features, refresh_features
from muster.operators.paths import both_directions
from muster.operators.segments import Segment
from muster.plans import retail
from muster.session import cut_lineage, work_path
from muster.sources import tables
from muster.sources.memberships import MembershipStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_catalogs: dict[tuple[str, str], Catalog] = {}


def load(spark: SparkSession, folder: str) -> Catalog:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _catalogs:
        _catalogs[key] = retail.catalog(spark, folder)
    return _catalogs[key]


def with_activity(spark: SparkSession, folder: str) -> Catalog:
    """The catalog with a nullable customer column: the date of the last event."""
    key = (spark.sparkContext.applicationId, folder + "#activity")
    if key not in _catalogs:
        t = dict(load(spark, folder).tables)
        t["customer"] = retail.last_event(t["customer"], t["events"])
        _catalogs[key] = retail.catalog(
            spark, folder, t, (Attribute("last_event", "date", "last_event_date"),))
    return _catalogs[key]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def audience(name: str, rule: Condition, anchor: str = "customer", catalog=load, as_of=None) -> None:
    """Register the members of one rule."""
    QUERIES[name] = lambda spark, folder: matching(catalog(spark, folder), anchor, rule, as_of)


def flagged(name: str, rules: dict[str, Condition], anchor: str = "customer", catalog=load,
            as_of=None) -> None:
    """Register several rules as flags of every anchor."""
    QUERIES[name] = lambda spark, folder: flags(catalog(spark, folder), anchor, rules, as_of)


# ---- attribute predicates -----------------------------------------------------------
flagged("attr_eq", {
    "number": attribute("order.key", "eq", "77"),
    "text": attribute("customer.name", "eq", "Customer#000000011"),
    "choice": attribute("order.status", "eq", "F"),
    "day": attribute("order.date", "eq", "1998-10-03T00:00:00"),
}, "order")
flagged("attr_neq", {
    "number": attribute("customer.balance", "neq", 0),
    "text": attribute("customer.name", "neq", "Customer#000000011"),
    "choice": attribute("customer.market", "neq", "BUILDING"),
})
flagged("attr_range", {
    "above": attribute("order.price", "gt", 250000), "from": attribute("order.price", "gte", "250000"),
    "below": attribute("order.price", "lt", 250000.5), "to": attribute("order.price", "lte", 250000),
    "after": attribute("order.date", "gt", "1998-10-03"),
    "since": attribute("order.date", "gte", "1998-10-03"),
    "before": attribute("order.date", "lt", "1998-10-03"),
    "until": attribute("order.date", "lte", "1998-10-03"),
}, "order")
flagged("attr_between", {
    "number": attribute("order.price", "between", [100000, 200000]),
    "day": attribute("order.date", "between", ["1997-01-01", "1997-12-31"]),
}, "order")
flagged("attr_in", {
    "number": attribute("customer.key", "in", [3, "5", 8, 13]),
    "text": attribute("customer.name", "in", ["Customer#000000001", "Customer#000000002"]),
    "choice": attribute("customer.market", "in", ["BUILDING", "MACHINERY"]),
})
flagged("attr_not_in", {
    "number": attribute("customer.key", "not_in", [3, "5", 8, 13]),
    "choice": attribute("customer.market", "not_in", ["BUILDING", "MACHINERY"]),
})
flagged("attr_contains", {
    "own": attribute("customer.name", "contains", "R#0000001"),
    "wild": attribute("customer.name", "contains", "%"),
    "far": attribute("part.name", "contains", "RED"),
})
flagged("attr_starts", {
    "own": attribute("customer.name", "starts_with", "CUSTOMER#00000"),
    "far": attribute("part.name", "starts_with", "small r"),
})
flagged("attr_ends", {
    "own": attribute("customer.name", "ends_with", "7"),
    "far": ~attribute("part.name", "ends_with", "RING"),
})
flagged("attr_null", {
    "unset": attribute("customer.last_event", "is_null"),
    "set": attribute("customer.last_event", "is_not_null"),
    "late": attribute("customer.last_event", "gt", "2024-01-20"),
    "not_late": ~attribute("customer.last_event", "gt", "2024-01-20"),
    "late_or_unset": any_of(attribute("customer.last_event", "gt", "2024-01-20"),
                            attribute("customer.last_event", "is_null")),
    "region_unset": attribute("region.name", "is_null"),
    "event_unset": attribute("event.type", "is_null"),
}, catalog=with_activity, as_of=retail.EVENT_AS_OF)
flagged("attr_within_days", {
    "own": attribute("order.date", "within_last_days", 90),
    "same_day": attribute("order.date", "within_last_days", 0),
    "far": attribute("line.shipped", "within_last_days", 30),
}, "order")
flagged("attr_before_days", {
    "own": attribute("customer.last_event", "before_last_days", 2),
    "not_own": ~attribute("customer.last_event", "before_last_days", 2),
    "far": attribute("event.date", "before_last_days", 28),
}, catalog=with_activity, as_of=retail.EVENT_AS_OF)

# ---- path conditions ----------------------------------------------------------------
audience("lookup_region", all_of(attribute("region.name", "eq", "EUROPE"),
                                 attribute("customer.balance", "gt", 5000)))
audience("lookup_chain", all_of(attribute("region.name", "in", ["ASIA", "AFRICA"]),
                                attribute("customer.market", "eq", "BUILDING"),
                                attribute("order.price", "gte", 400000)), "order")
flagged("exists_order", {
    "urgent": attribute("order.priority", "eq", "1-URGENT"),
    "some_not_urgent": attribute("order.priority", "neq", "1-URGENT"),
    "promo_part": attribute("part.type", "eq", "PROMO"),
    "poor_supplier": attribute("supplier.balance", "lt", 0),
})
flagged("not_exists_order", {
    "no_urgent": ~attribute("order.priority", "eq", "1-URGENT"),
    "no_large_part": ~attribute("part.size", "gt", 45),
    "no_click": ~attribute("event.type", "eq", "click"),
})
flagged("exists_through_parent", {
    "clicked": attribute("event.type", "eq", "click"),
    "quiet": related("event", op="eq", n=0),
    "busy": related("event", attribute("event.value", "gte", 25), n=3),
}, "order")


@query
def first_value_projection(spark, folder):
    scope = Scope(load(spark, folder), "customer")
    fields = {"region": "region.name", "first_order_status": "order.status",
              "first_order_date": "order.date", "first_part_brand": "part.brand",
              "first_event_type": "event.type"}
    made = [scope.field(f).alias(n) for n, f in fields.items()]
    return scope.table().select("c_custkey", *made)


# ---- metrics ------------------------------------------------------------------------
flagged("metric_sum", {
    "two_years": metric("total_spend", "gt", 500000, 24),
    "default_window": metric("total_spend", "gt", 500000),
    "lines": metric("shipped_quantity", "gte", 60, 6),
})
flagged("metric_avg", {
    "orders": metric("avg_order", "gte", 250000, 12),
    "lines": metric("avg_line_price", "between", [40000, 60000], 6),
})
flagged("metric_min", {"orders": metric("smallest_order", "lt", 100000, 12)})
flagged("metric_max", {"orders": metric("largest_order", "gt", 400000, 12),
                       "none": metric("largest_order", "eq", 0, 1)})
flagged("metric_count", {
    "orders": metric("recent_orders", "gte", 2, 12),
    "parts_as_bag": metric("part_count", "gt", 40),
    "events": metric("event_count", "neq", 0, 1),
})
flagged("metric_untimed", {"orders": metric("order_count", "lte", 8),
                           "lines": metric("line_count", "between", [30, 40])})
flagged("metric_missing_is_zero", {
    "low_average": metric("avg_event_value", "lt", 20, 1),
    "no_events": metric("event_count", "eq", 0, 1),
    "low_spend": metric("total_spend", "lte", 100, 1),
})


@query
def metric_fused(spark, folder):
    scope = Scope(load(spark, folder), "customer")
    wanted = {"spend_3": ("total_spend", 3), "spend_12": ("total_spend", 12),
              "spend_36": ("total_spend", 36), "average_12": ("avg_order", 12),
              "largest_12": ("largest_order", 12), "orders": ("order_count", None)}
    made = [F.round(scope.metric(m, w), 6).alias(n) for n, (m, w) in wanted.items()]
    return scope.table().select("c_custkey", *made)


@query
def usage_columns(spark, folder):
    """Metrics written back as customer columns, then used like any other attribute."""
    c = load(spark, folder)
    scope = Scope(c, "customer")
    spent = scope.metric("total_spend", 12).alias("spend_12")
    features = scope.table().select(F.col("c_custkey").alias("key"), spent)
    t = dict(c.tables)
    t["customer"] = graph.with_features(t["customer"], "c_custkey", features, "key")
    wide = retail.catalog(spark, folder, t, (Attribute("spend_12", "number"),))
    return matching(wide, "customer", attribute("customer.spend_12", "gte", 600000), c.as_of)


# ---- counts of related rows and neighbours --------------------------------------------
flagged("related_count", {
    "urgent_orders": related("order", attribute("order.priority", "eq", "1-URGENT"), "gte", 3),
    "distinct_promo_parts": related("part", attribute("part.type", "eq", "PROMO"), "gte", 8),
    "eight_or_more_lines": related("line", attribute("line.flag", "eq", "R"), "gt", 8),
    "suppliers": related("supplier", any_of(attribute("supplier.balance", "lt", 0),
                                            attribute("supplier.balance", "gt", 9000)), "neq", 4),
    "in_asia": related("region", attribute("region.name", "eq", "ASIA"), "eq", 1),
    "any_number": related("event", op="gte", n=0),
})
flagged("related_none", {
    "no_events": related("event", op="eq", n=0),
    "no_promo": related("part", attribute("part.type", "eq", "PROMO"), "lt", 1),
    "some_event": related("event", op="gt", n=0),
    "not_any_order": ~related("order"),
})
flagged("related_lt", {
    "few_urgent": related("order", attribute("order.priority", "eq", "1-URGENT"), "lt", 2),
    "few_parts": related("part", None, "lte", 30),
})
flagged("network_count", {
    "poor_friends": network("co_purchase", attribute("customer.balance", "lt", 0), op="gte", n=2),
    "popular": network("co_purchase", op="gte", n=20),
    "linked": network("account_links"),
    "alone": network("account_links", op="eq", n=0),
})
flagged("network_edge_filter", {
    "large_shared": network("co_purchase", edge_where=(edge("quantity", "gte", 40),), op="gte", n=4),
    "close": network("co_purchase", edge_where=(edge("purchases", "gt", 1),)),
    "household": network("account_links", edge_where=(
        edge("link_type", "in", ["Household", "Family"]),)),
})
flagged("network_nested_rule", {
    "europeans": network("co_purchase", attribute("region.name", "eq", "EUROPE"), op="gte", n=3),
    "urgent_relatives": network(
        "account_links", related("order", attribute("order.priority", "eq", "1-URGENT"), n=2),
        (edge("link_type", "neq", "Corporate"),)),
    "spending_friends": network("co_purchase", metric("total_spend", "gt", 800000, 24), op="gte", n=3),
})
flagged("network_nested_network", {
    "friends_of_poor": network(
        "co_purchase", any_of(network("co_purchase", attribute("customer.balance", "lt", -500), n=2),
                              attribute("customer.balance", "gt", 9800)),
        (edge("quantity", "between", [10, 45]),), "gte", 3),
})


@query
def path_both_ways(spark, folder):
    """An entity behind an edge list read in either direction: linked accounts."""
    c = load(spark, folder)
    relative = Entity("relative", "customer", "c_custkey", (
        Attribute("balance", "number", "c_acctbal"), Attribute("market", "enum", "c_mktsegment")), {
        "customer": (Hop("account_links", "c_custkey", "src", many=True, both_ways=True),
                     Hop("customer", "dst", "c_custkey"))})
    wealth = Metric("relatives_balance", "relative", "sum", "c_acctbal")
    wide = replace(c, entities=(*c.entities, relative), metrics=(*c.metrics, wealth))
    return flags(wide, "customer", {
        "rich_relative": attribute("relative.balance", "gt", 9000),
        "two_in_building": related("relative", attribute("relative.market", "eq", "BUILDING"), n=2),
        "family_wealth": metric("relatives_balance", "gt", 10000)})


@query
def network_directions(spark, folder):
    """The same edges followed only forwards or only backwards."""
    c = load(spark, folder)
    made = [replace(c.network("co_purchase"), name=d, direction=d) for d in ("out", "in")]
    wide = replace(c, networks=tuple(made), link_network="")
    return flags(wide, "customer", {
        "leads_six": network("out", op="gte", n=6), "follows_six": network("in", op="gte", n=6),
        "leads_poor": network("out", attribute("customer.balance", "lt", 0)),
        "follows_poor": network("in", attribute("customer.balance", "lt", 0))})


# ---- Boolean composition ----------------------------------------------------------------
flagged("bool_or_not", {
    "either": any_of(attribute("customer.market", "eq", "BUILDING"), metric("order_count", "gt", 12)),
    "neither": ~any_of(attribute("customer.market", "eq", "BUILDING"), metric("order_count", "gt", 12)),
    "mixed": all_of(~attribute("region.name", "eq", "ASIA"),
                    any_of(related("event"), attribute("part.size", "gt", 49))),
})
flagged("empty_rule", {"everyone": all_of(), "nobody": ~all_of(), "also_everyone": any_of()})

RICH = attribute("customer.balance", "gt", 7000)
EUROPE = attribute("region.name", "eq", "EUROPE")
BIG_SPENDER = metric("total_spend", "gt", 500000, 24)
BASE_SEGMENTS = (
    Segment("rich", "customer", RICH, 10),
    Segment("europe", "customer", EUROPE),
    Segment("spenders", "customer", BIG_SPENDER, 25),
    Segment("nobody", "customer", attribute("customer.balance", "gt", 10 ** 9), 10),
    Segment("big_orders", "order", attribute("order.price", "gt", 400000), 12.34),
)
CHAIN_SEGMENTS = (
    *BASE_SEGMENTS,
    Segment("rich_europe", "customer", all_of(in_segment("rich"), in_segment("europe"))),
    Segment("rich_not_europe", "customer", all_of(in_segment("rich"), ~in_segment("rich_europe")), 20),
)


def built(spark: SparkSession, folder: str, wanted=BASE_SEGMENTS) -> MembershipStore:
    store = MembershipStore(spark, work_path(spark, "segments"))
    segments.materialize_all(load(spark, folder), wanted, store)
    return store


@query
def segment_reuse(spark, folder):
    store = built(spark, folder)
    rules = {"rich_spender": all_of(in_segment("rich"), in_segment("spenders")),
             "only_rich": all_of(in_segment("rich"), ~in_segment("spenders")),
             "never_built": in_segment("unknown")}
    known = store.read("customer", ["rich", "spenders"])
    return flags(load(spark, folder), "customer", rules, memberships=known)


# ---- segment jobs -----------------------------------------------------------------------
FLAGSHIP = all_of(
    attribute("customer.balance", "gte", 0),
    metric("total_spend", "gt", 500000, 24),
    related("order", attribute("order.priority", "eq", "1-URGENT")),
    network("co_purchase", attribute("customer.balance", "lt", 0), op="gte", n=2),
)
audience("churn_contagion", FLAGSHIP)


@query
def preview_counts(spark, folder):
    return segments.counts(load(spark, folder), "customer", FLAGSHIP)


@query
def preview_sample(spark, folder):
    sample = segments.preview(load(spark, folder), "customer", EUROPE, 25).sample
    return sample.toDF(*(c.replace(".", "_") for c in sample.columns))


@query
def members_page(spark, folder):
    page = segments.members(load(spark, folder), Segment("big", "order", all_of(
        attribute("order.price", "gt", 400000), attribute("region.name", "eq", "ASIA"))),
        fields=["order.key", "customer.name", "nation.name", "order.date"], limit=100, skip=50)
    return page.toDF(*(c.replace(".", "_") for c in page.columns))


@query
def members_of_group(spark, folder):
    store = built(spark, folder, BASE_SEGMENTS[:1])
    page = segments.members(load(spark, folder), BASE_SEGMENTS[0], store,
                            ["customer.key", "customer.market"], limit=None, group="control")
    return page.toDF(*(c.replace(".", "_") for c in page.columns))


@query
def holdout_split(spark, folder):
    everyone = load(spark, folder).tables["orders"].select("o_orderkey")
    hashed = everyone.withColumn("hash", fnv1a32(F.concat(F.lit("abc123:"), F.col("o_orderkey"))))
    return segments.assign_holdout(hashed, "o_orderkey", "abc123", 12.5)


@query
def holdout_counts(spark, folder):
    """Target and control counts as the bookkeeping of a built audience of all orders has them."""
    store = built(spark, folder, [Segment("abc123", "order", all_of(), 12.5)])
    state = spark.read.parquet(f"{store.path}/state")
    each = F.array(F.struct(F.lit("target").alias("group"), F.col("target_count").alias("members")),
                   F.struct(F.lit("control").alias("group"), F.col("control_count").alias("members")))
    return state.select(F.inline(each))


@query
def materialize_members(spark, folder):
    store = built(spark, folder)
    return store.read("customer", ["rich", "europe", "spenders", "nobody"]).unionByName(
        store.read("order", ["big_orders"]))


@query
def materialize_chain(spark, folder):
    store = built(spark, folder, CHAIN_SEGMENTS)
    return store.read("customer", [s.segment_id for s in CHAIN_SEGMENTS if s.anchor == "customer"])


@query
def materialize_state(spark, folder):
    store = built(spark, folder, CHAIN_SEGMENTS)
    state = spark.read.parquet(f"{store.path}/state")
    return state.select("segment_id", "anchor", "version", "holdout_pct",
                        F.col("as_of").cast("string").alias("as_of"), "member_count",
                        "target_count", "control_count")


@query
def export_members(spark, folder):
    store = built(spark, folder, BASE_SEGMENTS[:1])
    path = work_path(spark, "export")
    segments.export_csv(load(spark, folder), BASE_SEGMENTS[0], path, store,
                        ["customer.key", "customer.name", "region.name"])
    out = spark.read.option("header", True).csv(path)
    return out.toDF(*(c.replace(".", "_") for c in out.columns)).withColumn(
        "customer_key", F.col("customer_key").cast("long"))


# ---- insight jobs -------------------------------------------------------------------------
def rows_of(breakdown: DataFrame) -> DataFrame:
    return breakdown.select("field", "value", "segment", "base",
                            F.round("segment_pct", 9).alias("segment_pct"),
                            F.round("base_pct", 9).alias("base_pct"), "index", "multi_valued",
                            "position")


@query
def breakdown_bucket(spark, folder):
    c = load(spark, folder)
    return rows_of(insights.breakdown(c, "customer", BIG_SPENDER, ["customer.balance"]))


@query
def breakdown_enum(spark, folder):
    return rows_of(insights.breakdown(
        load(spark, folder), "customer", BIG_SPENDER, ["customer.market", "region.name"]))


@query
def breakdown_multi(spark, folder):
    return rows_of(insights.breakdown(
        load(spark, folder), "customer", EUROPE, ["part.size", "event.type", "order.status"]))


@query
def breakdown_top(spark, folder):
    """A text field and a date: the 60 most frequent values each."""
    return rows_of(insights.breakdown(
        load(spark, folder), "order", attribute("order.price", "gt", 400000),
        ["order.date", "customer.name"]))


@query
def bucket_labels(spark, folder):
    c = load(spark, folder)
    size = c.entity("part").attribute("size")
    day = c.entity("order").attribute("date")
    parts = c.tables["part"].select(value_text(F.col("p_size"), size).alias("label"))
    price = c.tables["part"].select(bucket(F.col("p_retailprice"), (900.5, 950, 1000)).alias("label"))
    days = c.tables["orders"].select(value_text(F.col("o_orderdate"), day).alias("label"))
    return parts.unionByName(price).unionByName(days).groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"))


@query
def profile_long(spark, folder):
    return rows_of(insights.profile(load(spark, folder), "customer", FLAGSHIP).dimensions)


@query
def profile_counts(spark, folder):
    return insights.profile(load(spark, folder), "customer", FLAGSHIP).counts


@query
def profile_kpis(spark, folder):
    found = insights.profile(load(spark, folder), "customer", all_of(EUROPE, BIG_SPENDER)).kpis
    return found.select("kpi", *(F.round(c, 4).alias(c) for c in ("segment", "base", "lift")))


@query
def kpi_lift(spark, folder):
    found = insights.kpis(load(spark, folder), "customer", all_of(EUROPE, BIG_SPENDER))
    return found.select("kpi", *(F.round(c, 4).alias(c) for c in ("segment", "base", "lift")))


@query
def kpi_orders(spark, folder):
    found = insights.kpis(load(spark, folder), "order", attribute("event.type", "eq", "click"))
    return found.select("kpi", *(F.round(c, 4).alias(c) for c in ("segment", "base", "lift")))


@query
def funnel_and(spark, folder):
    return insights.funnel(load(spark, folder), "customer", FLAGSHIP)


@query
def funnel_or(spark, folder):
    return insights.funnel(load(spark, folder), "customer", any_of(
        EUROPE, BIG_SPENDER, attribute("event.type", "eq", "click"), ~related("order", op="gte", n=8)))


@query
def funnel_negated(spark, folder):
    return insights.funnel(load(spark, folder), "customer", ~all_of(EUROPE, BIG_SPENDER))


@query
def funnel_delta(spark, folder):
    return insights.funnel(load(spark, folder), "customer", FLAGSHIP, delta=True)


@query
def trend_monthly(spark, folder):
    found = insights.trend(load(spark, folder), "customer", "shipped_quantity", EUROPE, 12)
    return found.select("month", F.round("segment", 6).alias("segment"),
                        F.round("base", 6).alias("base"), "segment_n", "base_n")


@query
def trend_counts(spark, folder):
    found = insights.trend(load(spark, folder), "order", "event_count",
                           attribute("order.status", "eq", "F"), 6)
    return found.select("month", F.round("segment", 6).alias("segment"),
                        F.round("base", 6).alias("base"), "segment_n", "base_n")


@query
def overlap_matrix(spark, folder):
    store = built(spark, folder, CHAIN_SEGMENTS)
    found = insights.overlap_of_built(store, [s.segment_id for s in CHAIN_SEGMENTS])
    return found.select("a", "b", "common", F.round("jaccard", 9).alias("jaccard"),
                        F.round("containment", 9).alias("containment"))


#: Ids that look like numbers, and an audience without members.
NUMBERED = [Segment("007", "customer", attribute("customer.balance", "gte", 0)),
            Segment("12", "customer", attribute("customer.market", "eq", "BUILDING")),
            Segment("none", "order", attribute("order.price", "gt", 10 ** 9))]


@query
def overlap_reopened(spark, folder):
    """Overlap read from a store that was closed in between."""
    again = MembershipStore(spark, built(spark, folder, NUMBERED).path)
    found = insights.overlap_of_built(again, [s.segment_id for s in NUMBERED])
    return found.select("a", "b", "common", F.round("jaccard", 9).alias("jaccard"),
                        F.round("containment", 9).alias("containment"))


@query
def metric_of_parent(spark, folder):
    """Metrics of the one customer of an order: a sum, and a windowed count by a date."""
    c = load(spark, folder)
    active = with_activity(spark, folder)
    made = replace(active, metrics=(
        *active.metrics, Metric("owner_balance", "customer", "sum", "c_acctbal"),
        Metric("owner_active", "customer", "count", "", "last_event_date", 1, retail.EVENT_AS_OF)))
    return matching(made, "order", all_of(metric("owner_balance", "gt", 0), metric("owner_active", "eq", 1)), c.as_of)


@query
def trend_of_parent(spark, folder):
    """Per month of its customer's last event, the balance behind an order."""
    active = with_activity(spark, folder)
    made = replace(active, metrics=(
        *active.metrics, Metric("owner_balance", "customer", "sum", "c_acctbal", "last_event_date", 1, retail.EVENT_AS_OF)))
    found = insights.trend(made, "order", "owner_balance", attribute("order.status", "eq", "F"), 6)
    return found.select("month", F.round("segment", 4).alias("segment"), F.round("base", 4).alias("base"),
                        "segment_n", "base_n")


@query
def lookup_duplicates(spark, folder):
    """Every nation twice, once under another name: an anchor is still one row."""
    t = dict(load(spark, folder).tables)
    renamed = t["nation"].withColumn("n_name", F.concat(F.lit("~"), "n_name"))
    t["nation"] = t["nation"].unionByName(renamed)
    made = retail.catalog(spark, folder, t)
    return flags(made, "customer", {"east": attribute("region.name", "eq", "ASIA")},
                 fields={"nation": "nation.name"})


@query
def drivers(spark, folder):
    found = insights.rule_drivers(load(spark, folder), "customer", all_of(
        EUROPE, attribute("customer.balance", "gt", 5000)))
    return found.select("direction", "rank", "field", "value", "index",
                        F.round("strength", 6).alias("strength"))


@query
def member_360_counts(spark, folder):
    c = load(spark, folder)
    store = built(spark, folder, BASE_SEGMENTS[:3])
    known = store.read("customer", ["rich", "europe", "spenders"])
    view = insights.member_360(c, "customer", matching(c, "customer", RICH), known)
    sizes = [F.coalesce(F.size(n), F.lit(0)).alias(f"n_{n}")
             for n in ("order", "line", "part", "supplier", "event", "co_purchase", "account_links")]
    return view.select(
        "c_custkey", F.col("own.c_name").alias("name"),
        F.element_at("region", 1)["r_name"].alias("region"), *sizes,
        F.try_element_at("order", F.lit(1))["o_orderkey"].alias("latest_order"),
        F.try_element_at("order", F.lit(24))["o_orderkey"].alias("order_24"),
        F.try_element_at("event", F.lit(1))["event_id"].alias("latest_event"),
        F.try_element_at("co_purchase", F.lit(1))["dst"].alias("closest"),
        F.array_join("segments", ",").alias("segments"))


@query
def field_values(spark, folder):
    return insights.field_values(load(spark, folder), "part.name", "RE")


# ---- graph jobs -----------------------------------------------------------------------------
def purchase_pairs(c: Catalog) -> DataFrame:
    return graph.undirected(c.tables["co_purchase"], c.tables["customer"], "c_custkey", "quantity")


def ranks(c: Catalog, rounds: int = 10, tol: float = 0.0) -> DataFrame:
    return graph.pagerank(c.tables["customer"], "c_custkey", purchase_pairs(c), rounds=rounds, tol=tol)


@query
def undirected_edges(spark, folder):
    return purchase_pairs(load(spark, folder))


@query
def pagerank_10(spark, folder):
    return ranks(load(spark, folder)).select("node", F.round("rank", 10).alias("rank"))


@query
def influence_percentile(spark, folder):
    return graph.rank_percentile(ranks(load(spark, folder)), "rank", "node").select(
        "node", "influence_score")


HOUSEHOLD_TYPES = ("Household", "Family")


def households(c: Catalog) -> DataFrame:
    close = c.tables["account_links"].where(F.col("link_type").isin(*HOUSEHOLD_TYPES))
    found = graph.connected_components(c.tables["customer"], "c_custkey", close)
    return graph.group_size(found, "component", "household_size")


@query
def household_components(spark, folder):
    return households(load(spark, folder)).select("node", "component", "household_size")


@query
def purchase_components(spark, folder):
    c = load(spark, folder)
    return graph.connected_components(c.tables["customer"], "c_custkey", c.tables["co_purchase"])


@query
def leave_one_out(spark, folder):
    churned = load(spark, folder).tables["customer"].select(
        "c_custkey", "c_nationkey", (F.col("c_acctbal") < 0).alias("churned"))
    return graph.leave_one_out_rate(churned, "c_nationkey", "churned", "nation_size", "churn_rate")


@query
def features_written_back(spark, folder):
    c = load(spark, folder)
    found = households(c).select("node", "household_size")
    t = dict(c.tables)
    t["customer"] = graph.with_features(t["customer"], "c_custkey", found, "node")
    wide = retail.catalog(spark, folder, t, (
        Attribute("household_size", "number", buckets=(2, 3, 4)),))
    rule = all_of(attribute("customer.household_size", "gte", 2), related("order", n=1))
    return matching(wide, "customer", rule, c.as_of, fields={"household_size": "customer.household_size"})


_found: dict[tuple[str, str, str], DataFrame | Features] = {}


def buyer_communities(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of the purchase graph, written once per session for the queries that build on them."""
    key = ("buyers", spark.sparkContext.applicationId, folder)
    if key not in _found:
        c = load(spark, folder)
        _found[key] = cut_lineage(communities(c.tables["customer"], "c_custkey", purchase_pairs(c)))
    return _found[key]


@query
def communities_of_buyers(spark, folder):
    return buyer_communities(spark, folder)


@query
def community_stats(spark, folder):
    """Per buyer: community, its size, and the churn rate of its other members."""
    c = load(spark, folder)
    found = buyer_communities(spark, folder)
    churned = c.tables["customer"].select("c_custkey", (F.col("c_acctbal") < 0).alias("churned"))
    rows = graph.with_features(churned, "c_custkey", found, "node")
    return graph.leave_one_out_rate(rows, "community", "churned", "community_size",
                                    "community_churn_rate")


@query
def number_components(spark, folder):
    """Numbers 1..k and sizes of the household groups."""
    found = number_communities(households(load(spark, folder)).select("node", F.col("component").alias("label")))
    return graph.group_size(found, "community", "community_size").select("node", "community", "community_size")


BLOCK = 25


def block_calls(c: Catalog) -> DataFrame:
    """A graph whose communities are known: stars of 25 customers each, weakly joined in a row."""
    block = F.floor(F.col("c_custkey") / BLOCK)
    ids = c.tables["customer"].select("c_custkey", "c_nationkey", block.alias("block"))
    heads = ids.groupBy("block").agg(F.min("c_custkey").alias("src"))
    inner = ids.join(heads, "block").where("c_custkey <> src").select(
        "src", F.col("c_custkey").alias("dst"), (F.col("c_nationkey") + 100).cast("double").alias("weight"))
    following = heads.select((F.col("block") - 1).alias("block"), F.col("src").alias("dst"))
    return inner.unionByName(heads.join(following, "block").select("src", "dst", F.lit(1.0).alias("weight")))


@query
def communities_of_blocks(spark, folder):
    c = load(spark, folder)
    pairs = graph.undirected(block_calls(c), c.tables["customer"], "c_custkey", "weight")
    found = communities(c.tables["customer"], "c_custkey", pairs)
    return graph.group_size(found, "community", "community_size").select("node", "community", "community_size")


def modularity(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """One row: modularity of ``label(node, label)`` over the linked nodes."""
    ends = pairs.join(label.toDF("src", "__a"), "src").join(label.toDF("dst", "__b"), "dst")
    inside = ends.agg(F.sum(F.when(F.col("__a") == F.col("__b"), F.col("weight"))).alias("inside"),
                      F.sum("weight").alias("total"))
    strength = ends.select(F.col("__a").alias("c"), "weight").union(ends.select("__b", "weight"))
    squares = strength.groupBy("c").agg(F.sum("weight").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("squares"))
    return inside.join(squares).select(
        (F.coalesce("inside", F.lit(0.0)) / F.col("total") - F.col("squares") / (4 * F.col("total") * F.col("total"))).alias("q"))


@query
def community_invariants(spark, folder):
    """What must hold of any partition of the buyers: one row of counts and checks."""
    c = load(spark, folder)
    pairs = cut_lineage(purchase_pairs(c))
    found = buyer_communities(spark, folder)
    apart = graph.connected_components(c.tables["customer"], "c_custkey", pairs.select("src", "dst"))
    groups = found.groupBy("community").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
    places = groups.agg(F.count(F.lit(1)).alias("k"), F.max("community").alias("top"), F.sum("n").alias("members"))
    later = groups.select((F.col("community") + 1).alias("community"), F.col("first").alias("before"))
    unordered = groups.join(later, "community").where("first <= before").agg(F.count(F.lit(1)).alias("unordered"))
    nodes = found.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("node").alias("nodes"))
    better = modularity(pairs, found.select("node", "community")).join(
        modularity(pairs, apart.select("node", "component")).withColumnRenamed("q", "least"))
    return nodes.join(places).join(unordered).join(better).select(
        "rows", "nodes", "members", (F.col("k") == F.col("top")).alias("gapless"),
        (F.col("unordered") == 0).alias("ordered"), (F.col("q") >= F.col("least") - 1e-9).alias("at_least_components"))


def features(spark: SparkSession, folder: str) -> Features:
    """The feature job over the graph of blocks, run once per session; in debt stands for churned."""
    key = ("features", spark.sparkContext.applicationId, folder)
    if key in _found:
        return _found[key]
    c = load(spark, folder)
    lines = c.tables["customer"].withColumn("churned", F.col("c_acctbal") < 0)
    close = c.tables["account_links"].where(F.col("link_type").isin(*HOUSEHOLD_TYPES))
    _found[key] = refresh_features(lines, "c_custkey", "churned", block_calls(c), "weight", c.tables["customer"],
                                   "c_custkey", close, rounds=10, tol=0.0)
    return _found[key]


@query
def features_refreshed(spark, folder):
    found = features(spark, folder)
    return found.lines.join(found.customers, "c_custkey").select(
        "c_custkey", "influence_score", "community_id", "community_size", "community_churn_rate", "household_size")


@query
def influencers_in_churning_communities(spark, folder):
    c = load(spark, folder)
    t = dict(c.tables)
    t["customer"] = graph.with_features(t["customer"], "c_custkey", features(spark, folder).lines, "c_custkey")
    wide = retail.catalog(spark, folder, t, (
        Attribute("influence_score", "number", buckets=(50, 75, 90, 97)),
        Attribute("community_churn_rate", "number", buckets=(0.05, 0.1, 0.2, 0.3))))
    rule = all_of(attribute("customer.balance", "gte", 0), attribute("customer.influence_score", "gte", 60),
                  attribute("customer.community_churn_rate", "gte", 0.09))
    return matching(wide, "customer", rule, c.as_of)


@query
def pagerank_settled(spark, folder):
    """PageRank to its tolerance: ranks sum to 1, and one more round moves less than the tolerance."""
    c = load(spark, folder)
    pairs = cut_lineage(purchase_pairs(c))
    done = cut_lineage(graph.pagerank(c.tables["customer"], "c_custkey", pairs))
    arcs = both_directions(pairs)
    strength = arcs.groupBy("src").agg(F.sum("weight").alias("s"))
    total = c.tables["customer"].count()
    state = done.join(strength.withColumnRenamed("src", "node"), "node", "left")
    lost = state.agg(F.coalesce(F.sum(F.when(F.col("s").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
    got = state.join(arcs, F.col("node") == F.col("src")).groupBy("dst").agg(
        F.sum(F.col("rank") * F.col("weight") / F.col("s")).alias("got"))
    once = done.join(got, F.col("node") == F.col("dst"), "left").join(lost)
    after = (1 - graph.DAMPING) / total + graph.DAMPING * (F.col("lost") / total + F.coalesce("got", F.lit(0.0)))
    return once.agg(
        F.count(F.lit(1)).alias("nodes"), F.round(F.sum("rank"), 9).alias("total"),
        (F.sum(F.abs(after - F.col("rank"))) < graph.TOLERANCE).alias("settled"))


def typed_edges(c: Catalog) -> DataFrame:
    """All relationships as ``(type, src, dst, calls)`` between ``Label:key`` ids."""
    t, calls = c.tables, F.lit(None).cast("double").alias("calls")

    def rows(df, name, source, key, target, other, weight=calls):
        return df.select(F.lit(name).alias("type"), graph.node_id(source, F.col(key)).alias("src"),
                         graph.node_id(target, F.col(other)).alias("dst"), weight)

    return (
        rows(t["account_links"], "LINKED_TO", "Customer", "src", "Customer", "dst")
        .unionByName(rows(t["orders"], "OWNS", "Customer", "o_custkey", "Order", "o_orderkey"))
        .unionByName(rows(t["customer"], "LIVES_IN", "Customer", "c_custkey", "Nation", "c_nationkey"))
        .unionByName(rows(t["events"], "RAISED", "Customer", "user_id", "Event", "event_id"))
        .unionByName(rows(t["co_purchase"], "CALLED", "Customer", "src", "Customer", "dst",
                          F.col("quantity").alias("calls")))
    )


# Relationship types shown first.
PRIORITY = {"LINKED_TO": 0, "OWNS": 1, "LIVES_IN": 4, "RAISED": 6, "CALLED": 7}
NAMES = ("c_name", "n_name", "event_type")


@query
def degree_topk(spark, folder):
    return graph.degree(typed_edges(load(spark, folder))).orderBy(F.desc("degree"), "node").limit(50)


@query
def top_linked(spark, folder):
    return graph.top_linked(load(spark, folder).tables["account_links"], 5)


@query
def expand_topk(spark, folder):
    """Around every customer and nation; events stay hidden, as low-level rows do by default."""
    c = load(spark, folder)
    t = c.tables

    def named(df, label, key):
        return df.select(graph.node_id(label, F.col(key)).alias("node"),
                         graph.caption(df, key, NAMES).alias("caption"))

    captions = (named(t["customer"], "Customer", "c_custkey")
                .unionByName(named(t["nation"], "Nation", "n_nationkey"))
                .unionByName(named(t["orders"].select("o_orderkey"), "Order", "o_orderkey")))
    seeds = captions.where(~F.col("node").startswith("Order:")).select("node")
    edges = cut_lineage(typed_edges(c))
    return graph.expand(edges, captions, seeds, PRIORITY, hidden=("Event",))


@query
def search_union(spark, folder):
    return graph.search(load(spark, folder), "11", 40)


@query
def feature_summary(spark, folder):
    return features(spark, folder).summary


# ---- links and loads --------------------------------------------------------------------------
def link_kind(n: int):
    """One of the link types by order key; the fifth is none that may be used."""
    kinds = F.array(*(F.lit(k) for k in (*retail.LINK_TYPES, "Rival")[:n]))
    return F.element_at(kinds, (F.col("o_orderkey") % n).cast("int") + 1)


def order_pairs(c: Catalog) -> DataFrame:
    """Per order a link request between its customer and a neighbour account."""
    orders = c.tables["orders"]
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    other = F.floor(F.col("o_orderkey") / 9)
    kind = link_kind(5)
    return orders.select(
        F.col("o_orderkey").alias("seq"),
        F.when(urgent, other).otherwise(F.col("o_custkey")).alias("a"),
        F.when(urgent, F.col("o_custkey")).otherwise(other).alias("b"),
        kind.alias("link_type"))


def nation_ops(c: Catalog) -> DataFrame:
    """Per order a link or unlink between its customer and the account numbered like its nation."""
    customer = c.tables["customer"].select("c_custkey", F.col("c_nationkey").cast("long").alias("home"))
    joined = c.tables["orders"].join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.where(F.col("o_custkey") != F.col("home"))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    kind = link_kind(4)
    return joined.select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", "unlink").otherwise("link").alias("action"),
        F.when(urgent, F.col("home")).otherwise(F.col("o_custkey")).alias("a"),
        F.when(urgent, F.col("o_custkey")).otherwise(F.col("home")).alias("b"),
        kind.alias("link_type"))


def nation_links(c: Catalog) -> DataFrame:
    customer = c.tables["customer"].where(F.col("c_custkey") != F.col("c_nationkey"))
    return customer.select(
        F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"),
        F.lit("Household").alias("link_type"), F.lit("data").alias("source"))


@query
def link_merge(spark, folder):
    c = load(spark, folder)
    return links.link(c.tables["account_links"], order_pairs(c), c.tables["customer"], "c_custkey",
                      retail.LINK_TYPES).links


@query
def link_rejects(spark, folder):
    c = load(spark, folder)
    return links.link(c.tables["account_links"], order_pairs(c), c.tables["customer"], "c_custkey",
                      retail.LINK_TYPES).rejected


@query
def link_star(spark, folder):
    c = load(spark, folder)
    groups = c.tables["orders"].join(
        c.tables["customer"], F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("seq"),
        F.array(F.col("c_nationkey").cast("long"), "o_custkey",
                F.col("c_nationkey").cast("long"), F.col("c_nationkey") + F.lit(25).cast("long")
                ).alias("accounts"),
        link_kind(4).alias("link_type"))
    return links.link_group(c.tables["account_links"], groups, c.tables["customer"], "c_custkey", retail.LINK_TYPES).links


@query
def unlink(spark, folder):
    c = load(spark, folder)
    flipped = c.tables["account_links"].where(F.col("link_type") != "Family").select(
        F.col("dst").alias("a"), F.col("src").alias("b"))
    return links.unlink(c.tables["account_links"], flipped).links


@query
def unlink_missing(spark, folder):
    c = load(spark, folder)
    return links.unlink(c.tables["account_links"], order_pairs(c)).missing


@query
def link_log(spark, folder):
    c = load(spark, folder)
    return links.apply_link_log(nation_links(c), nation_ops(c), c.tables["customer"], "c_custkey",
                                retail.LINK_TYPES).links


@query
def link_log_rejects(spark, folder):
    """Operations on accounts that do not exist, with themselves or of no known type are skipped."""
    c = load(spark, folder)
    ops = order_pairs(c).withColumn("action", F.when(F.col("seq") % 7 == 0, "unlink").otherwise("link"))
    found = links.apply_link_log(c.tables["account_links"], ops, c.tables["customer"], "c_custkey", retail.LINK_TYPES)
    return found.rejected.select("seq", "a", "b", "link_type", "reason")


@query
def link_times(spark, folder):
    """Links carry the time of the request that made or last changed them."""
    c = load(spark, folder)
    dated = order_pairs(c).join(c.tables["orders"].select(F.col("o_orderkey").alias("seq"), "o_orderdate"), "seq")
    timed = dated.withColumnRenamed("o_orderdate", "at")
    found = links.link(c.tables["account_links"], timed, c.tables["customer"], "c_custkey", retail.LINK_TYPES).links
    return found.select("src", "dst", "link_type", F.col("created_at").cast("string").alias("created_at"))


@query
def upsert_latest(spark, folder):
    c = load(spark, folder)
    target = c.tables["customer"].select("c_custkey", "c_acctbal", "c_mktsegment")
    fresh = F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") + 1000000)
    rows = c.tables["orders"].select(
        fresh.otherwise(F.col("o_custkey")).alias("c_custkey"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("c_acctbal"),
        F.col("o_orderpriority").alias("priority"))
    return tables.upsert(target, rows, "c_custkey", "seq")


@query
def load_edges(spark, folder):
    c = load(spark, folder)
    bought = c.tables["lineitem"].join(c.tables["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    edges = bought.select(F.col("o_custkey").alias("src"),
                          (F.col("l_partkey") + F.col("l_linenumber") * 100).alias("dst"),
                          F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("seq"))
    return tables.load_edges(edges, c.tables["customer"], "c_custkey", c.tables["part"], "p_partkey",
                             "seq")


@query
def load_links(spark, folder):
    c = load(spark, folder)
    edges = order_pairs(c).select(F.col("a").alias("src"), F.col("b").alias("dst"), "link_type", "seq")
    return tables.load_edges(edges, c.tables["customer"], "c_custkey", c.tables["customer"],
                             "c_custkey", "seq", undirected=True)


@query
def duplicate_keys(spark, folder):
    return tables.duplicate_keys(load(spark, folder).tables["lineitem"], ["l_orderkey", "l_linenumber"])


@query
def as_of_dates(spark, folder):
    t = load(spark, folder).tables
    days = [(str(tables.as_of_date(t["orders"], "o_orderdate")),)]
    return spark.createDataFrame(days, "as_of string")


def monthly_spend(c: Catalog) -> DataFrame:
    month = F.trunc("o_orderdate", "month").alias("month")
    return c.tables["orders"].groupBy(F.col("o_custkey").alias("c_custkey"), month).agg(
        F.sum("o_totalprice").alias("spend"))


@query
def last3_avg(spark, folder):
    c = load(spark, folder)
    found = derived.mean_of_last_active(monthly_spend(c), c.tables["customer"], "c_custkey", "month",
                                        "spend", "spend_3m")
    return found.select("c_custkey", F.round("spend_3m", 6).alias("spend_3m"))


TIERS = (("Platinum", 4_000_000), ("Gold", 3_000_000), ("Silver", 2_000_000), ("Bronze", None))


@query
def value_tier(spark, folder):
    totals = monthly_spend(load(spark, folder)).groupBy("c_custkey").agg(F.sum("spend").alias("total"))
    return totals.select("c_custkey", derived.value_tier(F.col("total"), TIERS).alias("tier"))


@query
def last_order_date(spark, folder):
    found = derived.last_date(load(spark, folder).tables["orders"], "o_custkey", "o_orderdate", "last")
    return found.select("o_custkey", F.col("last").cast("string").alias("last"))


@query
def both_ways(spark, folder):
    return both_directions(load(spark, folder).tables["account_links"]).select("src", "dst", "link_type")


# ---- ready-made audiences ---------------------------------------------------------------------
audience("high_value_at_risk", all_of(
    attribute("order.status", "eq", "F"), attribute("order.price", "gte", 400000),
    attribute("customer.balance", "lt", 0)), "order")
audience("social_influencers", all_of(
    attribute("customer.balance", "gte", 0), network("co_purchase", op="gte", n=20)))
audience("upsell_ready", all_of(
    attribute("order.status", "eq", "O"), attribute("part.size", "gt", 40),
    attribute("customer.market", "neq", "BUILDING"),
    metric("shipped_quantity", "gt", 80, 36)), "order")
audience("plan_migration", all_of(
    attribute("customer.market", "eq", "HOUSEHOLD"), metric("avg_order", "gte", 200000, 24),
    metric("total_spend", "gte", 300000, 24), attribute("region.name", "in", ["ASIA", "EUROPE"])))
audience("shippers_without_promo", all_of(
    metric("shipped_quantity", "gt", 5, 36),
    ~related("part", all_of(attribute("part.type", "eq", "PROMO"), attribute("part.size", "lte", 5)))))
audience("foreign_without_event", all_of(
    attribute("region.name", "neq", "AMERICA"), metric("total_spend", "gte", 150000, 12),
    ~related("event", attribute("event.type", "eq", "purchase"))))
audience("old_brand_upgrade", all_of(
    attribute("order.status", "in", ["F", "O"]), attribute("customer.market", "in", ["BUILDING", "MACHINERY"]),
    attribute("part.size", "lte", 2)), "order")
audience("detractors", any_of(
    related("event", all_of(attribute("event.type", "eq", "error"),
                            attribute("event.date", "within_last_days", 10)), "gte", 2),
    attribute("customer.balance", "lte", -900)), as_of=retail.EVENT_AS_OF)
audience("young_digital", all_of(
    attribute("customer.balance", "between", [1800, 2500]), attribute("customer.market", "eq", "MACHINERY")))
audience("many_open_orders", all_of(related("order", attribute("order.status", "eq", "O"), "gte", 3)))
audience("household_churn_risk", network(
    "account_links", related("order", attribute("order.status", "eq", "P")),
    (edge("link_type", "in", ["Household", "Family"]),)))


@query
def influencers_in_risky_nations(spark, folder):
    """Rank percentile and group churn rate as columns, then a rule over them."""
    c = load(spark, folder)
    score = graph.rank_percentile(ranks(c), "rank", "node").select("node", "influence_score")
    churned = c.tables["customer"].select("c_custkey", "c_nationkey",
                                          (F.col("c_acctbal") < 0).alias("churned"))
    rate = graph.leave_one_out_rate(churned, "c_nationkey", "churned", "nation_size", "churn_rate")
    t = dict(c.tables)
    t["customer"] = graph.with_features(t["customer"], "c_custkey", score, "node")
    t["customer"] = graph.with_features(
        t["customer"], "c_custkey", rate.select("c_custkey", "churn_rate"), "c_custkey")
    wide = retail.catalog(spark, folder, t, (
        Attribute("influence_score", "number", buckets=(50, 75, 90, 97)),
        Attribute("churn_rate", "number", buckets=(0.05, 0.1, 0.2, 0.3))))
    rule = all_of(attribute("customer.balance", "gte", 0),
                  attribute("customer.influence_score", "gte", 90),
                  attribute("customer.churn_rate", "gte", 0.09))
    return matching(wide, "customer", rule, c.as_of)
