"""A catalog over the retail tables: customers and orders as anchors."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.ranking import aggregate_apart
from muster.model import Anchor, Attribute, Catalog, Entity, Hop, Kpi, Metric, Network
from muster.sources.tables import as_of_date, read_tables

# Allowed texts and bucket edges.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
MARKETS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ORDER_STATES = ("F", "O", "P")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
LINK_TYPES = ("Household", "Family", "Corporate", "Same person")
BALANCE_BUCKETS = (0, 2500, 5000, 7500)
PRICE_BUCKETS = (100000, 200000, 300000, 400000)
SIZE_BUCKETS = (10, 20, 30, 40)
VALUE_BUCKETS = (10, 25, 50, 100)
EVENT_AS_OF = date(2024, 1, 30)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables with timestamps as dates, plus the two derived edge tables."""
    t = read_tables(spark, folder, TABLES)
    t["orders"] = t["orders"].withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    t["lineitem"] = t["lineitem"].withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    t["events"] = t["events"].withColumn("event_date", F.col("ts").cast("date"))
    t["co_purchase"] = co_purchase(t["orders"], t["lineitem"])
    t["account_links"] = account_links(t["customer"])
    return t


def co_purchase(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Edges from the first buyer of a part in a month (smallest key) to its other buyers.

    A star per part and month: as many edges as buyers, however popular the part is.
    ``purchases`` counts the shared part-months, ``quantity`` what the other buyer bought in them.
    """
    group = ["l_partkey", "month"]
    bought = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_partkey", F.trunc("l_shipdate", "month").alias("month"), "o_custkey", "l_quantity")
    # A line without a buyer makes no edge. Asking for either value once the join is done keeps its both uses alike
    # down to the lines' columns, so that lines are shuffled by order once and not once for each use.
    bought = bought.where(F.col("o_custkey").isNotNull() | F.col("l_quantity").isNotNull())
    # Reduced on the map side, so a hot part costs one row per task here; the join
    # below has one row per part and month on this side, and AQE splits the other.
    # Most parts have one buyer in a month, and no edge.
    first = aggregate_apart(bought, group, F.min("o_custkey").alias("src"), F.max("o_custkey").alias("last"))
    first = first.where(F.col("src") < F.col("last")).drop("last")
    shared = bought.join(first, group).where(F.col("o_custkey") != F.col("src")).select(
        "src", F.col("o_custkey").alias("dst"), *group, "l_quantity")
    return (
        aggregate_apart(shared, ["src", "dst", *group], F.sum("l_quantity").alias("quantity"))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("purchases"), F.sum("quantity").alias("quantity"))
    )


def account_links(customer: DataFrame) -> DataFrame:
    """Edges from the first customer of a nation, market and balance band to the others."""
    group = ["c_nationkey", "c_mktsegment", "band"]
    banded = customer.select("c_custkey", "c_nationkey", "c_mktsegment",
                             F.floor(F.col("c_acctbal") / 500).alias("band"))
    first = aggregate_apart(banded, group, F.min("c_custkey").alias("src"))
    kind = F.element_at(F.array(*[F.lit(k) for k in LINK_TYPES]),
                        ((F.col("src") + F.col("dst")) % 4).cast("int") + 1)
    return (
        banded.join(first, group)
        .where(F.col("c_custkey") != F.col("src"))
        .select("src", F.col("c_custkey").alias("dst"))
        .withColumn("link_type", kind)
        .withColumn("source", F.lit("data"))
    )


def last_event(customer: DataFrame, events: DataFrame) -> DataFrame:
    """Customers with the date of their last event, null where there is none."""
    last = events.groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.max("event_date").alias("last_event_date"))
    return customer.join(last, "c_custkey", "left")


def catalog(spark: SparkSession, folder: str, tables: dict[str, DataFrame] | None = None,
            extra: tuple[Attribute, ...] = ()) -> Catalog:
    """The retail catalog; ``extra`` describes columns added to the customer table."""
    t = tables or read(spark, folder)

    to_nation = Hop("nation", "c_nationkey", "n_nationkey")
    to_region = Hop("region", "n_regionkey", "r_regionkey")
    to_orders = Hop("orders", "c_custkey", "o_custkey", many=True)
    to_lines = Hop("lineitem", "o_orderkey", "l_orderkey", many=True)
    to_part = Hop("part", "l_partkey", "p_partkey")
    to_supplier = Hop("supplier", "l_suppkey", "s_suppkey")
    to_events = Hop("events", "c_custkey", "user_id", many=True)
    to_customer = Hop("customer", "o_custkey", "c_custkey")

    def paths(customer: tuple[Hop, ...], order: tuple[Hop, ...]) -> dict[str, tuple[Hop, ...]]:
        return {"customer": customer, "order": order}

    entities = (
        Entity("customer", "customer", "c_custkey", (
            Attribute("key", "number", "c_custkey"),
            Attribute("name", "string", "c_name"),
            Attribute("balance", "number", "c_acctbal", buckets=BALANCE_BUCKETS),
            Attribute("market", "enum", "c_mktsegment", values=MARKETS),
            *extra,
        ), paths((), (to_customer,))),
        Entity("nation", "nation", "n_nationkey", (
            Attribute("name", "string", "n_name"),
        ), paths((to_nation,), (to_customer, to_nation))),
        Entity("region", "region", "r_regionkey", (
            Attribute("name", "enum", "r_name", values=REGIONS),
        ), paths((to_nation, to_region), (to_customer, to_nation, to_region))),
        Entity("order", "orders", "o_orderkey", (
            Attribute("key", "number", "o_orderkey"),
            Attribute("status", "enum", "o_orderstatus", values=ORDER_STATES),
            Attribute("priority", "enum", "o_orderpriority", values=PRIORITIES),
            Attribute("price", "number", "o_totalprice", buckets=PRICE_BUCKETS),
            Attribute("date", "date", "o_orderdate"),
        ), paths((to_orders,), ())),
        Entity("line", "lineitem", None, (
            Attribute("quantity", "number", "l_quantity"),
            Attribute("price", "number", "l_extendedprice"),
            Attribute("discount", "number", "l_discount"),
            Attribute("flag", "string", "l_returnflag"),
            Attribute("shipped", "date", "l_shipdate"),
        ), paths((to_orders, to_lines), (to_lines,))),
        Entity("part", "part", "p_partkey", (
            Attribute("name", "string", "p_name"),
            Attribute("brand", "string", "p_brand"),
            Attribute("type", "enum", "p_type", values=PART_TYPES),
            Attribute("size", "number", "p_size", buckets=SIZE_BUCKETS),
            Attribute("price", "number", "p_retailprice"),
        ), paths((to_orders, to_lines, to_part), (to_lines, to_part))),
        Entity("supplier", "supplier", "s_suppkey", (
            Attribute("name", "string", "s_name"),
            Attribute("balance", "number", "s_acctbal"),
        ), paths((to_orders, to_lines, to_supplier), (to_lines, to_supplier))),
        Entity("event", "events", "event_id", (
            Attribute("type", "enum", "event_type", values=EVENT_TYPES),
            Attribute("value", "number", "value", buckets=VALUE_BUCKETS),
            Attribute("date", "date", "event_date"),
        ), paths((to_events,), (to_customer, to_events))),
    )
    metrics = (
        Metric("total_spend", "order", "sum", "o_totalprice", "o_orderdate", 24),
        Metric("avg_order", "order", "avg", "o_totalprice", "o_orderdate", 12),
        Metric("smallest_order", "order", "min", "o_totalprice", "o_orderdate", 12),
        Metric("largest_order", "order", "max", "o_totalprice", "o_orderdate", 12),
        Metric("recent_orders", "order", "count", "", "o_orderdate", 12),
        Metric("order_count", "order", "count"),
        Metric("shipped_quantity", "line", "sum", "l_quantity", "l_shipdate", 6),
        Metric("avg_line_price", "line", "avg", "l_extendedprice", "l_shipdate", 6),
        Metric("line_count", "line", "count"),
        Metric("part_count", "part", "count"),
        Metric("event_count", "event", "count", "", "event_date", 6, EVENT_AS_OF),
        Metric("event_value", "event", "sum", "value", "event_date", 1, EVENT_AS_OF),
        Metric("avg_event_value", "event", "avg", "value", "event_date", 1, EVENT_AS_OF),
    )
    networks = (
        Network("co_purchase", "customer", "co_purchase", (
            Attribute("purchases", "number"), Attribute("quantity", "number"))),
        Network("account_links", "customer", "account_links", (
            Attribute("link_type", "enum", values=LINK_TYPES), Attribute("source", "string"))),
    )
    anchors = (
        Anchor("customer",
               profile=("customer.market", "customer.balance", "region.name", "nation.name",
                        "order.priority", "part.type", "event.type"),
               kpis=(Kpi("balance", field="customer.balance"),
                     Kpi("orders", metric="order_count"),
                     Kpi("spend", metric="total_spend", window_months=12),
                     Kpi("events", metric="event_count", window_months=6)),
               sample=("customer.key", "customer.name", "customer.market", "customer.balance",
                       "region.name")),
        Anchor("order",
               profile=("order.status", "order.priority", "order.price", "customer.market",
                        "region.name"),
               kpis=(Kpi("price", field="order.price"),
                     Kpi("quantity", metric="shipped_quantity", window_months=36),
                     Kpi("events", metric="event_count", window_months=6)),
               sample=("order.key", "order.status", "order.price", "customer.name")),
    )
    return Catalog(t, entities, anchors, metrics, networks,
                   clock=lambda: as_of_date(t["orders"], "o_orderdate"),
                   link_network="account_links")
