"""The same results as plain SQL over the same tables, for checking."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ASOF = "(SELECT max(o_orderdate)::date FROM orders)"
EVENT_ASOF = "DATE '2024-01-30'"

BUYERS = """
bought AS (SELECT l_partkey, date_trunc('month', l_shipdate) AS month, o_custkey,
                  sum(l_quantity) AS quantity
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
firsts AS (SELECT l_partkey, month, min(o_custkey) AS src FROM bought GROUP BY ALL),
co AS MATERIALIZED (SELECT src, o_custkey AS dst, count(*) AS purchases, sum(quantity) AS quantity
       FROM bought JOIN firsts USING (l_partkey, month) WHERE o_custkey <> src GROUP BY ALL),
co2 AS (SELECT src, dst, purchases, quantity FROM co
        UNION ALL SELECT dst, src, purchases, quantity FROM co)"""

LINKS = """
banded AS (SELECT c_custkey, c_nationkey, c_mktsegment, floor(c_acctbal / 500) AS band FROM customer),
heads AS (SELECT c_nationkey, c_mktsegment, band, min(c_custkey) AS src FROM banded GROUP BY ALL),
ln AS MATERIALIZED (SELECT src, c_custkey AS dst,
         (['Household', 'Family', 'Corporate', 'Same person'])[((src + c_custkey) % 4)::int + 1] AS link_type,
         'data' AS source
       FROM banded JOIN heads USING (c_nationkey, c_mktsegment, band) WHERE c_custkey <> src),
ln2 AS (SELECT src, dst, link_type FROM ln UNION ALL SELECT dst, src, link_type FROM ln)"""

ACTIVE = """
cust AS (SELECT customer.*, last_event FROM customer
         LEFT JOIN (SELECT user_id, max(ts::date) AS last_event FROM events GROUP BY 1)
         ON user_id = c_custkey)"""

PLACE = """
place AS (SELECT c.*, n_name, r_name FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey
          LEFT JOIN region ON n_regionkey = r_regionkey)"""


def with_(*parts: str, rest: str) -> str:
    return f"WITH {', '.join(parts)} {rest}"


def spend(months: int, aggregate: str = "sum(o_totalprice)") -> str:
    """Per-customer order metric as a scalar expression; 0 without rows."""
    return (f"coalesce((SELECT {aggregate} FROM orders WHERE o_custkey = c_custkey "
            f"AND o_orderdate::date > ({ASOF} - INTERVAL {months} MONTH)::date "
            f"AND o_orderdate::date <= {ASOF}), 0)")


def shipped(months: int, aggregate: str = "sum(l_quantity)", key: str = "o_custkey = c_custkey") -> str:
    return (f"coalesce((SELECT {aggregate} FROM orders o2 JOIN lineitem ON l_orderkey = o2.o_orderkey "
            f"WHERE o2.{key} AND l_shipdate::date > ({ASOF} - INTERVAL {months} MONTH)::date "
            f"AND l_shipdate::date <= {ASOF}), 0)")


def event_metric(months: int, aggregate: str, key: str = "c_custkey") -> str:
    return (f"coalesce((SELECT {aggregate} FROM events WHERE user_id = {key} "
            f"AND ts::date > ({EVENT_ASOF} - INTERVAL {months} MONTH)::date "
            f"AND ts::date <= {EVENT_ASOF}), 0)")


def order_exists(test: str) -> str:
    return f"EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {test})"


def part_exists(test: str) -> str:
    return ("EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
            f"JOIN part ON l_partkey = p_partkey WHERE o_custkey = c_custkey AND {test})")


def event_exists(test: str = "true", key: str = "c_custkey") -> str:
    return f"EXISTS (SELECT 1 FROM events WHERE user_id = {key} AND {test})"


EUROPE = ("(c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey "
          "WHERE r_name = 'EUROPE'))")
URGENT = "o_orderpriority = '1-URGENT'"
POOR = ("coalesce((SELECT count(DISTINCT co2.dst) FROM co2 JOIN customer f ON f.c_custkey = co2.dst "
        "WHERE co2.src = customer.c_custkey AND f.c_acctbal < 0), 0)")
BIG = f"{spend(24)} > 500000"

# ---- attribute predicates -------------------------------------------------------------
ORACLES["attr_eq"] = """
SELECT o_orderkey, o_orderkey = 77 AS number, c_name IS NOT DISTINCT FROM 'Customer#000000011' AS text,
       o_orderstatus = 'F' AS choice, o_orderdate::date = DATE '1998-10-03' AS day
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
ORACLES["attr_neq"] = """
SELECT c_custkey, c_acctbal <> 0 AS number, c_name <> 'Customer#000000011' AS text,
       c_mktsegment <> 'BUILDING' AS choice FROM customer"""
ORACLES["attr_range"] = """
SELECT o_orderkey, o_totalprice > 250000 AS above, o_totalprice >= 250000 AS "from",
       o_totalprice < 250000.5 AS below, o_totalprice <= 250000 AS "to",
       o_orderdate::date > DATE '1998-10-03' AS after, o_orderdate::date >= DATE '1998-10-03' AS since,
       o_orderdate::date < DATE '1998-10-03' AS before, o_orderdate::date <= DATE '1998-10-03' AS until
FROM orders"""
ORACLES["attr_between"] = """
SELECT o_orderkey, o_totalprice BETWEEN 100000 AND 200000 AS number,
       o_orderdate::date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AS day FROM orders"""
ORACLES["attr_in"] = """
SELECT c_custkey, c_custkey IN (3, 5, 8, 13) AS number,
       c_name IN ('Customer#000000001', 'Customer#000000002') AS text,
       c_mktsegment IN ('BUILDING', 'MACHINERY') AS choice FROM customer"""
ORACLES["attr_not_in"] = """
SELECT c_custkey, c_custkey NOT IN (3, 5, 8, 13) AS number,
       c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS choice FROM customer"""
ORACLES["attr_contains"] = f"""
SELECT c_custkey, contains(lower(c_name), 'r#0000001') AS own, contains(c_name, '%') AS wild,
       {part_exists("contains(lower(p_name), 'red')")} AS far FROM customer"""
ORACLES["attr_starts"] = f"""
SELECT c_custkey, starts_with(lower(c_name), 'customer#00000') AS own,
       {part_exists("starts_with(lower(p_name), 'small r')")} AS far FROM customer"""
ORACLES["attr_ends"] = f"""
SELECT c_custkey, ends_with(c_name, '7') AS own,
       NOT {part_exists("ends_with(lower(p_name), 'ring')")} AS far FROM customer"""
ORACLES["attr_null"] = with_(ACTIVE, rest=f"""
SELECT c_custkey, last_event IS NULL AS "unset", last_event IS NOT NULL AS "set",
       coalesce(last_event > DATE '2024-01-20', false) AS late,
       coalesce(NOT last_event > DATE '2024-01-20', false) AS not_late,
       coalesce(last_event > DATE '2024-01-20' OR last_event IS NULL, false) AS late_or_unset,
       EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey
               WHERE n_nationkey = c_nationkey AND r_name IS NULL) AS region_unset,
       {event_exists("event_type IS NULL")} AS event_unset FROM cust""")
ORACLES["attr_within_days"] = f"""
SELECT o_orderkey, o_orderdate::date BETWEEN {ASOF} - 90 AND {ASOF} AS own,
       o_orderdate::date = {ASOF} AS same_day,
       EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey
               AND l_shipdate::date BETWEEN {ASOF} - 30 AND {ASOF}) AS far FROM orders"""
ORACLES["attr_before_days"] = with_(ACTIVE, rest=f"""
SELECT c_custkey, coalesce(last_event < {EVENT_ASOF} - 2, false) AS own,
       coalesce(NOT last_event < {EVENT_ASOF} - 2, false) AS not_own,
       {event_exists(f"ts::date < {EVENT_ASOF} - 28")} AS far FROM cust""")

# ---- path conditions ------------------------------------------------------------------
ORACLES["lookup_region"] = with_(PLACE, rest="""
SELECT c_custkey FROM place WHERE r_name = 'EUROPE' AND c_acctbal > 5000""")
ORACLES["lookup_chain"] = with_(PLACE, rest="""
SELECT o_orderkey FROM orders JOIN place ON o_custkey = c_custkey
WHERE r_name IN ('ASIA', 'AFRICA') AND c_mktsegment = 'BUILDING' AND o_totalprice >= 400000""")
ORACLES["exists_order"] = f"""
SELECT c_custkey, {order_exists(URGENT)} AS urgent,
       {order_exists("o_orderpriority <> '1-URGENT'")} AS some_not_urgent,
       {part_exists("p_type = 'PROMO'")} AS promo_part,
       EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey
               JOIN supplier ON l_suppkey = s_suppkey
               WHERE o_custkey = c_custkey AND s_acctbal < 0) AS poor_supplier FROM customer"""
ORACLES["not_exists_order"] = f"""
SELECT c_custkey, NOT {order_exists(URGENT)} AS no_urgent,
       NOT {part_exists("p_size > 45")} AS no_large_part,
       NOT {event_exists("event_type = 'click'")} AS no_click FROM customer"""
ORACLES["exists_through_parent"] = f"""
SELECT o_orderkey, {event_exists("event_type = 'click'", "o_custkey")} AS clicked,
       NOT {event_exists("true", "o_custkey")} AS quiet,
       (SELECT count(*) FROM events WHERE user_id = o_custkey AND value >= 25) >= 3 AS busy
FROM orders"""
ORACLES["first_value_projection"] = with_(PLACE, rest="""
SELECT p.c_custkey, r_name AS region, o.status AS first_order_status,
       o.day AS first_order_date, b.brand AS first_part_brand, e.kind AS first_event_type
FROM place p
LEFT JOIN (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status,
                  arg_min(o_orderdate::date, o_orderkey) AS day FROM orders GROUP BY 1) o
  ON o.o_custkey = p.c_custkey
LEFT JOIN (SELECT o_custkey, arg_min(p_brand, p_partkey) AS brand FROM orders
           JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1) b
  ON b.o_custkey = p.c_custkey
LEFT JOIN (SELECT user_id, arg_min(event_type, event_id) AS kind FROM events GROUP BY 1) e
  ON e.user_id = p.c_custkey""")

# ---- metrics --------------------------------------------------------------------------
ORACLES["metric_sum"] = f"""
SELECT c_custkey, {BIG} AS two_years, {BIG} AS default_window,
       {shipped(6)} >= 60 AS lines FROM customer"""
ORACLES["metric_avg"] = f"""
SELECT c_custkey, {spend(12, "avg(o_totalprice)")} >= 250000 AS orders,
       {shipped(6, "avg(l_extendedprice)")} BETWEEN 40000 AND 60000 AS lines FROM customer"""
ORACLES["metric_min"] = f"""
SELECT c_custkey, {spend(12, "min(o_totalprice)")} < 100000 AS orders FROM customer"""
ORACLES["metric_max"] = f"""
SELECT c_custkey, {spend(12, "max(o_totalprice)")} > 400000 AS orders,
       {spend(1, "max(o_totalprice)")} = 0 AS "none" FROM customer"""
ORACLES["metric_count"] = f"""
SELECT c_custkey, {spend(12, "count(*)")} >= 2 AS orders,
       (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey WHERE o_custkey = c_custkey) > 40 AS parts_as_bag,
       {event_metric(1, "count(*)")} <> 0 AS events FROM customer"""
ORACLES["metric_untimed"] = """
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) <= 8 AS orders,
       (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE o_custkey = c_custkey) BETWEEN 30 AND 40 AS lines FROM customer"""
ORACLES["metric_missing_is_zero"] = f"""
SELECT c_custkey, {event_metric(1, "avg(value)")} < 20 AS low_average,
       {event_metric(1, "count(*)")} = 0 AS no_events, {spend(1)} <= 100 AS low_spend FROM customer"""
ORACLES["metric_fused"] = f"""
SELECT c_custkey, round({spend(3)}, 6)::double AS spend_3, round({spend(12)}, 6)::double AS spend_12,
       round({spend(36)}, 6)::double AS spend_36,
       round({spend(12, "avg(o_totalprice)")}, 6)::double AS average_12,
       round({spend(12, "max(o_totalprice)")}, 6)::double AS largest_12,
       (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer"""
ORACLES["usage_columns"] = f"SELECT c_custkey FROM customer WHERE {spend(12)} >= 600000"

# ---- counts ---------------------------------------------------------------------------
DISTINCT_PARTS = ("(SELECT count(DISTINCT p_partkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
                  "JOIN part ON l_partkey = p_partkey WHERE o_custkey = c_custkey AND {})")
ORACLES["related_count"] = f"""
SELECT c_custkey,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND {URGENT}) >= 3 AS urgent_orders,
  {DISTINCT_PARTS.format("p_type = 'PROMO'")} >= 8 AS distinct_promo_parts,
  (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey
   WHERE o_custkey = c_custkey AND l_returnflag = 'R') > 8 AS eight_or_more_lines,
  (SELECT count(DISTINCT s_suppkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey
   JOIN supplier ON l_suppkey = s_suppkey
   WHERE o_custkey = c_custkey AND (s_acctbal < 0 OR s_acctbal > 9000)) <> 4 AS suppliers,
  c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
                  WHERE r_name = 'ASIA') AS in_asia,
  true AS any_number FROM customer"""
ORACLES["related_none"] = f"""
SELECT c_custkey, NOT {event_exists()} AS no_events, NOT {part_exists("p_type = 'PROMO'")} AS no_promo,
       {event_exists()} AS some_event, NOT {order_exists("true")} AS not_any_order FROM customer"""
ORACLES["related_lt"] = f"""
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND {URGENT}) < 2 AS few_urgent,
       {DISTINCT_PARTS.format("true")} <= 30 AS few_parts FROM customer"""
ORACLES["network_count"] = with_(BUYERS, LINKS, rest=f"""
SELECT c_custkey, {POOR} >= 2 AS poor_friends,
       (SELECT count(DISTINCT dst) FROM co2 WHERE src = c_custkey) >= 20 AS popular,
       EXISTS (SELECT 1 FROM ln2 WHERE src = c_custkey) AS linked,
       NOT EXISTS (SELECT 1 FROM ln2 WHERE src = c_custkey) AS alone FROM customer""")
ORACLES["network_edge_filter"] = with_(BUYERS, LINKS, rest="""
SELECT c_custkey,
       (SELECT count(DISTINCT dst) FROM co2 WHERE src = c_custkey AND quantity >= 40) >= 4 AS large_shared,
       EXISTS (SELECT 1 FROM co2 WHERE src = c_custkey AND purchases > 1) AS close,
       EXISTS (SELECT 1 FROM ln2 WHERE src = c_custkey AND link_type IN ('Household', 'Family')) AS household
FROM customer""")
ORACLES["network_nested_rule"] = with_(BUYERS, LINKS, f"""
eu AS (SELECT c_custkey AS k FROM customer WHERE {EUROPE}),
urgent AS (SELECT o_custkey AS k FROM orders WHERE {URGENT} GROUP BY 1 HAVING count(*) >= 2),
spender AS (SELECT c_custkey AS k FROM customer WHERE {spend(24)} > 800000)""", rest="""
SELECT c_custkey,
  (SELECT count(DISTINCT dst) FROM co2 JOIN eu ON k = dst WHERE src = c_custkey) >= 3 AS europeans,
  (SELECT count(DISTINCT dst) FROM ln2 JOIN urgent ON k = dst
   WHERE src = c_custkey AND link_type <> 'Corporate') >= 1 AS urgent_relatives,
  (SELECT count(DISTINCT dst) FROM co2 JOIN spender ON k = dst WHERE src = c_custkey) >= 3 AS spending_friends
FROM customer""")
ORACLES["network_nested_network"] = with_(BUYERS, """
inner_ok AS (SELECT src AS k FROM co2 JOIN customer f ON f.c_custkey = dst WHERE f.c_acctbal < -500
             GROUP BY 1 HAVING count(DISTINCT dst) >= 2
             UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9800)""", rest="""
SELECT c_custkey, (SELECT count(DISTINCT dst) FROM co2 JOIN inner_ok ON k = dst
                   WHERE src = c_custkey AND quantity BETWEEN 10 AND 45) >= 3 AS friends_of_poor
FROM customer""")

ORACLES["path_both_ways"] = with_(LINKS, """
near AS (SELECT ln2.src AS k, f.c_custkey AS f, f.c_acctbal AS balance, f.c_mktsegment AS market
         FROM ln2 JOIN customer f ON f.c_custkey = ln2.dst)""", rest="""
SELECT c_custkey, EXISTS (SELECT 1 FROM near WHERE k = c_custkey AND balance > 9000) AS rich_relative,
       (SELECT count(DISTINCT f) FROM near WHERE k = c_custkey AND market = 'BUILDING') >= 2 AS two_in_building,
       coalesce((SELECT sum(balance) FROM near WHERE k = c_custkey), 0) > 10000 AS family_wealth
FROM customer""")
ORACLES["network_directions"] = with_(BUYERS, rest="""
SELECT c_custkey, (SELECT count(DISTINCT dst) FROM co WHERE src = c_custkey) >= 6 AS leads_six,
       (SELECT count(DISTINCT src) FROM co WHERE dst = c_custkey) >= 6 AS follows_six,
       EXISTS (SELECT 1 FROM co JOIN customer f ON f.c_custkey = co.dst
               WHERE co.src = customer.c_custkey AND f.c_acctbal < 0) AS leads_poor,
       EXISTS (SELECT 1 FROM co JOIN customer f ON f.c_custkey = co.src
               WHERE co.dst = customer.c_custkey AND f.c_acctbal < 0) AS follows_poor
FROM customer""")

# ---- Boolean composition ----------------------------------------------------------------
EITHER = ("(c_mktsegment = 'BUILDING' OR "
          "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 12)")
ORACLES["bool_or_not"] = with_(PLACE, rest=f"""
SELECT c_custkey, {EITHER} AS either, NOT {EITHER} AS neither,
       r_name IS DISTINCT FROM 'ASIA' AND ({event_exists()} OR {part_exists("p_size > 49")}) AS mixed
FROM place""")
ORACLES["empty_rule"] = """
SELECT c_custkey, true AS everyone, false AS nobody, true AS also_everyone FROM customer"""


def fnv(text: str) -> str:
    return (f"list_reduce(list_transform(range(1, length({text}) + 1), "
            f"lambda i: ascii(substr({text}, i, 1))::BIGINT), "
            "lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT)")


def group_of(segment: str, key: str, threshold: int) -> str:
    text = f"('{segment}:' || {key}::varchar)"
    return f"CASE WHEN {fnv(text)} % 10000 < {threshold} THEN 'control' ELSE 'target' END"


def member_rows(segment: str, key: str, table: str, test: str, threshold: int) -> str:
    return (f"SELECT '{segment}' AS segment_id, {key} AS member_key, "
            f"{group_of(segment, key, threshold)} AS \"group\" FROM {table} WHERE {test}")


RICH = "c_acctbal > 7000"
BASE_MEMBERS = [
    member_rows("rich", "c_custkey", "customer", RICH, 1000),
    member_rows("europe", "c_custkey", "customer", EUROPE, 0),
    member_rows("spenders", "c_custkey", "customer", BIG, 2500),
]
ORDER_MEMBERS = member_rows("big_orders", "o_orderkey", "orders", "o_totalprice > 400000", 1234)
CHAIN_MEMBERS = [
    *BASE_MEMBERS,
    member_rows("rich_europe", "c_custkey", "customer", f"{RICH} AND {EUROPE}", 0),
    member_rows("rich_not_europe", "c_custkey", "customer", f"{RICH} AND NOT {EUROPE}", 2000),
]
ORACLES["segment_reuse"] = f"""
SELECT c_custkey, {RICH} AND {BIG} AS rich_spender, {RICH} AND NOT ({BIG}) AS only_rich,
       false AS never_built FROM customer"""

# ---- segment jobs -------------------------------------------------------------------------
FLAGSHIP = f"c_acctbal >= 0 AND {BIG} AND {order_exists(URGENT)} AND {POOR} >= 2"
ORACLES["churn_contagion"] = with_(BUYERS, rest=f"SELECT c_custkey FROM customer WHERE {FLAGSHIP}")
ORACLES["preview_counts"] = with_(BUYERS, rest=f"""
SELECT count(*) FILTER ({FLAGSHIP}) AS segment_size, count(*) AS base_size,
       (count(*) FILTER ({FLAGSHIP}))::double / count(*) AS share FROM customer""")
ORACLES["preview_sample"] = with_(PLACE, rest="""
SELECT c_custkey AS customer_key, c_name AS customer_name, c_mktsegment AS customer_market,
       c_acctbal AS customer_balance, r_name AS region_name
FROM place WHERE r_name = 'EUROPE' ORDER BY c_custkey LIMIT 25""")
ORACLES["members_page"] = with_(PLACE, rest="""
SELECT o_orderkey AS order_key, c_name AS customer_name, n_name AS nation_name,
       o_orderdate::date AS order_date
FROM orders JOIN place ON o_custkey = c_custkey WHERE o_totalprice > 400000 AND r_name = 'ASIA'
ORDER BY o_orderkey LIMIT 100 OFFSET 50""")
ORACLES["members_of_group"] = f"""
SELECT c_custkey AS customer_key, c_mktsegment AS customer_market, 'control' AS "group"
FROM customer WHERE {RICH} AND {group_of("rich", "c_custkey", 1000)} = 'control'"""
ORACLES["holdout_split"] = f"""
SELECT o_orderkey, {fnv("('abc123:' || o_orderkey::varchar)")} AS hash,
       {group_of("abc123", "o_orderkey", 1250)} AS "group" FROM orders"""
ORACLES["holdout_counts"] = f"""
SELECT {group_of("abc123", "o_orderkey", 1250)} AS "group", count(*) AS members FROM orders GROUP BY 1"""
ORACLES["materialize_members"] = " UNION ALL ".join([*BASE_MEMBERS, ORDER_MEMBERS])
ORACLES["materialize_chain"] = " UNION ALL ".join(CHAIN_MEMBERS)
ORACLES["materialize_state"] = f"""
WITH m AS ({" UNION ALL ".join([*CHAIN_MEMBERS, ORDER_MEMBERS])}),
s(segment_id, anchor, holdout_pct) AS (VALUES ('rich', 'customer', 10.0), ('europe', 'customer', 0.0),
  ('spenders', 'customer', 25.0), ('nobody', 'customer', 10.0), ('big_orders', 'order', 12.34),
  ('rich_europe', 'customer', 0.0), ('rich_not_europe', 'customer', 20.0))
SELECT segment_id, anchor, 1::int AS version, holdout_pct::double AS holdout_pct,
       {ASOF}::varchar AS as_of, count(member_key) AS member_count,
       count(*) FILTER ("group" = 'target') AS target_count,
       count(*) FILTER ("group" = 'control') AS control_count
FROM s LEFT JOIN m USING (segment_id) GROUP BY ALL"""
ORACLES["export_members"] = with_(PLACE, rest=f"""
SELECT c_custkey AS customer_key, c_name AS customer_name, r_name AS region_name, 'target' AS "group"
FROM place WHERE {RICH} AND {group_of("rich", "c_custkey", 1000)} = 'target'""")


# ---- insight jobs -----------------------------------------------------------------------------
def bucket_text(column: str, edges: list, labels: list[str]) -> str:
    whens = " ".join(f"WHEN {column} < {e} THEN '{label}'" for e, label in zip(edges, labels))
    return f"CASE WHEN {column} IS NULL THEN NULL {whens} ELSE '{labels[-1]}' END"


BALANCE = bucket_text("c_acctbal", [0, 2500, 5000, 7500],
                      ["< 0", "0 – 2500", "2500 – 5000", "5000 – 7500", "≥ 7500"])
SIZE = bucket_text("p_size", [10, 20, 30, 40], ["< 10", "10 – 20", "20 – 30", "30 – 40", "≥ 40"])
VALUE_ORDER = {
    "customer.market": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "customer.balance": ["< 0", "0 – 2500", "2500 – 5000", "5000 – 7500", "≥ 7500"],
    "region.name": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
    "order.status": ["F", "O", "P"],
    "order.priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "part.size": ["< 10", "10 – 20", "20 – 30", "30 – 40", "≥ 40"],
    "part.type": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
    "event.type": ["click", "error", "purchase", "signup", "view"],
}
SOURCES = {
    "customer.market": "SELECT c_custkey AS k, c_mktsegment AS value FROM place",
    "customer.balance": f"SELECT c_custkey AS k, {BALANCE} AS value FROM place",
    "region.name": "SELECT c_custkey AS k, r_name AS value FROM place",
    "nation.name": "SELECT c_custkey AS k, n_name AS value FROM place",
    "order.status": "SELECT o_custkey AS k, o_orderstatus AS value FROM orders",
    "order.priority": "SELECT o_custkey AS k, o_orderpriority AS value FROM orders",
    "part.size": f"SELECT o_custkey AS k, {SIZE} AS value FROM orders JOIN lineitem "
                 "ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey",
    "part.type": "SELECT o_custkey AS k, p_type AS value FROM orders JOIN lineitem "
                 "ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey",
    "event.type": "SELECT user_id AS k, event_type AS value FROM events",
}
MULTI = {"order.status", "order.priority", "part.size", "part.type", "event.type"}


def breakdown_parts(flag: str, fields: list[str], before: tuple[str, ...] = ()) -> tuple[str, ...]:
    """CTEs ending in ``report``: the full breakdown of customers by the fields."""
    pieces = []
    for f in fields:
        known = VALUE_ORDER.get(f)
        place = f"coalesce(list_position({known}, value) - 1, {len(known)})" if known else "0"
        pieces.append(f"""
          SELECT '{f}' AS field, value, count(DISTINCT CASE WHEN flag THEN b.k END) AS segment,
                 count(DISTINCT b.k) AS base, {str(f in MULTI).lower()} AS multi_valued,
                 ({place})::int AS position
          FROM (SELECT base.k, flag, coalesce(value, '(none)') AS value
                FROM base LEFT JOIN ({SOURCES[f]}) s ON s.k = base.k) b GROUP BY value""")
    return (*before, PLACE, f"""
base AS MATERIALIZED (SELECT c_custkey AS k, coalesce({flag}, false) AS flag FROM customer),
totals AS (SELECT count(*) FILTER (flag) AS seg_n, count(*) AS base_n FROM base),
counted AS ({" UNION ALL ".join(pieces)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY base DESC, value) AS rn FROM counted),
report AS (SELECT field, value, segment, base,
                  CASE WHEN seg_n > 0 THEN segment / seg_n ELSE 0 END AS segment_pct,
                  CASE WHEN base_n > 0 THEN base / base_n ELSE 0 END AS base_pct,
                  multi_valued, position
           FROM ranked, totals WHERE rn <= 60),
shown AS (SELECT *, round_even(100 * segment_pct / base_pct, 0)::bigint AS "index" FROM report)""")


def breakdown_sql(flag: str, fields: list[str], before: tuple[str, ...] = ()) -> str:
    return with_(*breakdown_parts(flag, fields, before), rest="""
SELECT field, value, segment, base, round(segment_pct, 9) AS segment_pct, round(base_pct, 9) AS base_pct,
       "index", multi_valued, position FROM shown""")


ORACLES["breakdown_bucket"] = breakdown_sql(BIG, ["customer.balance"])
ORACLES["breakdown_enum"] = breakdown_sql(BIG, ["customer.market", "region.name"])
ORACLES["breakdown_multi"] = breakdown_sql(EUROPE, ["part.size", "event.type", "order.status"])
ORACLES["profile_long"] = breakdown_sql(FLAGSHIP, [
    "customer.market", "customer.balance", "region.name", "nation.name", "order.priority", "part.type",
    "event.type"], (BUYERS,))
ORACLES["breakdown_top"] = """
WITH base AS (SELECT o_orderkey, o_totalprice > 400000 AS flag, c_name,
                     strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month
              FROM orders JOIN customer ON o_custkey = c_custkey),
totals AS (SELECT count(*) FILTER (flag) AS seg_n, count(*) AS base_n FROM base),
counted AS (SELECT 'order.date' AS field, month AS value, count(*) FILTER (flag) AS segment,
                   count(*) AS base FROM base GROUP BY ALL
            UNION ALL SELECT 'customer.name', c_name, count(*) FILTER (flag), count(*) FROM base GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY base DESC, value) AS rn FROM counted)
SELECT field, value, segment, base, round(segment / seg_n, 9) AS segment_pct,
       round(base / base_n, 9) AS base_pct,
       round_even(100 * (segment / seg_n) / (base / base_n), 0)::bigint AS "index",
       false AS multi_valued, 0::int AS position
FROM ranked, totals WHERE rn <= 60"""
ORACLES["bucket_labels"] = f"""
SELECT label, count(*) AS rows FROM (
  SELECT {SIZE} AS label FROM part
  UNION ALL SELECT {bucket_text("p_retailprice", [900.5, 950, 1000],
                                ["< 900.5", "900.5 – 950", "950 – 1000", "≥ 1000"])} FROM part
  UNION ALL SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') FROM orders) GROUP BY label"""


def kpi_rows(names: list[str]) -> str:
    rows = [f"SELECT '{n}' AS kpi, avg({n}) FILTER (flag) AS s, avg({n}) AS b FROM v" for n in names]
    return (f"SELECT kpi, round(s, 4) AS segment, round(b, 4) AS base, "
            f"round(CASE WHEN b <> 0 THEN s / b END, 4) AS lift FROM ({' UNION ALL '.join(rows)})")


ORACLES["profile_counts"] = ORACLES["preview_counts"]
ORACLES["kpi_lift"] = f"""
WITH v AS (SELECT {EUROPE} AND {BIG} AS flag, c_acctbal AS balance,
                  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders,
                  {spend(12)} AS spend, {event_metric(6, "count(*)")} AS events FROM customer)
{kpi_rows(["balance", "orders", "spend", "events"])}"""
ORACLES["profile_kpis"] = ORACLES["kpi_lift"]
ORACLES["kpi_orders"] = f"""
WITH q AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem
           WHERE l_shipdate::date > ({ASOF} - INTERVAL 36 MONTH)::date AND l_shipdate::date <= {ASOF}
           GROUP BY 1),
v AS (SELECT {event_exists("event_type = 'click'", "o_custkey")} AS flag, o_totalprice AS price,
             coalesce(quantity, 0) AS quantity, {event_metric(6, "count(*)", "o_custkey")} AS events
      FROM orders LEFT JOIN q ON l_orderkey = o_orderkey)
{kpi_rows(["price", "quantity", "events"])}"""


def funnel_sql(tests: list[str], op: str = "AND", before: str = "", delta: bool = False) -> str:
    flags = ", ".join(f"coalesce({t}, false) AS c{i}" for i, t in enumerate(tests))
    rows = []
    for i in range(len(tests)):
        so_far = f" {op} ".join(f"c{j}" for j in range(i + 1))
        rows.append(f"SELECT count(*) AS base, {i}::int AS step, count(*) FILTER (c{i}) AS alone, "
                    f"count(*) FILTER ({so_far}) AS cumulative FROM f")
    start = "base" if op == "AND" else "0"
    last = (f", cumulative - coalesce(lag(cumulative) OVER (ORDER BY step), {start}) AS delta"
            if delta else "")
    parts = [p for p in (before, f"f AS MATERIALIZED (SELECT {flags} FROM customer)") if p]
    return with_(*parts, rest=f"SELECT base, step, alone, cumulative{last} FROM ({' UNION ALL '.join(rows)})")


STEPS = ["c_acctbal >= 0", BIG, order_exists(URGENT), f"{POOR} >= 2"]
ORACLES["funnel_and"] = funnel_sql(STEPS, before=BUYERS)
ORACLES["funnel_delta"] = funnel_sql(STEPS, before=BUYERS, delta=True)
ORACLES["funnel_or"] = funnel_sql([
    EUROPE, BIG, event_exists("event_type = 'click'"),
    "NOT (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 8"], "OR")
ORACLES["funnel_negated"] = funnel_sql([f"NOT ({EUROPE} AND {BIG})"])
ORACLES["trend_monthly"] = f"""
WITH m AS (SELECT o_custkey AS k, date_trunc('month', l_shipdate)::date AS month, sum(l_quantity) AS v
           FROM orders JOIN lineitem ON l_orderkey = o_orderkey
           WHERE l_shipdate::date > ({ASOF} - INTERVAL 12 MONTH)::date AND l_shipdate::date <= {ASOF} + 31
           GROUP BY ALL),
j AS (SELECT month, v, {EUROPE} AS flag FROM m JOIN customer ON k = c_custkey WHERE month <= {ASOF})
SELECT month::varchar AS month, round(avg(v) FILTER (flag), 6) AS segment, round(avg(v), 6) AS base,
       count(*) FILTER (flag) AS segment_n, count(*) AS base_n FROM j GROUP BY 1"""
ORACLES["trend_counts"] = f"""
WITH m AS (SELECT user_id AS k, date_trunc('month', ts)::date AS month, count(*) AS v FROM events
           WHERE ts::date > ({EVENT_ASOF} - INTERVAL 6 MONTH)::date AND ts::date <= {EVENT_ASOF} + 31
           GROUP BY ALL),
j AS (SELECT month, v, o_orderstatus = 'F' AS flag FROM m JOIN orders ON k = o_custkey
      WHERE month <= {EVENT_ASOF} AND o_custkey IN (SELECT c_custkey FROM customer))
SELECT month::varchar AS month, round(avg(v) FILTER (flag), 6) AS segment, round(avg(v), 6) AS base,
       count(*) FILTER (flag) AS segment_n, count(*) AS base_n FROM j GROUP BY 1"""
ORACLES["overlap_matrix"] = f"""
WITH m AS MATERIALIZED ({" UNION ALL ".join(CHAIN_MEMBERS)}),
o AS MATERIALIZED ({ORDER_MEMBERS}),
ids(id) AS (VALUES ('rich'), ('europe'), ('spenders'), ('nobody'), ('big_orders'), ('rich_europe'),
                   ('rich_not_europe')),
pairs AS (SELECT x.segment_id AS a, y.segment_id AS b, count(*) AS n FROM m x JOIN m y USING (member_key)
          GROUP BY ALL
          UNION ALL SELECT 'big_orders', 'big_orders', count(*) FROM o),
size AS (SELECT a AS id, n FROM pairs WHERE a = b),
grid AS (SELECT i.id AS a, j.id AS b, coalesce(p.n, 0) AS common, coalesce(sa.n, 0) AS na,
                coalesce(sb.n, 0) AS nb
         FROM ids i CROSS JOIN ids j LEFT JOIN pairs p ON p.a = i.id AND p.b = j.id
         LEFT JOIN size sa ON sa.id = i.id LEFT JOIN size sb ON sb.id = j.id)
SELECT a, b, common,
       CASE WHEN na + nb - common > 0 THEN round(common / (na + nb - common), 9) ELSE 0 END AS jaccard,
       CASE WHEN na > 0 THEN round(common / na, 9) ELSE 0 END AS containment FROM grid"""
ORACLES["overlap_reopened"] = """
WITH m AS (SELECT '007' AS id, c_custkey AS k FROM customer WHERE c_acctbal >= 0
           UNION ALL SELECT '12', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
ids(id) AS (VALUES ('007'), ('12'), ('none')),
grid AS (SELECT i.id AS a, j.id AS b,
                (SELECT count(*) FROM m x JOIN m y ON x.k = y.k WHERE x.id = i.id AND y.id = j.id) AS common,
                (SELECT count(*) FROM m WHERE m.id = i.id) AS na, (SELECT count(*) FROM m WHERE m.id = j.id) AS nb
         FROM ids i CROSS JOIN ids j)
SELECT a, b, common,
       CASE WHEN na + nb - common > 0 THEN round(common / (na + nb - common), 9) ELSE 0 END AS jaccard,
       CASE WHEN na > 0 THEN round(common / na, 9) ELSE 0 END AS containment FROM grid"""
ORACLES["metric_of_parent"] = with_(ACTIVE, rest=f"""
SELECT o_orderkey FROM orders JOIN cust ON o_custkey = c_custkey WHERE c_acctbal > 0
AND last_event > ({EVENT_ASOF} - INTERVAL 1 MONTH)::date AND last_event <= {EVENT_ASOF}""")
ORACLES["trend_of_parent"] = with_(ACTIVE, rest=f"""
SELECT date_trunc('month', last_event)::date::varchar AS month,
       round(avg(c_acctbal) FILTER (o_orderstatus = 'F'), 4) AS segment, round(avg(c_acctbal), 4) AS base,
       count(*) FILTER (o_orderstatus = 'F') AS segment_n, count(*) AS base_n
FROM orders JOIN cust ON o_custkey = c_custkey
WHERE last_event > ({EVENT_ASOF} - INTERVAL 6 MONTH)::date AND date_trunc('month', last_event) <= {EVENT_ASOF}
GROUP BY 1""")
ORACLES["lookup_duplicates"] = """
SELECT c_custkey, r_name = 'ASIA' AS east, n_name AS nation
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
ORACLES["drivers"] = with_(*breakdown_parts(f"{EUROPE} AND c_acctbal > 5000", [
    "customer.market", "nation.name", "order.priority", "part.type", "event.type"]), rest="""
, scored AS (SELECT *, abs(log2(greatest("index", 1) / 100)) * sqrt(greatest(segment_pct, base_pct)) AS strength,
                  CASE WHEN "index" >= 120 AND segment_pct >= 0.05 THEN 'over'
                       WHEN "index" <= 80 AND base_pct >= 0.05 THEN 'under' END AS direction
           FROM shown WHERE "index" IS NOT NULL AND value <> '(none)'),
placed AS (SELECT *, row_number() OVER (PARTITION BY direction
                                        ORDER BY strength DESC, field, value)::int AS rank
           FROM scored WHERE direction IS NOT NULL)
SELECT direction, rank, field, value, "index", round(strength, 6) AS strength FROM placed
WHERE rank <= CASE direction WHEN 'over' THEN 6 ELSE 4 END""")
ORACLES["member_360_counts"] = with_(PLACE, BUYERS, LINKS, f"""
seg AS ({" UNION ALL ".join(BASE_MEMBERS)}),
ord AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (
          PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders),
ord1 AS (SELECT k, least(count(*), 24) AS n, max(o_orderkey) FILTER (rn = 1) AS latest,
                max(o_orderkey) FILTER (rn = 24) AS o24 FROM ord GROUP BY 1),
lin AS (SELECT k, least(count(*), 24) AS n FROM (
          SELECT DISTINCT o_custkey AS k, l_quantity, l_extendedprice, l_discount, l_returnflag,
                 l_shipdate::date FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1),
par AS (SELECT o_custkey AS k, least(count(DISTINCT l_partkey), 24) AS n
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1),
sup AS (SELECT o_custkey AS k, least(count(DISTINCT l_suppkey), 24) AS n
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
        GROUP BY 1),
ev AS (SELECT user_id AS k, event_id, row_number() OVER (
         PARTITION BY user_id ORDER BY ts::date DESC, event_id) AS rn FROM events),
ev1 AS (SELECT k, least(count(*), 24) AS n, max(event_id) FILTER (rn = 1) AS latest FROM ev GROUP BY 1),
cp AS (SELECT src AS k, dst, row_number() OVER (
         PARTITION BY src ORDER BY purchases DESC, dst) AS rn FROM co2),
cp1 AS (SELECT k, least(count(*), 25) AS n, max(dst) FILTER (rn = 1) AS closest FROM cp GROUP BY 1),
al AS (SELECT src AS k, least(count(*), 25) AS n FROM ln2 GROUP BY 1),
sg AS (SELECT member_key AS k, string_agg(segment_id, ',' ORDER BY segment_id) AS segments
       FROM seg GROUP BY 1)""", rest="""
SELECT c_custkey, c_name AS name, r_name AS region, coalesce(ord1.n, 0)::int AS n_order,
       coalesce(lin.n, 0)::int AS n_line, coalesce(par.n, 0)::int AS n_part,
       coalesce(sup.n, 0)::int AS n_supplier, coalesce(ev1.n, 0)::int AS n_event,
       coalesce(cp1.n, 0)::int AS n_co_purchase, coalesce(al.n, 0)::int AS n_account_links,
       ord1.latest AS latest_order, o24 AS order_24, ev1.latest AS latest_event, closest, segments
FROM place LEFT JOIN ord1 ON ord1.k = c_custkey LEFT JOIN lin ON lin.k = c_custkey
LEFT JOIN par ON par.k = c_custkey LEFT JOIN sup ON sup.k = c_custkey LEFT JOIN ev1 ON ev1.k = c_custkey
LEFT JOIN cp1 ON cp1.k = c_custkey LEFT JOIN al ON al.k = c_custkey LEFT JOIN sg ON sg.k = c_custkey
WHERE c_acctbal > 7000""")
ORACLES["field_values"] = """
SELECT p_name AS value, count(*) AS rows FROM part WHERE starts_with(lower(p_name), 're')
GROUP BY 1 ORDER BY rows DESC, value LIMIT 50"""

# ---- graph jobs ---------------------------------------------------------------------------------
PAIRS = """
pairs AS MATERIALIZED (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(quantity)::double AS weight
          FROM co WHERE src <> dst GROUP BY ALL)"""
ORACLES["undirected_edges"] = with_(BUYERS, PAIRS, rest="SELECT src, dst, weight FROM pairs")


def rank_parts(rounds: int = 10) -> list[str]:
    parts = [BUYERS, PAIRS, """
arcs AS MATERIALIZED (SELECT src, dst, weight FROM pairs UNION ALL SELECT dst, src, weight FROM pairs),
strength AS MATERIALIZED (SELECT src, sum(weight) AS s FROM arcs GROUP BY 1),
size AS (SELECT count(*)::double AS n FROM customer),
r0 AS MATERIALIZED (SELECT c_custkey AS node, 1 / n AS rank FROM customer, size)"""]
    for i in range(rounds):
        parts.append(f"""
r{i + 1} AS MATERIALIZED (
  SELECT node, 0.15 / n + 0.85 * lost / n + 0.85 * coalesce(got, 0) AS rank
  FROM r{i} CROSS JOIN size
  CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM strength)) d
  LEFT JOIN (SELECT dst, sum(rank * weight / s) AS got FROM r{i} JOIN arcs ON arcs.src = node
             JOIN strength ON strength.src = node GROUP BY 1) g ON g.dst = node)""")
    return parts


SCORE = """
score AS (SELECT node, round_even(100 * (row_number() OVER (ORDER BY round(rank, 12), node) - 1)
                                  / greatest(1, (SELECT count(*) FROM customer) - 1), 0)::int AS influence_score
          FROM r10)"""
ORACLES["pagerank_10"] = with_(*rank_parts(), rest="SELECT node, round(rank, 10) AS rank FROM r10")
ORACLES["influence_percentile"] = with_(*rank_parts(), SCORE, rest="SELECT node, influence_score FROM score")

HOUSE = """
close AS (SELECT src, dst FROM ln2 WHERE link_type IN ('Household', 'Family')),
reach(node, root) AS (SELECT c_custkey, c_custkey FROM customer
                      UNION SELECT close.dst, reach.root FROM reach JOIN close ON close.src = reach.node),
house AS (SELECT node, min(root) AS component FROM reach GROUP BY 1),
sized AS (SELECT node, component, count(*) OVER (PARTITION BY component) AS household_size FROM house)"""


def with_recursive(*parts: str, rest: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} {rest}"


ORACLES["household_components"] = with_recursive(LINKS, HOUSE, rest="SELECT * FROM sized")
ORACLES["purchase_components"] = with_recursive(BUYERS, """
reach(node, root) AS (SELECT c_custkey, c_custkey FROM customer
                      UNION SELECT co2.dst, reach.root FROM reach JOIN co2 ON co2.src = reach.node
                      WHERE reach.root < co2.dst)""", rest="""
SELECT node, min(root) AS component FROM reach GROUP BY 1""")
ORACLES["leave_one_out"] = """
SELECT c_custkey, c_nationkey, churned, n AS nation_size,
       CASE WHEN n > 1 THEN round_even((k - churned::int) / (n - 1), 3) ELSE 0 END AS churn_rate
FROM (SELECT c_custkey, c_nationkey, c_acctbal < 0 AS churned, count(*) OVER w AS n,
             count(*) FILTER (c_acctbal < 0) OVER w AS k
      FROM customer WINDOW w AS (PARTITION BY c_nationkey))"""
ORACLES["features_written_back"] = with_recursive(LINKS, HOUSE, rest=f"""
SELECT c_custkey, household_size FROM customer JOIN sized ON node = c_custkey
WHERE household_size >= 2 AND {order_exists("true")}""")

TYPED = """
edges AS MATERIALIZED (
  SELECT 'LINKED_TO' AS type, 'Customer:' || src AS src, 'Customer:' || dst AS dst, NULL::double AS calls FROM ln
  UNION ALL SELECT 'OWNS', 'Customer:' || o_custkey, 'Order:' || o_orderkey, NULL FROM orders
  UNION ALL SELECT 'LIVES_IN', 'Customer:' || c_custkey, 'Nation:' || c_nationkey, NULL FROM customer
  UNION ALL SELECT 'RAISED', 'Customer:' || user_id, 'Event:' || event_id, NULL FROM events
  UNION ALL SELECT 'CALLED', 'Customer:' || src, 'Customer:' || dst, quantity FROM co),
ends AS MATERIALIZED (SELECT type, src, dst, calls, true AS outgoing FROM edges
         UNION ALL SELECT type, dst, src, calls, false FROM edges WHERE src <> dst),
deg AS MATERIALIZED (SELECT src AS node, count(*) AS degree FROM ends GROUP BY 1)"""
ORACLES["degree_topk"] = with_(BUYERS, LINKS, TYPED, rest="""
SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 50""")
ORACLES["top_linked"] = with_(LINKS, rest="""
SELECT src AS node, count(*) AS degree FROM ln2 GROUP BY 1 ORDER BY degree DESC, node LIMIT 5""")
ORACLES["expand_topk"] = with_(BUYERS, LINKS, TYPED, """
names AS (SELECT 'Customer:' || c_custkey AS node, coalesce(c_name, c_custkey::varchar) AS caption FROM customer
          UNION ALL SELECT 'Nation:' || n_nationkey, coalesce(n_name, n_nationkey::varchar) FROM nation
          UNION ALL SELECT 'Order:' || o_orderkey, o_orderkey::varchar FROM orders),
near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY
           CASE type WHEN 'LINKED_TO' THEN 0 WHEN 'OWNS' THEN 1 WHEN 'LIVES_IN' THEN 4 WHEN 'RAISED' THEN 6
                     WHEN 'CALLED' THEN 7 ELSE 99 END, coalesce(calls, 0) DESC, type, dst)::int AS rank
         FROM ends WHERE (src LIKE 'Customer:%' OR src LIKE 'Nation:%') AND dst NOT LIKE 'Event:%'),
shown AS (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM near WHERE rank <= 30)""", rest="""
SELECT src AS seed, rank, type, outgoing, dst AS neighbour, caption, d2.degree AS neighbour_degree,
       d1.degree AS seed_degree, d1.degree > n AS truncated
FROM shown JOIN deg d1 ON d1.node = src JOIN deg d2 ON d2.node = dst LEFT JOIN names ON names.node = dst""")
ORACLES["search_union"] = """
SELECT entity, key FROM (
  (SELECT 'customer' AS entity, c_custkey::varchar AS key FROM customer
   WHERE starts_with(c_custkey::varchar, '11') OR contains(lower(c_name), '11') ORDER BY c_custkey LIMIT 40)
  UNION ALL
  (SELECT 'order', o_orderkey::varchar FROM orders WHERE starts_with(o_orderkey::varchar, '11')
   ORDER BY o_orderkey LIMIT 40)) ORDER BY entity, key LIMIT 40"""
BLOCKS = """
blocks AS (SELECT c_custkey, c_custkey // 25 AS block, c_nationkey, c_acctbal < 0 AS churned FROM customer),
block_heads AS (SELECT block, min(c_custkey) AS head FROM blocks GROUP BY 1),
grouped AS (SELECT c_custkey, churned, dense_rank() OVER (ORDER BY head) AS community,
                   count(*) OVER (PARTITION BY block) AS size, count(*) FILTER (churned) OVER (PARTITION BY block) AS gone
            FROM blocks JOIN block_heads USING (block)),
rates AS (SELECT *, CASE WHEN size > 1 THEN round_even((gone - churned::int) / (size - 1), 3) ELSE 0 END AS rate
          FROM grouped)"""
BLOCK_PAIRS = """
pairs AS MATERIALIZED (
  SELECT head AS src, c_custkey AS dst, (100 + c_nationkey)::double AS weight
  FROM blocks JOIN block_heads USING (block) WHERE c_custkey <> head
  UNION ALL SELECT a.head, b.head, 1 FROM block_heads a JOIN block_heads b ON b.block = a.block + 1)"""
ORACLES["number_components"] = with_recursive(LINKS, HOUSE, rest="""
SELECT node, dense_rank() OVER (ORDER BY component) AS community, household_size AS community_size FROM sized""")
ORACLES["communities_of_blocks"] = with_(BLOCKS, rest="""
SELECT c_custkey AS node, community, size AS community_size FROM grouped""")
ORACLES["community_invariants"] = """
SELECT count(*) AS rows, count(*) AS nodes, count(*) AS members, true AS gapless, true AS ordered,
       true AS at_least_components FROM customer"""
ORACLES["features_refreshed"] = with_recursive(LINKS, HOUSE, BLOCKS, BLOCK_PAIRS, *rank_parts()[2:], SCORE, rest="""
SELECT c_custkey, influence_score, community AS community_id, size AS community_size, rate AS community_churn_rate,
       household_size FROM rates JOIN score ON score.node = c_custkey JOIN sized ON sized.node = c_custkey""")
ORACLES["influencers_in_churning_communities"] = with_(BLOCKS, BLOCK_PAIRS, *rank_parts()[2:], SCORE, rest="""
SELECT c_custkey FROM rates JOIN score ON node = c_custkey JOIN customer USING (c_custkey)
WHERE c_acctbal >= 0 AND influence_score >= 60 AND rate >= 0.09""")
ORACLES["pagerank_settled"] = "SELECT count(*) AS nodes, 1.0::double AS total, true AS settled FROM customer"
ORACLES["feature_summary"] = with_recursive(LINKS, HOUSE, BLOCKS, rest="""
SELECT (SELECT count(*) FROM customer) AS lines, (SELECT count(DISTINCT community) FROM grouped) AS communities,
       (SELECT count(*) FROM sized WHERE household_size > 1) AS customers_in_households""")

# ---- links and loads -------------------------------------------------------------------------------
REQUESTS = """
req AS (SELECT o_orderkey AS seq,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderkey // 9 ELSE o_custkey END AS a,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_custkey ELSE o_orderkey // 9 END AS b,
               (['Household', 'Family', 'Corporate', 'Same person', 'Rival'])[(o_orderkey % 5)::int + 1] AS link_type
        FROM orders),
judged AS (SELECT *, CASE WHEN link_type = 'Rival' THEN 'unknown type' WHEN a = b THEN 'self link'
                          WHEN a NOT IN (SELECT c_custkey FROM customer)
                            OR b NOT IN (SELECT c_custkey FROM customer) THEN 'unknown account' END AS reason
           FROM req)"""
MERGED = """
fresh AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, arg_min(a, seq) AS fa, arg_min(b, seq) AS fb,
                 arg_max(link_type, seq) AS ft FROM accepted GROUP BY 1, 2)"""
MERGE_ROWS = """
SELECT coalesce(src, fa) AS src, coalesce(dst, fb) AS dst, coalesce(ft, link_type) AS link_type,
       CASE WHEN ft IS NOT NULL THEN 'user' ELSE source END AS source
FROM {} FULL JOIN fresh ON least(src, dst) = lo AND greatest(src, dst) = hi"""
ORACLES["link_merge"] = with_(LINKS, REQUESTS, "accepted AS (SELECT * FROM judged WHERE reason IS NULL)",
                              MERGED, rest=MERGE_ROWS.format("ln"))
ORACLES["link_rejects"] = with_(REQUESTS, rest="""
SELECT seq, a, b, link_type, reason FROM judged WHERE reason IS NOT NULL""")
ORACLES["link_times"] = with_(LINKS, REQUESTS, """
accepted AS (SELECT judged.*, o_orderdate::date AS day FROM judged JOIN orders ON o_orderkey = seq WHERE reason IS NULL),
fresh AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, arg_min(a, seq) AS fa, arg_min(b, seq) AS fb,
                 arg_max(link_type, seq) AS ft, arg_max(day, seq) AS fat FROM accepted GROUP BY 1, 2)""", rest="""
SELECT coalesce(src, fa) AS src, coalesce(dst, fb) AS dst, coalesce(ft, link_type) AS link_type,
       fat::varchar AS created_at
FROM ln FULL JOIN fresh ON least(src, dst) = lo AND greatest(src, dst) = hi""")
ORACLES["link_log_rejects"] = with_(REQUESTS, rest="""
SELECT seq, a, b, link_type, reason FROM judged WHERE reason IS NOT NULL AND seq % 7 <> 0""")
ORACLES["link_star"] = with_(LINKS, """
raw AS (SELECT o_orderkey AS seq, c_nationkey::bigint AS a, o_custkey AS x, c_nationkey + 25 AS y,
               (['Household', 'Family', 'Corporate', 'Same person'])[(o_orderkey % 4)::int + 1] AS link_type
        FROM orders JOIN customer ON o_custkey = c_custkey),
req AS (SELECT seq * 10 + 1 AS seq, a, x::bigint AS b, link_type FROM raw
        UNION ALL SELECT seq * 10 + 2, a, y::bigint, link_type FROM raw),
accepted AS (SELECT * FROM req WHERE a <> b AND a IN (SELECT c_custkey FROM customer)
             AND b IN (SELECT c_custkey FROM customer))""", MERGED, rest=MERGE_ROWS.format("ln"))
ORACLES["unlink"] = with_(LINKS, rest="SELECT src, dst, link_type, source FROM ln WHERE link_type = 'Family'")
ORACLES["unlink_missing"] = with_(LINKS, REQUESTS, rest="""
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM req
WHERE (least(a, b), greatest(a, b)) NOT IN (SELECT (least(src, dst), greatest(src, dst)) FROM ln)""")
ORACLES["link_log"] = with_("""
ops AS (SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'unlink' ELSE 'link' END AS action,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN c_nationkey ELSE o_custkey END AS a,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_custkey ELSE c_nationkey END AS b,
               (['Household', 'Family', 'Corporate', 'Same person'])[(o_orderkey % 4)::int + 1] AS link_type
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey <> c_nationkey),
old AS (SELECT c_custkey AS src, c_nationkey::bigint AS dst, 'Household' AS link_type, 'data' AS source
        FROM customer WHERE c_custkey <> c_nationkey),
cleared AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, max(seq) AS cut FROM ops
            WHERE action = 'unlink' GROUP BY 1, 2),
accepted AS (SELECT ops.* FROM ops LEFT JOIN cleared ON lo = least(a, b) AND hi = greatest(a, b)
             WHERE action = 'link' AND (cut IS NULL OR seq > cut)
               AND a IN (SELECT c_custkey FROM customer) AND b IN (SELECT c_custkey FROM customer)),
kept AS (SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM cleared
         WHERE lo = least(src, dst) AND hi = greatest(src, dst)))""", MERGED,
                             rest=MERGE_ROWS.format("kept"))
ORACLES["upsert_latest"] = """
WITH r AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS k, o_orderkey,
                  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS bal, o_orderpriority FROM orders),
last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey DESC) = 1)
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NOT NULL THEN bal ELSE c_acctbal END AS c_acctbal,
       c_mktsegment, o_orderpriority AS priority FROM customer FULL JOIN last ON k = c_custkey"""
ORACLES["load_edges"] = """
SELECT o_custkey AS src, l_partkey + l_linenumber * 100 AS dst, arg_max(l_quantity, (l_orderkey, l_quantity)) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_custkey IN (SELECT c_custkey FROM customer)
  AND l_partkey + l_linenumber * 100 IN (SELECT p_partkey FROM part) GROUP BY 1, 2"""
ORACLES["load_links"] = with_(REQUESTS, rest="""
SELECT arg_min(a, seq) AS src, arg_min(b, seq) AS dst, arg_max(link_type, seq) AS link_type FROM req
WHERE a IN (SELECT c_custkey FROM customer) AND b IN (SELECT c_custkey FROM customer)
GROUP BY least(a, b), greatest(a, b)""")
ORACLES["duplicate_keys"] = """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""
ORACLES["as_of_dates"] = f"SELECT {ASOF}::varchar AS as_of"
MONTHLY = """
monthly AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS spend
            FROM orders GROUP BY ALL)"""
ORACLES["last3_avg"] = with_(MONTHLY, rest="""
SELECT c_custkey, round(coalesce(avg(spend), 0), 6) AS spend_3m FROM customer LEFT JOIN (
  SELECT * FROM monthly QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY month DESC) <= 3)
ON o_custkey = c_custkey GROUP BY 1""")
ORACLES["value_tier"] = """
SELECT o_custkey AS c_custkey, CASE WHEN sum(o_totalprice) >= 4000000 THEN 'Platinum'
  WHEN sum(o_totalprice) >= 3000000 THEN 'Gold' WHEN sum(o_totalprice) >= 2000000 THEN 'Silver'
  ELSE 'Bronze' END AS tier FROM orders GROUP BY 1"""
ORACLES["last_order_date"] = "SELECT o_custkey, max(o_orderdate)::date::varchar AS last FROM orders GROUP BY 1"
ORACLES["both_ways"] = with_(LINKS, rest="SELECT src, dst, link_type FROM ln2")

# ---- ready-made audiences -----------------------------------------------------------------------------
ORDER_PART = ("EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey "
              "WHERE l_orderkey = o_orderkey AND {})")
ORACLES["high_value_at_risk"] = """
SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND o_totalprice >= 400000 AND c_acctbal < 0"""
ORACLES["social_influencers"] = with_(BUYERS, rest="""
SELECT c_custkey FROM customer WHERE c_acctbal >= 0
AND (SELECT count(DISTINCT dst) FROM co2 WHERE src = c_custkey) >= 20""")
ORACLES["upsell_ready"] = f"""
SELECT orders.o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'O' AND {ORDER_PART.format("p_size > 40")} AND c_mktsegment <> 'BUILDING'
AND {shipped(36, key="o_orderkey = orders.o_orderkey")} > 80"""
ORACLES["plan_migration"] = with_(PLACE, rest=f"""
SELECT c_custkey FROM place WHERE c_mktsegment = 'HOUSEHOLD' AND {spend(24, "avg(o_totalprice)")} >= 200000
AND {spend(24)} >= 300000 AND r_name IN ('ASIA', 'EUROPE')""")
ORACLES["shippers_without_promo"] = f"""
SELECT c_custkey FROM customer WHERE {shipped(36)} > 5 AND NOT {part_exists("p_type = 'PROMO' AND p_size <= 5")}"""
ORACLES["foreign_without_event"] = with_(PLACE, rest=f"""
SELECT c_custkey FROM place WHERE r_name <> 'AMERICA' AND {spend(12)} >= 150000
AND NOT {event_exists("event_type = 'purchase'")}""")
ORACLES["old_brand_upgrade"] = f"""
SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus IN ('F', 'O') AND c_mktsegment IN ('BUILDING', 'MACHINERY')
AND {ORDER_PART.format("p_size <= 2")}"""
ORACLES["detractors"] = f"""
SELECT c_custkey FROM customer WHERE c_acctbal <= -900 OR
(SELECT count(*) FROM events WHERE user_id = c_custkey AND event_type = 'error'
 AND ts::date BETWEEN {EVENT_ASOF} - 10 AND {EVENT_ASOF}) >= 2"""
ORACLES["young_digital"] = """
SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 1800 AND 2500 AND c_mktsegment = 'MACHINERY'"""
ORACLES["many_open_orders"] = """
SELECT c_custkey FROM customer
WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') >= 3"""
ORACLES["household_churn_risk"] = with_(LINKS, rest="""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM ln2 WHERE src = c_custkey
AND link_type IN ('Household', 'Family')
AND dst IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))""")
ORACLES["influencers_in_risky_nations"] = with_(*rank_parts(), SCORE, """
rate AS (SELECT c_custkey AS k, CASE WHEN n > 1 THEN round_even((churn - flag) / (n - 1), 3) ELSE 0 END AS churn_rate
         FROM (SELECT c_custkey, (c_acctbal < 0)::int AS flag, count(*) OVER w AS n,
                      count(*) FILTER (c_acctbal < 0) OVER w AS churn
               FROM customer WINDOW w AS (PARTITION BY c_nationkey)))""", rest="""
SELECT c_custkey FROM customer JOIN score ON node = c_custkey JOIN rate ON k = c_custkey
WHERE c_acctbal >= 0 AND influence_score >= 90 AND churn_rate >= 0.09""")
