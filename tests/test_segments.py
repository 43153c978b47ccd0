from datetime import date

import pytest
from pyspark.sql import functions as F

from muster.model import RuleError
from muster.operators import insights, segments
from muster.operators.conditions import all_of, any_of, attribute, in_segment, metric, network, related
from muster.operators.evaluate import flags, matching
from muster.operators.segments import Segment
from muster.session import shared_folder, work_path
from muster.sources.memberships import MembershipStore

EUROPE = attribute("region.name", "eq", "EUROPE")
RICH = attribute("customer.balance", "gt", 5000)
URGENT = related("order", attribute("order.priority", "eq", "1-URGENT"), n=2)


def keys(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize("rule", [
    EUROPE, URGENT, metric("total_spend", "gt", 500000, 24), network("co_purchase", RICH, n=3),
    attribute("part.type", "eq", "PROMO"), related("event", op="eq", n=0),
    any_of(EUROPE, ~URGENT), all_of(),
])
def test_negation_splits_the_base(retail, rule):
    sizes = flags(retail, "customer", {"yes": rule, "no": ~rule}).agg(
        F.count(F.when(F.col("yes"), 1)), F.count(F.when(F.col("no"), 1)),
        F.count(F.when(F.col("yes") & F.col("no"), 1)), F.count(F.lit(1))).first()
    assert sizes[0] + sizes[1] == sizes[3] and sizes[2] == 0


def test_filters_become_inner_joins_and_reach_the_scan(retail):
    rule = all_of(RICH, metric("total_spend", "gt", 500000, 24), URGENT)
    plan = matching(retail, "customer", rule)._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" not in plan and "GreaterThan(c_acctbal,5000.0)" in plan
    assert plan.count("FileScan parquet") == 2, "metric and count share one pass over orders"
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_funnel_ends_at_the_count(retail):
    for rule in (all_of(RICH, EUROPE, URGENT), any_of(EUROPE, URGENT), ~all_of(RICH, EUROPE), RICH):
        steps = insights.funnel(retail, "customer", rule).orderBy("step").collect()
        size = segments.counts(retail, "customer", rule).first()
        assert steps[-1].cumulative == size.segment_size
        assert steps[0].base == size.base_size
    narrowing = [r.cumulative for r in insights.funnel(
        retail, "customer", all_of(RICH, EUROPE, URGENT)).orderBy("step").collect()]
    assert narrowing == sorted(narrowing, reverse=True)
    assert insights.funnel(retail, "customer", all_of()).collect() == []


def test_breakdown_shares_add_up(retail):
    rows = insights.breakdown(retail, "customer", RICH, ["customer.market", "order.status"]).collect()
    single = [r for r in rows if r.field == "customer.market"]
    assert sum(r.segment_pct for r in single) == pytest.approx(1)
    assert sum(r.base_pct for r in single) == pytest.approx(1)
    assert [r.position for r in single] == sorted(r.position for r in single)
    assert sum(r.base_pct for r in rows if r.field == "order.status") > 1


def test_breakdown_of_nobody(retail):
    rows = insights.breakdown(retail, "customer", ~all_of(), ["customer.market"]).collect()
    assert {(r.segment, r.segment_pct, r["index"]) for r in rows} == {(0, 0.0, 0)}


def test_trend_needs_a_date(retail):
    with pytest.raises(RuleError):
        insights.trend(retail, "customer", "order_count", RICH)


def test_member_360_shows_whole_rows(retail):
    some = retail.tables["customer"].where("c_custkey in (3, 8)").select("c_custkey")
    rows = {r.c_custkey: r for r in insights.member_360(retail, "customer", some).collect()}
    assert set(rows) == {3, 8}
    dates = [o.o_orderdate for o in rows[8].order or []]
    assert dates == sorted(dates, reverse=True)
    assert rows[3].own.c_name == "Customer#000000003"


def test_suggestions_are_for_text(retail):
    with pytest.raises(RuleError):
        insights.field_values(retail, "customer.balance")
    assert insights.field_values(retail, "customer.market").count() == 5


@pytest.fixture()
def store(spark):
    return MembershipStore(spark, work_path(spark, "store"))


def test_build_in_dependency_order(retail, store):
    chain = [
        Segment("a", "customer", all_of(in_segment("b"), in_segment("d"))),
        Segment("b", "customer", all_of(in_segment("d"), RICH), 10),
        Segment("d", "customer", EUROPE),
    ]
    state = segments.materialize(retail, chain[0], store, chain)
    assert set(state) == {"a", "b", "d"}
    both = all_of(EUROPE, RICH)
    assert keys(store.read("customer", ["a"]).select("member_key")) == keys(matching(retail, "customer", both))
    again = segments.materialize_all(retail, chain, store)
    assert again == state, "nothing was stale"


def test_rebuild_replaces_only_its_own_members(retail, store):
    first = [Segment("x", "customer", EUROPE, 20), Segment("y", "customer", RICH)]
    before = segments.materialize_all(retail, first, store)
    y = keys(store.read("customer", ["y"]).select("member_key"))
    held = keys(store.read("customer", ["x"]).where("group = 'control'").select("member_key"))
    assert before["x"].control_count == len(held)
    assert before["x"].target_count + before["x"].control_count == before["x"].member_count
    nobody = attribute("customer.balance", "gt", 10 ** 9)
    after = segments.materialize_all(retail, [Segment("x", "customer", nobody, 20, version=2), first[1]], store)
    assert after["x"].member_count == 0 and store.read("customer", ["x"]).count() == 0
    assert after["y"] == before["y"] and keys(store.read("customer", ["y"]).select("member_key")) == y
    segments.materialize_all(retail, [Segment("x", "customer", EUROPE, 20, version=3)], store)
    assert keys(store.read("customer", ["x"]).where("group = 'control'").select("member_key")) == held


def test_a_reopened_store_reads_the_same(spark, retail, store):
    segments.materialize_all(retail, [Segment("x", "customer", EUROPE)], store)
    reopened = MembershipStore(spark, store.path)
    assert keys(reopened.read("customer", ["x"]).select("member_key")) == keys(matching(retail, "customer", EUROPE))
    assert reopened.state() == store.state()


def test_empty_audiences_survive_reopening(spark, retail, store):
    nobody = Segment("none", "customer", attribute("customer.balance", "gt", 10 ** 9), 10)
    segments.materialize_all(retail, [nobody], store)
    reopened = MembershipStore(spark, store.path)
    assert segments.members(retail, nobody, reopened, ["customer.key"]).collect() == []
    user = Segment("user", "customer", ~in_segment("none"))
    state = segments.materialize(retail, user, reopened)
    assert state["user"].member_count == retail.tables["customer"].count()
    assert state == reopened.state()


def test_unknown_dependencies_are_refused(retail, store):
    with pytest.raises(RuleError):
        segments.materialize_all(retail, [Segment("u", "customer", in_segment("unheard"))], store)


def test_cycles_are_refused(retail, store):
    loop = [Segment("p", "customer", in_segment("q")), Segment("q", "customer", in_segment("p"))]
    with pytest.raises(RuleError):
        segments.materialize_all(retail, loop, store)
    with pytest.raises(RuleError):
        segments.materialize_all(retail, [Segment("self", "customer", in_segment("self"))], store)


def test_segments_of_another_anchor_are_refused(retail, store):
    both = [Segment("o", "order", attribute("order.status", "eq", "F")),
            Segment("c", "customer", in_segment("o"))]
    with pytest.raises(RuleError):
        segments.materialize_all(retail, both, store)


def test_staleness(retail, store):
    pair = [Segment("base", "customer", EUROPE), Segment("top", "customer", in_segment("base"))]
    state = segments.materialize_all(retail, pair, store)
    day = retail.as_of
    assert segments.staleness(pair, state, day)["top"] == {"own": False, "data": False, "dependency": False}
    changed = Segment("base", "customer", RICH, version=2)
    assert segments.is_stale(changed, state) and not segments.is_stale(pair[1], state)
    assert segments.is_stale(Segment("base", "customer", EUROPE, 5), state)
    state = segments.materialize(retail, changed, store)
    why = segments.staleness([changed, pair[1]], state, date(2030, 1, 1))
    assert why["top"] == {"own": False, "data": True, "dependency": True}


def test_members_live_and_built(retail, store):
    europe = Segment("x", "customer", EUROPE, 30)
    live = segments.members(retail, europe, store, ["customer.key"], limit=None)
    assert live.columns == ["customer.key"] and keys(live) == keys(matching(retail, "customer", EUROPE))
    segments.materialize_all(retail, [europe], store)
    built = segments.members(retail, europe, store, ["customer.key"], limit=None)
    assert built.columns == ["customer.key", "group"] and keys(built) == keys(live)
    target = segments.members(retail, europe, store, ["customer.key"], limit=None, group="target")
    assert target.count() == store.state()["x"].target_count
    page = segments.members(retail, europe, store, ["customer.key"], limit=5, skip=3)
    assert [r[0] for r in page.collect()] == keys(live)[3:8]


def test_later_pages_are_cut_without_one_sorted_task(retail):
    whole = retail.tables["orders"].select("o_orderkey")
    page = segments.cut_page(whole, "o_orderkey", 20, segments.TOP_ROWS)
    assert page.count() == 0
    page = segments.cut_page(whole, "o_orderkey", None, 100)
    assert keys(page)[:20] == list(range(100, 120))
    assert "TakeOrdered" not in page._jdf.queryExecution().executedPlan().toString()


def test_export_leaves_out_the_control_group(spark, retail, store):
    europe = Segment("x", "customer", EUROPE, 30)
    state = segments.materialize_all(retail, [europe], store)
    path = work_path(spark, "csv")
    segments.export_csv(retail, europe, path, store, ["customer.key", "customer.name"])
    rows = spark.read.option("header", True).csv(path)
    assert rows.columns == ["customer.key", "customer.name", "group"]
    assert rows.count() == state["x"].target_count
    everyone = work_path(spark, "csv")
    segments.export_csv(retail, europe, everyone, store, ["customer.key"], group=None, max_rows=4)
    assert spark.read.option("header", True).csv(everyone).count() == 4


def test_overlap_needs_built_audiences(retail, store):
    with pytest.raises(LookupError):
        insights.overlap_of_built(store, ["x"])


def test_work_goes_to_the_shared_folder(spark):
    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_ids_that_look_like_numbers(spark, retail, store):
    named = [Segment("007", "customer", EUROPE), Segment("12", "customer", RICH)]
    segments.materialize_all(retail, named, store)
    here = sorted(map(tuple, insights.overlap_of_built(store, ["007", "12"]).collect()))
    again = sorted(map(tuple, insights.overlap_of_built(MembershipStore(spark, store.path), ["007", "12"]).collect()))
    assert here == again and all(row[2] > 0 for row in here)


def test_a_failed_write_leaves_the_old_members(retail, store, monkeypatch):
    before = segments.materialize_all(retail, [Segment("x", "customer", EUROPE)], store)
    old = keys(store.read("customer", ["x"]).select("member_key"))

    def broken(rows):
        raise OSError("no space left")

    monkeypatch.setattr(store, "put_state", broken)
    with pytest.raises(OSError):
        segments.materialize_all(retail, [Segment("x", "customer", RICH, version=2)], store)
    assert store.state() == before
    assert keys(store.read("customer", ["x"]).select("member_key")) == old


def test_pages_of_a_build_read_the_parts_they_lie_in(spark, retail, store):
    europe = Segment("x", "order", all_of(), 20)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        built = segments.materialize_all(retail, [europe], store)["x"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    rows = sorted((r.member_key, r.group) for r in store.read("order", ["x"]).collect())
    for group in (None, "target", "control"):
        chosen = [k for k, g in rows if group in (None, g)]
        for limit, skip in ((10, 0), (25, 400), (700, 300), (None, 900), (5, len(chosen) - 2), (5, 10 ** 7)):
            page = segments.members(retail, europe, store, ["order.key"], limit, skip, group)
            assert [r[0] for r in page.collect()] == chosen[skip:][:limit], (group, limit, skip)
    deep = store.page("order", "x", 10, len(rows) - 20)
    parts = spark.read.parquet(store._pages("order", built.build)).count()
    assert parts > 2
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "rangepartitioning" not in plan


def test_deep_pages(retail):
    everyone = Segment("all", "customer", all_of())
    key = sorted(r[0] for r in retail.tables["customer"].select("c_custkey").collect())
    for limit, skip in ((10, 0), (10, 17), (None, 140), (50, 10 ** 7)):
        page = [r[0] for r in segments.members(retail, everyone, None, ["customer.key"], limit, skip).collect()]
        assert page == key[skip:][:limit]


SIBLINGS = {
    "urgent": attribute("order.priority", "eq", "1-URGENT"),
    "three_orders": related("order", attribute("order.price", "gt", 100000), op="gte", n=3),
    "returned": attribute("line.flag", "eq", "R"),
    "many_lines": related("line", op="gte", n=40),
    "brand": attribute("part.brand", "eq", "Brand#13"),
    "supplier": attribute("supplier.balance", "gt", 0),
    "spent": metric("total_spend", "gt", 500000, window_months=24),
    "no_lines": related("line", attribute("line.flag", "eq", "R"), op="eq", n=0),
}


def test_sibling_paths_read_every_table_once(retail):
    together = flags(retail, "customer", SIBLINGS)
    got = {r["c_custkey"]: tuple(r[n] for n in SIBLINGS) for r in together.collect()}
    for at, (name, rule) in enumerate(SIBLINGS.items()):
        alone = {r["c_custkey"]: r[name] for r in flags(retail, "customer", {name: rule}).collect()}
        assert {k: v[at] for k, v in got.items()} == alone, name
        assert set(alone.values()) == {True, False} or name in ("no_lines", "returned", "supplier"), name
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    for table, column in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("supplier", "s_suppkey")):
        scans = [line for line in plan.splitlines() if "Relation [" in line and column in line]
        assert len(scans) == 1, (table, len(scans))


def test_a_repeated_row_below_an_own_row_counts_once_for_that_row(retail):
    """A part that is there twice counts twice by paths to parts, but not for the lines that point to it."""
    from dataclasses import replace
    tables = dict(retail.tables)
    tables["part"] = tables["part"].union(tables["part"])
    twice = replace(retail, tables=tables)
    rules = {"lines": related("line", op="gte", n=40), "brand": attribute("part.brand", "eq", "Brand#13")}
    one, two = ({r["c_custkey"]: (r["lines"], r["brand"]) for r in flags(c, "customer", rules).collect()}
                for c in (retail, twice))
    assert one == two
