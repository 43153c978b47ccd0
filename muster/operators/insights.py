"""Comparing an audience with its base."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from datetime import date
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muster.functions.columns import NONE_LABEL, value_position, value_text
from muster.functions.ranking import distinct_apart, top_per_group
from muster.model import Catalog, RuleError
from muster.operators.conditions import AttributeIs, Condition, Group, direct_fields, walk
from muster.operators.evaluate import Scope, flags
from muster.operators.paths import State, both_directions, hop_table, may_repeat, roll_up, split_path
from muster.operators.segments import counts, sized
from muster.sources.memberships import MembershipStore
from muster.session import cut_lineage

# How much a report shows.
TOP_VALUES = 60
TOP_RELATED = 24
TOP_NEIGHBOURS = 25
TOP_SUGGESTIONS = 50
DRIVER_OVER_INDEX, DRIVER_UNDER_INDEX = 120, 80
DRIVER_MIN_SHARE = 0.05
DRIVERS_OVER, DRIVERS_UNDER = 6, 4
TREND_EXTRA_DAYS = 31

ALL = ""


class Profile(NamedTuple):
    counts: DataFrame
    kpis: DataFrame
    dimensions: DataFrame


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _sized(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.when(F.col("in_segment"), 1)).alias("segment"),
        F.count(F.lit(1)).alias("base"))


def _opened(catalog: Catalog, anchor: str, rule: Condition, as_of: date | None,
            memberships: DataFrame | None, flagged: DataFrame | None) -> tuple[Scope, Column]:
    """A scope and the membership flag, evaluated here or taken from ``flagged``."""
    if flagged is not None:
        return Scope(catalog, anchor, as_of, memberships, flagged), F.col("in_segment")
    scope = Scope(catalog, anchor, as_of, memberships)
    return scope, F.coalesce(scope.predicate(rule), F.lit(False)).alias("in_segment")


def breakdown(catalog: Catalog, anchor: str, rule: Condition, fields: Sequence[str],
              as_of: date | None = None, memberships: DataFrame | None = None,
              top: int = TOP_VALUES, flagged: DataFrame | None = None) -> DataFrame:
    """Per field and value: distinct anchors in the audience and the base, shares, index.

    All single-valued fields come from one pass over the anchors; a field behind a fan-out
    is first reduced to one row per anchor and value. The totals travel as one more group.
    ``flagged(key, in_segment)`` saves evaluating the rule for every pass.
    """
    known = {f: catalog.resolve(f) for f in fields}
    many = [f for f in fields if catalog.is_multi_valued(anchor, known[f][0].name)]
    scope, flag = _opened(catalog, anchor, rule, as_of, memberships, flagged)
    pairs = [_pair(ALL, F.lit(""))]
    for f in fields:
        if f not in many:
            pairs.append(_pair(f, value_text(scope.field(f), known[f][1])))
    long = scope.table().select(flag, F.explode(F.array(*pairs)).alias("p"))
    parts = [_sized(long.select("in_segment", "p.field", "p.value"), "field", "value")]
    for f in many:
        parts.append(_spread(catalog, anchor, rule, f, as_of, memberships, flagged))
    # One total row and at most `top` rows per field remain, so the window below is small.
    rows = top_per_group(reduce(DataFrame.unionByName, parts), ["field"],
                         [F.desc("base"), F.asc("value")], top)
    total = F.max(F.when(F.col("field") == ALL, F.struct("segment", "base"))).over(
        W.partitionBy(F.lit(1)))
    rows = rows.withColumn("total", total).where(F.col("field") != ALL)
    seg_pct = _ratio(F.col("segment"), F.col("total.segment"))
    base_pct = _ratio(F.col("base"), F.col("total.base"))
    rows = rows.withColumns({"segment_pct": seg_pct, "base_pct": base_pct})
    index = F.when(F.col("base_pct") > 0, F.bround(
        F.lit(100) * F.col("segment_pct") / F.col("base_pct"), 0).cast("long"))
    place = _per_field(fields, lambda f: value_position(F.col("value"), known[f][1]))
    nth = _per_field(fields, lambda f: F.lit(list(fields).index(f)))
    multi = F.col("field").isin(many) if many else F.lit(False)
    return (
        rows.withColumns({"index": index, "multi_valued": multi, "position": place})
        .orderBy(nth, "position", F.desc("base"), "value")
        .select("field", "value", "segment", "base", "segment_pct", "base_pct", "index",
                "multi_valued", "position")
    )


def _pair(field: str, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), F.coalesce(value, F.lit(NONE_LABEL)).alias("value"))


def _per_field(fields: Sequence[str], make) -> Column:
    chain = F
    for f in fields:
        chain = chain.when(F.col("field") == f, make(f))
    return chain if chain is not F else F.lit(0)


def _spread(catalog: Catalog, anchor: str, rule: Condition, field: str, as_of: date | None,
            memberships: DataFrame | None, flagged: DataFrame | None) -> DataFrame:
    entity, attribute = catalog.resolve(field)
    scope, flag = _opened(catalog, anchor, rule, as_of, memberships, flagged)
    prefix, rest = split_path(catalog.path(anchor, entity.name))
    link = scope.link(prefix, rest[0].left)
    text = F.coalesce(value_text(F.col(attribute.source), attribute), F.lit(NONE_LABEL))
    values = roll_up(catalog, rest, [], by={"value": text})
    anchors = scope.table().select(flag, F.col(link).alias("__at"))
    rows = anchors.join(values, F.col("__at") == F.col("__link"), "left")
    rows = rows.select("in_segment", F.lit(field).alias("field"),
                       F.coalesce("value", F.lit(NONE_LABEL)).alias("value"))
    return _sized(rows, "field", "value")


def kpis(catalog: Catalog, anchor: str, rule: Condition, as_of: date | None = None,
         memberships: DataFrame | None = None, flagged: DataFrame | None = None) -> DataFrame:
    """Average of each KPI in the audience and the base, and the lift."""
    wanted = catalog.anchor(anchor).kpis
    scope, flag = _opened(catalog, anchor, rule, as_of, memberships, flagged)
    values = [
        (scope.field(k.field) if k.field else scope.metric(k.metric, k.window_months)).alias(f"k{i}")
        for i, k in enumerate(wanted)
    ]
    one = scope.table().select(flag, *values).agg(F.array(*(
        F.struct(F.lit(k.name).alias("kpi"),
                 F.avg(F.when(F.col("in_segment"), F.col(f"k{i}"))).alias("segment"),
                 F.avg(f"k{i}").alias("base"))
        for i, k in enumerate(wanted))).alias("rows"))
    lift = F.when(F.col("base") != 0, F.col("segment") / F.col("base"))
    return one.select(F.inline("rows")).withColumn("lift", lift)


def profile(catalog: Catalog, anchor: str, rule: Condition, fields: Sequence[str] = (),
            as_of: date | None = None, memberships: DataFrame | None = None) -> Profile:
    """Counts, KPIs and every profile dimension of the anchor.

    A rule that needs aggregates or edges is evaluated once and kept as one flag per
    anchor, because each part of the profile passes over the anchors again.
    """
    fields = list(fields or catalog.anchor(anchor).profile)
    flagged = None
    if not all(isinstance(c, (Group, AttributeIs)) for c in walk(rule)):
        flagged = cut_lineage(flags(catalog, anchor, {"in_segment": rule}, as_of, memberships))
    sizes = counts(catalog, anchor, rule, as_of, memberships) if flagged is None else sized(flagged)
    return Profile(sizes,
                   kpis(catalog, anchor, rule, as_of, memberships, flagged),
                   breakdown(catalog, anchor, rule, fields, as_of, memberships, flagged=flagged))


def funnel(catalog: Catalog, anchor: str, rule: Condition, as_of: date | None = None,
           memberships: DataFrame | None = None, delta: bool = False) -> DataFrame:
    """How each top-level condition narrows (and) or widens (or) the audience.

    A negated or single condition is one step; a rule without conditions has no steps.
    """
    steps, op = (rule,), "and"
    if isinstance(rule, Group) and not rule.negated:
        steps, op = rule.children, rule.op
    named = {f"c{i}": c for i, c in enumerate(steps)}
    flagged = flags(catalog, anchor, named, as_of, memberships)
    join = (lambda a, b: a & b) if op == "and" else (lambda a, b: a | b)
    rows = []
    for i in range(len(steps)):
        so_far = reduce(join, [F.col(f"c{j}") for j in range(i + 1)])
        rows.append(F.struct(F.lit(i).alias("step"),
                             F.count(F.when(F.col(f"c{i}"), 1)).alias("alone"),
                             F.count(F.when(so_far, 1)).alias("cumulative")))
    made = F.array(*rows) if rows else F.expr(
        "cast(array() as array<struct<step:int,alone:bigint,cumulative:bigint>>)")
    one = flagged.agg(F.count(F.lit(1)).alias("base"), made.alias("rows"))
    out = one.select("base", F.inline("rows"))
    if delta:
        start = F.col("base") if op == "and" else F.lit(0)
        # One row per condition of the rule.
        before = F.coalesce(F.lag("cumulative").over(W.partitionBy(F.lit(1)).orderBy("step")), start)
        out = out.withColumn("delta", F.col("cumulative") - before)
    return out


def trend(catalog: Catalog, anchor: str, metric: str, rule: Condition, months: int = 6,
          as_of: date | None = None, memberships: DataFrame | None = None) -> DataFrame:
    """Per month, the members' monthly total averaged over those with rows that month."""
    m = catalog.metric(metric)
    if not m.time_column:
        raise RuleError(f"{metric} has no date to follow", "metric")
    path = catalog.path(anchor, m.entity)
    if not path:
        raise RuleError(f"{metric} is not available for {anchor}", "metric")
    scope = Scope(catalog, anchor, as_of, memberships)
    flag = F.coalesce(scope.predicate(rule), F.lit(False)).alias("in_segment")
    today = F.lit(m.as_of or scope.as_of)
    prefix, rest = split_path(path)

    def shown(day: Column) -> Column:
        return ((day > F.add_months(today, -months)) & (day <= F.date_add(today, TREND_EXTRA_DAYS))
                & (F.trunc(day, "month") <= today))

    if rest:
        day, value = F.col(m.time_column), F.lit(1) if m.aggregate == "count" else F.col(m.column)
        monthly = roll_up(catalog, rest, [State("v", value, F.sum)], by={"month": F.trunc(day, "month")},
                          where=shown(day))
        link = scope.link(prefix, rest[0].left)
        rows = scope.table().select(flag, F.col(link).alias("__at")).join(
            monthly, F.col("__at") == F.col("__link"))
    else:  # one row of a parent at most: its own month and value
        there, day = (F.col(scope.link(prefix, c)) for c in (prefix[-1].right, m.time_column))
        value = F.lit(1) if m.aggregate == "count" else F.col(scope.link(prefix, m.column))
        rows = scope.table().where(there.isNotNull() & shown(day)).select(
            flag, F.trunc(day, "month").alias("month"), value.alias("v"))
    v, inside = F.coalesce("v", F.lit(0)), F.col("in_segment")
    return (
        rows.groupBy(F.col("month").cast("string").alias("month"))
        .agg(F.avg(F.when(inside, v)).alias("segment"), F.avg(v).alias("base"),
             F.count(F.when(inside, 1)).alias("segment_n"), F.count(F.lit(1)).alias("base_n"))
        .orderBy("month")
    )


def overlap(memberships: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Common members, Jaccard and row containment for every pair of audiences.

    Members are first grouped by the set of audiences they are in; only those few sets,
    with their counts, are expanded to pairs.
    """
    key = [c for c in ("anchor", "member_key") if c in memberships.columns]
    sets = (
        memberships.where(F.col("segment_id").isin(list(ids)))
        .groupBy(*key).agg(F.sort_array(F.collect_set("segment_id")).alias("ids"))
        .groupBy("ids").agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = (
        sets.select("ids", "n", F.explode("ids").alias("a"))
        .select("a", "n", F.explode("ids").alias("b"))
        .groupBy("a", "b").agg(F.sum("n").alias("n"))
    )
    sizes = pairs.where("a = b").select("a", F.col("n").alias("size"))
    listed = F.array(*(F.lit(i) for i in ids))
    grid = memberships.sparkSession.range(1).select(F.explode(listed).alias("a")).select(
        "a", F.explode(listed).alias("b"))
    cells = (
        grid.join(pairs, ["a", "b"], "left")
        .join(sizes.withColumnRenamed("size", "size_a"), "a", "left")
        .join(sizes.withColumnsRenamed({"a": "b", "size": "size_b"}), "b", "left")
        .na.fill(0, ["n", "size_a", "size_b"])
    )
    either = F.col("size_a") + F.col("size_b") - F.col("n")
    return cells.select(
        "a", "b", F.col("n").alias("common"),
        _ratio(F.col("n"), either).alias("jaccard"),
        _ratio(F.col("n"), F.col("size_a")).alias("containment"))


def overlap_of_built(store: MembershipStore, ids: Sequence[str]) -> DataFrame:
    """``overlap`` of saved audiences; each must have been built."""
    state = store.state()
    missing = [i for i in ids if i not in state]
    if missing:
        raise LookupError(f"build these audiences first: {', '.join(missing)}")
    parts = []
    for anchor in sorted({state[i].anchor for i in ids}):
        found = store.read(anchor, [i for i in ids if state[i].anchor == anchor], state)
        parts.append(found.select("segment_id", F.lit(anchor).alias("anchor"),
                                  F.col("member_key").cast("string").alias("member_key")))
    return overlap(reduce(DataFrame.unionByName, parts), ids)


def drivers(dimensions: DataFrame, exclude: Collection[str] = (),
            min_share: float = DRIVER_MIN_SHARE) -> DataFrame:
    """The values that set the audience apart most, from the rows of ``breakdown``."""
    rows = dimensions.where(F.col("index").isNotNull() & (F.col("value") != NONE_LABEL))
    if exclude:
        rows = rows.where(~F.col("field").isin(list(exclude)))
    over = (F.col("index") >= DRIVER_OVER_INDEX) & (F.col("segment_pct") >= min_share)
    under = (F.col("index") <= DRIVER_UNDER_INDEX) & (F.col("base_pct") >= min_share)
    strength = F.abs(F.log2(F.greatest(F.col("index"), F.lit(1)) / 100)) * F.sqrt(
        F.greatest("segment_pct", "base_pct"))
    rows = rows.withColumns({
        "direction": F.when(over, "over").when(under, "under"), "strength": strength,
    }).where(F.col("direction").isNotNull())
    ranked = top_per_group(rows, ["direction"], [F.desc("strength"), F.asc("field"), F.asc("value")],
                           DRIVERS_OVER)
    kept = ranked.where((F.col("direction") == "over") | (F.col("rank") <= DRIVERS_UNDER))
    return kept.select("direction", "rank", "field", "value", "segment_pct", "base_pct", "index",
                       "strength").orderBy("direction", "rank")


def rule_drivers(catalog: Catalog, anchor: str, rule: Condition, fields: Sequence[str] = (),
                 as_of: date | None = None, memberships: DataFrame | None = None) -> DataFrame:
    """Drivers of a rule, leaving out the fields it filters on itself."""
    fields = [f for f in fields or catalog.anchor(anchor).profile if f not in direct_fields(rule)]
    return drivers(breakdown(catalog, anchor, rule, fields, as_of, memberships))


class Walks:
    """The ways from some anchors to all related entities, each shared stretch walked once.

    A stretch keeps the anchor's key and the columns that the next steps join by. One that several
    ways go on from is written to the shared folder, so the tables on it are read once.
    """

    def __init__(self, catalog: Catalog, anchor: str, wanted: DataFrame, entities: Sequence[str]):
        self.catalog, self.own, self.wanted = catalog, catalog.entity(anchor), wanted
        self.next: dict[tuple, set[str]] = {}
        self.ways: dict[tuple, int] = {}
        for name in entities:
            hops = tuple(catalog.path(anchor, name))
            for i, hop in enumerate(hops):
                self.next.setdefault(hops[:i], set()).add(hop.left)
                self.ways[hops[:i]] = self.ways.get(hops[:i], 0) + 1
        self.walked: dict[tuple, DataFrame] = {}

    def at(self, hops: tuple) -> DataFrame:
        """``__key`` and, under their own names after ``__``, the columns to go on by."""
        if hops not in self.walked:
            columns = sorted(self.next[hops])
            if not hops:
                table = self.catalog.tables[self.own.table].join(self.wanted, self.own.key, "left_semi")
                rows = table.select(F.col(self.own.key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns))
            else:
                rows = self.step(hops, columns).select("__key", *(F.col(c).alias(f"__{c}") for c in columns))
                if self.ways[hops] > 1:
                    rows = cut_lineage(rows)
            self.walked[hops] = rows
        return self.walked[hops]

    def step(self, hops: tuple, columns: Sequence[str]) -> DataFrame:
        """``__key`` and ``columns`` of the table at the end of the way."""
        hop = hops[-1]
        side = hop_table(self.catalog, hop).select(F.col(hop.right).alias("__right"), *columns)
        return self.at(hops[:-1]).join(side, F.col(f"__{hop.left}") == F.col("__right")).select("__key", *columns)


def related_rows(catalog: Catalog, anchor: str, keys: DataFrame, entity_name: str,
                 k: int = TOP_RELATED, walks: Walks | None = None) -> DataFrame:
    """Up to ``k`` distinct related rows per key, the latest first.

    Where a row may be reached repeatedly, keys and dates are walked and trimmed first and the attributes
    fetched for the rows kept; elsewhere they come along, as the table is on the way anyhow. Rows
    of an entity without a key are told apart by all their attributes, so two equal ones count once.
    """
    entity, own = catalog.entity(entity_name), catalog.entity(anchor)
    hops = tuple(catalog.path(anchor, entity_name))
    walks = walks or Walks(catalog, anchor, keys.select(own.key).distinct(), [entity_name])
    shown = [a.source for a in entity.attributes]
    dated = next((a.source for a in entity.attributes if a.type == "date"), None)
    order = [F.col(dated).desc_nulls_last()] if dated else []
    if not entity.key:
        # Equal rows share a rank, so they need not be found before the rows of a key meet.
        rows = walks.step(hops, shown)
        place = F.dense_rank().over(W.partitionBy("__key").orderBy(*order, *(F.col(c) for c in shown if c != dated)))
        return rows.withColumn("rank", place).where(F.col("rank") <= k).distinct()
    if entity.key not in shown:
        shown.insert(0, entity.key)
    if not may_repeat(hops):
        return top_per_group(walks.step(hops, shown), ["__key"], order + [F.col(entity.key)], k)
    rows = walks.step(hops, list(dict.fromkeys(c for c in (entity.key, dated) if c)))
    top = top_per_group(distinct_apart(rows), ["__key"], order + [F.col(entity.key)], k)
    rest = catalog.tables[entity.table].select(F.col(entity.key).alias("__id"), *(c for c in shown if c != entity.key))
    kept = top.select("__key", F.col(entity.key).alias("__kept"), "rank")
    full = kept.join(rest, F.col("__kept") == F.col("__id"))
    return full.select("__key", *(F.col("__kept").alias(c) if c == entity.key else c for c in shown), "rank")


def neighbour_rows(catalog: Catalog, anchor: str, keys: DataFrame, network_name: str,
                   k: int = TOP_NEIGHBOURS) -> DataFrame:
    """Up to ``k`` neighbours per key by the first edge attribute, with edge and own columns."""
    net, own = catalog.network(network_name), catalog.entity(anchor)
    edges = catalog.tables[net.table]
    if net.direction == "in":
        rest = [c for c in edges.columns if c not in ("src", "dst")]
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    elif net.direction == "both":
        edges = both_directions(edges)
    attributes = [a.source for a in net.attributes]
    wanted = keys.select(F.col(own.key).alias("src")).distinct()
    near = edges.join(wanted, "src", "left_semi").select("src", "dst", *attributes)
    order = [F.col(c).desc_nulls_last() for c in attributes[:1]] + [F.col("dst")]
    top = top_per_group(near, ["src"], order, k)
    other = catalog.tables[own.table].withColumnRenamed(own.key, "dst")
    edge = F.struct(*attributes).alias("edge") if attributes else F.lit(None).alias("edge")
    return top.select(F.col("src").alias("__key"), "dst", "rank", edge).join(other, "dst")


def member_360(catalog: Catalog, anchor: str, keys: DataFrame,
               memberships: DataFrame | None = None) -> DataFrame:
    """Everything known about the given members, one row each.

    ``own`` is the anchor row; every reachable entity and every network becomes an
    array of at most a few dozen structs, best first.
    """
    own = catalog.entity(anchor)
    wanted = cut_lineage(keys.select(own.key).distinct())
    table = catalog.tables[own.table]
    near = [e.name for e in catalog.entities if catalog.path(anchor, e.name)]
    walks = Walks(catalog, anchor, wanted, near)
    out = table.join(wanted, own.key, "left_semi").select(
        own.key, F.struct(*(F.col(c) for c in table.columns)).alias("own"))
    for name in near:
        out = _attach_list(out, own.key, related_rows(catalog, anchor, wanted, name, walks=walks), name)
    for net in catalog.networks:
        if net.anchor == anchor:
            rows = neighbour_rows(catalog, anchor, wanted, net.name)
            out = _attach_list(out, own.key, rows, net.name)
    if memberships is not None:
        rows = memberships.join(wanted.withColumnRenamed(own.key, "member_key"), "member_key",
                                "left_semi")
        joined = rows.groupBy(F.col("member_key").alias("__key")).agg(
            F.sort_array(F.collect_set("segment_id")).alias("segments"))
        out = out.join(joined, F.col(own.key) == F.col("__key"), "left").drop("__key")
    return out


def _attach_list(out: DataFrame, key: str, rows: DataFrame, name: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("__key", "rank")]
    listed = rows.groupBy("__key").agg(
        F.sort_array(F.collect_list(F.struct("rank", *rest))).alias(name))
    return out.join(listed, F.col(key) == F.col("__key"), "left").drop("__key")


def field_values(catalog: Catalog, field: str, prefix: str = "",
                 limit: int = TOP_SUGGESTIONS) -> DataFrame:
    """Suggestions for a text field: the most frequent values starting with ``prefix``."""
    entity, attribute = catalog.resolve(field)
    table = catalog.tables[entity.table]
    if attribute.values:
        listed = F.array(*(F.lit(v) for v in attribute.values))
        return table.sparkSession.range(1).select(F.explode(listed).alias("value"))
    if attribute.type != "string":
        raise RuleError(f"{field} is not a text field", "field")
    value = F.col(attribute.source).alias("value")
    rows = table.select(value).where(F.lower("value").startswith(prefix.lower()))
    return (rows.groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), "value").limit(limit))
