"""Counting, listing, building and exporting audiences."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone
from graphlib import CycleError, TopologicalSorter
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.columns import in_control
from muster.functions.ranking import global_row_number
from muster.model import Catalog, RuleError
from muster.operators.conditions import Condition, used_segments
from muster.operators.evaluate import Scope, flags, matching
from muster.sources.memberships import MembershipStore


@dataclass(frozen=True)
class Segment:
    segment_id: str
    anchor: str
    rule: Condition
    holdout_pct: float = 0
    version: int = 1

    def __post_init__(self) -> None:
        if not 0 <= self.holdout_pct <= 50:
            raise ValueError("holdout_pct must lie between 0 and 50")

    @property
    def depends_on(self) -> list[str]:
        return sorted(used_segments(self.rule))


#: Rows that one task may hold for a page of an audience that was never built; deeper ones are sorted.
TOP_ROWS = 10_000


class Preview(NamedTuple):
    counts: DataFrame
    sample: DataFrame


def counts(catalog: Catalog, anchor: str, rule: Condition, as_of: date | None = None,
           memberships: DataFrame | None = None) -> DataFrame:
    """Size of the audience and of the base, and the share, in one pass."""
    return sized(flags(catalog, anchor, {"in_segment": rule}, as_of, memberships))


def sized(flagged: DataFrame) -> DataFrame:
    """Audience and base size of rows that carry ``in_segment``."""
    both = flagged.agg(
        F.count(F.when(F.col("in_segment"), 1)).alias("segment_size"),
        F.count(F.lit(1)).alias("base_size"))
    return both.withColumn("share", F.when(
        F.col("base_size") > 0, F.col("segment_size") / F.col("base_size")).otherwise(0.0))


def cut_page(df: DataFrame, key: str, limit: int | None, skip: int = 0) -> DataFrame:
    """Rows ``skip+1 … skip+limit`` by key: a top-k near the start, else by global position."""
    if not skip and limit is None:
        return df
    if limit is not None and skip + limit <= TOP_ROWS:
        return df.orderBy(key).offset(skip).limit(limit)
    placed = global_row_number(df, [F.col(key)], "__place").where(F.col("__place") > skip)
    if limit is not None:
        placed = placed.where(F.col("__place") <= skip + limit)
    return placed.drop("__place")


def project(catalog: Catalog, anchor: str, keys: DataFrame, fields: Sequence[str],
            ordered: bool = True) -> DataFrame:
    """The wanted fields for ``keys`` (key column and any others), ordered by key unless told not to."""
    scope = Scope(catalog, anchor, base=keys)
    key = scope.key
    columns = {f: scope.field(f) for f in fields}
    others = [c for c in keys.columns if c != key]
    table = scope.table()
    return (table.orderBy(key) if ordered else table).select(
        *(c.alias(n) for n, c in columns.items()), *others)


def preview(catalog: Catalog, anchor: str, rule: Condition, k: int = 25,
            as_of: date | None = None, memberships: DataFrame | None = None) -> Preview:
    found = matching(catalog, anchor, rule, as_of, memberships)
    page = cut_page(found, catalog.entity(anchor).key, k)
    return Preview(counts(catalog, anchor, rule, as_of, memberships),
                   project(catalog, anchor, page, catalog.anchor(anchor).sample))


def members(catalog: Catalog, segment: Segment, store: MembershipStore | None = None,
            fields: Sequence[str] = (), limit: int | None = 100, skip: int = 0,
            group: str | None = None, ordered: bool = True) -> DataFrame:
    """A page of members by key: the built ones, or the live matches if never built.

    The ``group`` filter applies to built audiences only; a group column appears if
    the audience has control members.
    """
    fields = list(fields or catalog.anchor(segment.anchor).sample)
    key = catalog.entity(segment.anchor).key
    state = store.state() if store else {}
    built = state.get(segment.segment_id)
    if built is None:
        found = cut_page(live(catalog, segment, store, state), key, limit, skip)
    else:
        if limit is None and not skip:
            found = store.read(segment.anchor, [segment.segment_id], state)
        else:
            found = store.page(segment.anchor, segment.segment_id, limit, skip, group, state)
        known_group = F.coalesce("group", F.lit("target"))
        if group is not None:
            found = found.where(known_group == group)
        found = found.select(F.col("member_key").alias(key),
                             *([known_group.alias("group")] if built.control_count else []))
    return project(catalog, segment.anchor, found, fields, ordered)


def live(catalog: Catalog, segment: Segment, store: MembershipStore | None, state: dict) -> DataFrame:
    """Keys the rule selects now, reading the built members of segments it refers to."""
    return matching(catalog, segment.anchor, segment.rule, None,
                    _memberships(catalog, segment.anchor, store, segment.depends_on, state))


def export_csv(catalog: Catalog, segment: Segment, path: str, store: MembershipStore | None = None,
               fields: Sequence[str] = (), group: str | None = "target",
               max_rows: int | None = None) -> None:
    """Write members as CSV with a header, in no order. Control members stay out unless asked for."""
    found = members(catalog, segment, store, fields, max_rows, 0, group, ordered=False)
    found.write.mode("overwrite").option("header", True).csv(path)


def assign_holdout(df: DataFrame, key: str, segment_id: str, holdout_pct: float) -> DataFrame:
    """Add ``group``: the same members are held out on every run."""
    held = in_control(segment_id, F.col(key), holdout_pct)
    return df.withColumn("group", F.when(held, "control").otherwise("target"))


def is_stale(segment: Segment, state: dict) -> bool:
    """Never built, or its own rule version or holdout changed since."""
    built = state.get(segment.segment_id)
    return (built is None or built.version != segment.version
            or built.holdout_pct != segment.holdout_pct)


def staleness(segments: Iterable[Segment], state: dict, as_of: date) -> dict[str, dict[str, bool]]:
    """Why an audience may be out of date: itself, newer data, or a rebuilt dependency."""
    out = {}
    for s in segments:
        built = state.get(s.segment_id)
        deps = [state[d] for d in s.depends_on if d in state]
        out[s.segment_id] = {
            "own": is_stale(s, state),
            "data": built is not None and built.as_of != as_of,
            "dependency": built is not None and any(d.built_at > built.built_at for d in deps),
        }
    return out


def build_order(segments: Sequence[Segment]) -> list[list[Segment]]:
    """Groups of audiences that only depend on earlier groups."""
    by_id = {s.segment_id: s for s in segments}
    sorter = TopologicalSorter({s.segment_id: s.depends_on for s in segments})
    try:
        sorter.prepare()
    except CycleError as error:
        raise RuleError(f"audiences depend on each other: {error.args[1]}") from None
    steps = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        steps.append([by_id[i] for i in ready if i in by_id])
        sorter.done(*ready)
    return [s for s in steps if s]


def materialize(catalog: Catalog, segment: Segment, store: MembershipStore,
                others: Sequence[Segment] = (), as_of: date | None = None) -> dict:
    """Rebuild one audience, after those it depends on where they are stale."""
    needed, todo = {segment.segment_id: segment}, list(segment.depends_on)
    by_id = {s.segment_id: s for s in others}
    while todo:
        dep = todo.pop()
        if dep in by_id and dep not in needed:
            needed[dep] = by_id[dep]
            todo += by_id[dep].depends_on
    return materialize_all(catalog, list(needed.values()), store, as_of, {segment.segment_id})


def materialize_all(catalog: Catalog, segments: Sequence[Segment], store: MembershipStore,
                    as_of: date | None = None, always: Iterable[str] = ()) -> dict:
    """Rebuild every stale audience in dependency order and return the bookkeeping.

    Audiences that are ready together and share an anchor are evaluated in one pass over
    that anchor, so they also share its lookups and keyed tables.
    """
    state, always = store.state(), set(always)
    known = {s.segment_id for s in segments} | set(state)
    for s in segments:
        for dep in s.depends_on:
            if dep not in known:
                raise RuleError(f"{s.segment_id} refers to {dep}, which does not exist")
    for step in build_order(segments):
        due = [s for s in step if s.segment_id in always or is_stale(s, state)]
        for anchor in sorted({s.anchor for s in due}):
            mine = [s for s in due if s.anchor == anchor]
            state = {**state, **_build(catalog, anchor, mine, store, state, as_of)}
    return state


def _build(catalog: Catalog, anchor: str, due: list[Segment], store: MembershipStore,
           state: dict, as_of: date | None) -> dict:
    memberships = _memberships(
        catalog, anchor, store, {d for s in due for d in s.depends_on}, state)
    key = catalog.entity(anchor).key
    names = {f"__f{i}": s for i, s in enumerate(due)}
    flagged = flags(catalog, anchor, {n: s.rule for n, s in names.items()}, as_of, memberships)
    groups = [
        F.when(F.col(n), F.struct(
            F.lit(s.segment_id).alias("segment_id"),
            F.when(in_control(s.segment_id, F.col(key), s.holdout_pct), "control")
            .otherwise("target").alias("group")))
        for n, s in names.items()
    ]
    found = flagged.select(F.col(key).alias("member_key"), F.explode(
        F.filter(F.array(*groups), lambda g: g.isNotNull())).alias("m"))
    found = found.select("m.segment_id", "member_key", "m.group")
    build, key_type, written = store.write(anchor, found, [s.segment_id for s in due])
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = []
    for s in due:
        row = written.get(s.segment_id)
        n, held = (row.members, row.control) if row else (0, 0)
        rows.append((s.segment_id, anchor, s.version, float(s.holdout_pct),
                     as_of or catalog.as_of, now, n, n - held, held, build, key_type))
    return store.put_state(rows)


def _memberships(catalog: Catalog, anchor: str, store: MembershipStore | None,
                 ids: Iterable[str], state: dict) -> DataFrame | None:
    """Built members of the given audiences; an audience never built has none."""
    ids = list(ids)
    if not ids:
        return None
    for i in ids:
        if i in state and state[i].anchor != anchor:
            raise RuleError(f"segment {i!r} selects {state[i].anchor} rows, not {anchor}")
    built = [i for i in ids if i in state]
    if store and built:
        return store.read(anchor, built, state)
    base = catalog.tables[catalog.entity(anchor).table]
    none = base.where(F.lit(False))
    return none.select(F.lit("").alias("segment_id"),
                       F.col(catalog.entity(anchor).key).alias("member_key"),
                       F.lit("target").alias("group"))

