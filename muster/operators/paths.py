"""Walking join paths from far to near, aggregating at every fan-out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.model import Catalog, Hop


@dataclass(frozen=True)
class State:
    """A value per target row and how two of them merge."""

    name: str
    row: Column
    merge: Callable[[Column], Column]


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge seen from both ends in one scan; a self-loop is seen once."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
        F.struct(F.col("dst").alias("a"), F.col("src").alias("b")),
    )
    ends = F.when(F.col("src") == F.col("dst"), F.slice(ends, 1, 1)).otherwise(ends)
    return edges.select(F.explode(ends).alias("__end"), *rest).select(
        F.col("__end.a").alias("src"), F.col("__end.b").alias("dst"), *rest)


def hop_table(catalog: Catalog, hop: Hop) -> DataFrame:
    table = catalog.tables[hop.table]
    return both_directions(table) if hop.both_ways else table


def split_path(path: Sequence[Hop]) -> tuple[tuple[Hop, ...], tuple[Hop, ...]]:
    """The leading N:1 hops, and the rest from the first fan-out on."""
    at = next((i for i, h in enumerate(path) if h.many), len(path))
    return tuple(path[:at]), tuple(path[at:])


def may_repeat(path: Sequence[Hop]) -> bool:
    """Whether one target row can be reached twice from the same start row."""
    _, rest = split_path(path)
    return any(not h.many or h.both_ways for h in rest)


def roll_up(catalog: Catalog, hops: Sequence[Hop], states: Sequence[State],
            by: Mapping[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Aggregate target rows per value of ``hops[0].right``, with bag semantics.

    Columns: ``__link``, the ``by`` columns, the states. Each fan-out is aggregated
    before the next join upwards, so a hot parent collapses on the map side and the
    join moves one row per parent instead of every target row.
    """
    by = dict(by or {})
    kept = [*by, *(s.name for s in states)]
    rows = hop_table(catalog, hops[-1])
    if where is not None:
        rows = rows.where(where)
    rows = rows.select(
        F.col(hops[-1].right).alias("__link"),
        *(c.alias(n) for n, c in by.items()),
        *(s.row.alias(s.name) for s in states),
    )
    for i in range(len(hops) - 1, -1, -1):
        if hops[i].many:
            grouped = rows.groupBy("__link", *by)
            merged = [s.merge(F.col(s.name)).alias(s.name) for s in states]
            rows = grouped.agg(*merged) if merged else rows.distinct()
        if i > 0:
            above = hop_table(catalog, hops[i - 1]).select(
                F.col(hops[i - 1].right).alias("__up"), F.col(hops[i].left).alias("__at"))
            rows = above.join(rows, F.col("__at") == F.col("__link")).select(
                F.col("__up").alias("__link"), *kept)
    return rows


@dataclass(frozen=True)
class Roll:
    """What is wanted of the rows at the end of a path, and which of them count; None for all."""

    states: Sequence[State]
    where: Column | None = None


def roll_up_all(catalog: Catalog, rolls: Mapping[tuple[Hop, ...], Roll]) -> DataFrame:
    """Aggregate the target rows of several paths that start with the same fan-out.

    The paths form a tree by their common hops. Each table of the tree is read once: its rows pick up
    what was aggregated below them and are aggregated together with it. A row without any rows below
    keeps nulls there, which no merge counts. Columns: ``__link`` and all states.
    """
    return _rolled_node(catalog, dict(rolls), 0, False)


def _rolled_node(catalog: Catalog, rolls: Mapping[tuple[Hop, ...], Roll], depth: int, once: bool) -> DataFrame:
    """The node that all paths share at ``depth``; ``once`` asks for one row per link even of an N:1 hop,
    where a repeated key would multiply rows that others count as well."""
    hop = next(iter(rolls))[depth]
    own = next((roll for path, roll in rolls.items() if len(path) == depth + 1), Roll(()))
    children: dict[Hop, dict[tuple[Hop, ...], Roll]] = {}
    for path, roll in rolls.items():
        if len(path) > depth + 1:
            children.setdefault(path[depth + 1], {})[path] = roll
    rows = hop_table(catalog, hop)
    if own.where is not None and not children:
        rows = rows.where(own.where)
    rows = rows.select(
        F.col(hop.right).alias("__link"), *(s.row.alias(s.name) for s in own.states),
        *(F.col(child.left).alias(f"__at{i}") for i, child in enumerate(children)))
    shared = bool(own.states) or len(children) > 1
    for i, below in enumerate(children.values()):
        side = _rolled_node(catalog, below, depth + 1, shared).withColumnRenamed("__link", f"__below{i}")
        rows = rows.join(side, F.col(f"__at{i}") == F.col(f"__below{i}"), "left" if shared else "inner")
    states = [s for roll in rolls.values() for s in roll.states]
    if hop.many or once:
        return rows.groupBy("__link").agg(*(s.merge(F.col(s.name)).alias(s.name) for s in states))
    return rows.select("__link", *(s.name for s in states))
