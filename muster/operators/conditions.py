"""The six kinds of condition an audience is made of.

Conditions are plain values: combine them with ``&``, ``|`` and ``~`` or with
``all_of`` / ``any_of``. They are turned into columns by ``Scope`` in
``muster.operators.evaluate``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Condition:
    negated: bool = False

    def __invert__(self) -> Condition:
        return replace(self, negated=not self.negated)

    def __and__(self, other: Condition) -> Condition:
        return all_of(self, other)

    def __or__(self, other: Condition) -> Condition:
        return any_of(self, other)


@dataclass(frozen=True, kw_only=True)
class AttributeIs(Condition):
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True, kw_only=True)
class MetricIs(Condition):
    metric: str
    op: str
    value: Any
    window_months: int | None = None


@dataclass(frozen=True, kw_only=True)
class RelatedCount(Condition):
    entity: str
    where: Condition | None = None
    op: str = "gte"
    n: int = 1


@dataclass(frozen=True)
class EdgeIs:
    attribute: str
    op: str
    value: Any = None


@dataclass(frozen=True, kw_only=True)
class NetworkCount(Condition):
    network: str
    where: Condition | None = None
    edge_where: tuple[EdgeIs, ...] = ()
    op: str = "gte"
    n: int = 1


@dataclass(frozen=True, kw_only=True)
class InSegment(Condition):
    segment_id: str


@dataclass(frozen=True, kw_only=True)
class Group(Condition):
    op: str = "and"
    children: tuple[Condition, ...] = ()


def attribute(field: str, op: str, value: Any = None) -> Condition:
    return AttributeIs(field=field, op=op, value=value)


def metric(name: str, op: str, value: Any, window_months: int | None = None) -> Condition:
    return MetricIs(metric=name, op=op, value=value, window_months=window_months)


def related(entity: str, where: Condition | None = None, op: str = "gte", n: int = 1) -> Condition:
    return RelatedCount(entity=entity, where=where, op=op, n=n)


def edge(name: str, op: str, value: Any = None) -> EdgeIs:
    return EdgeIs(name, op, value)


def network(name: str, where: Condition | None = None, edge_where: tuple[EdgeIs, ...] = (),
            op: str = "gte", n: int = 1) -> Condition:
    return NetworkCount(network=name, where=where, edge_where=tuple(edge_where), op=op, n=n)


def in_segment(segment_id: str) -> Condition:
    return InSegment(segment_id=segment_id)


def all_of(*children: Condition) -> Condition:
    return Group(op="and", children=children)


def any_of(*children: Condition) -> Condition:
    return Group(op="or", children=children)


def walk(rule: Condition) -> Iterator[Condition]:
    """The rule and every condition below it."""
    yield rule
    below = list(rule.children) if isinstance(rule, Group) else []
    if isinstance(rule, (RelatedCount, NetworkCount)) and rule.where is not None:
        below.append(rule.where)
    for child in below:
        yield from walk(child)


def used_segments(rule: Condition) -> set[str]:
    return {c.segment_id for c in walk(rule) if isinstance(c, InSegment)}


def direct_fields(rule: Condition) -> set[str]:
    """Fields the rule filters on itself, not inside a related or network filter."""
    if isinstance(rule, AttributeIs):
        return {rule.field}
    if isinstance(rule, Group):
        return set().union(*(direct_fields(c) for c in rule.children))
    return set()


def from_dict(rule: Mapping[str, Any]) -> Condition:
    """A saved rule (nested dicts tagged by ``kind``) as conditions."""
    where = from_dict(rule["where"]) if rule.get("where") else None
    count = {"op": rule.get("count_operator", "gte"), "n": rule.get("count_value", 1)}
    kind = rule["kind"]
    if kind == "group":
        made = Group(op=rule.get("op", "and"),
                     children=tuple(from_dict(c) for c in rule.get("children", ())))
    elif kind == "attribute":
        made = attribute(rule["field"], rule["operator"], rule.get("value"))
    elif kind == "metric":
        made = metric(rule["metric"], rule["operator"], rule.get("value"), rule.get("window_months"))
    elif kind == "related":
        made = related(rule["entity"], where, **count)
    elif kind == "network":
        edges = tuple(EdgeIs(e["attribute"], e["operator"], e.get("value"))
                      for e in rule.get("edge_where", ()))
        made = network(rule["network"], where, edges, **count)
    elif kind == "segment":
        made = in_segment(rule["segment_id"])
    else:
        raise ValueError(f"unknown kind of condition {kind!r}")
    return ~made if rule.get("negate") else made
