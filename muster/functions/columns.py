"""Column expressions shared by all operators; everything stays inside codegen."""

from __future__ import annotations

import operator
from collections.abc import Callable
from datetime import date
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from muster.model import OPERATORS, Attribute, RuleError, as_days, as_number, coerce

# 32-bit FNV-1a.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
FNV_MASK = 4294967295

NONE_LABEL = "(none)"


_ORDER = {"eq": operator.eq, "neq": operator.ne, "lt": operator.lt, "lte": operator.le,
          "gt": operator.gt, "gte": operator.ge}


def order_compare(op: str, left: Column, right: Any) -> Column:
    """One of the six comparisons as a column."""
    return _ORDER[op](left, right)


Reader = Callable[[Any], Any]
Builder = Callable[[Column, Reader, Any, "date | None"], Column]


def _ordered(op: str) -> Builder:
    return lambda col, read, value, _: order_compare(op, col, F.lit(read(value)))


def _inside(col: Column, read: Reader, value: Any, _: date | None) -> Column:
    if not isinstance(value, (list, tuple)) or len(value) != 2:
        raise ValueError("a range has two ends")
    return col.between(*[F.lit(read(v)) for v in value])


def _listed(col: Column, read: Reader, value: Any, _: date | None) -> Column:
    if not isinstance(value, (list, tuple)) or not len(value):
        raise ValueError("the list of values is empty")
    return col.isin(*map(read, value))


def _text(name: str) -> Builder:
    return lambda col, read, value, _: getattr(F.lower(col), name)(read(value).lower())


def _days(value: Any, as_of: date | None) -> Column:
    return F.date_sub(F.lit(as_of), as_days(value))


#: One builder per operator; comparisons are null where the column is, the null tests never are.
_BUILDERS: dict[str, Builder] = {
    **{op: _ordered(op) for op in _ORDER},
    "between": _inside,
    "in": _listed,
    "not_in": lambda col, read, value, as_of: ~_listed(col, read, value, as_of),
    "contains": _text("contains"), "starts_with": _text("startswith"), "ends_with": _text("endswith"),
    "within_last_days": lambda col, _, value, as_of: col.between(_days(value, as_of), F.lit(as_of)),
    "before_last_days": lambda col, _, value, as_of: col < _days(value, as_of),
    "is_null": lambda col, *_: col.isNull(),
    "is_not_null": lambda col, *_: col.isNotNull(),
}


def _build(op: str, col: Column, read: Reader, value: Any, as_of: date | None, path: str) -> Column:
    try:
        return _BUILDERS[op](col, read, value, as_of)
    except RuleError as error:
        raise RuleError(error.message, path) from None
    except ValueError as error:
        raise RuleError(str(error), path) from None


def compare_number(op: str, col: Column, value: Any, path: str = "rule") -> Column:
    """Compare a metric value; ``between`` includes both ends."""
    return _build(op, col, as_number, value, None, path)


def compare_attribute(col: Column, attribute: Attribute, op: str, value: Any, as_of: date | None,
                      path: str = "rule") -> Column:
    """One test of an attribute, with ``value`` read as the attribute's type demands."""
    if op not in OPERATORS[attribute.type]:
        raise RuleError(f"no {op!r} on {attribute.name}, which is of type {attribute.type}", path)
    return _build(op, col, lambda v: coerce(attribute, v), value, as_of, path)


def in_months(col: Column, as_of: date, months: int) -> Column:
    """Window open on the left: ``as_of - months < col <= as_of``."""
    return (col > F.add_months(F.lit(as_of), -months)) & (col <= F.lit(as_of))


def bucket_labels(edges: tuple[float, ...]) -> list[str]:
    text = [f"{e:g}" if e != int(e) else str(int(e)) for e in edges]
    inner = [f"{lo} – {hi}" for lo, hi in zip(text, text[1:])]
    return [f"< {text[0]}", *inner, f"≥ {text[-1]}"]


def bucket(col: Column, edges: tuple[float, ...]) -> Column:
    """Label of the half-open range holding ``col``; null stays null."""
    *lower, last = bucket_labels(edges)
    chain = F.when(col.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, lower):
        chain = chain.when(col < F.lit(edge), label)
    return chain.otherwise(last)


def value_text(col: Column, attribute: Attribute) -> Column:
    """The value as shown in a breakdown: bucket, month, or plain text."""
    if attribute.type == "number" and attribute.buckets:
        return bucket(col, attribute.buckets)
    if attribute.type == "date":
        return F.trunc(col, "month").cast("string")
    return col.cast("string")


def value_position(col: Column, attribute: Attribute) -> Column:
    """Rank of a shown value in bucket or enum order; values outside come last."""
    known = list(attribute.values)
    if attribute.type == "number" and attribute.buckets:
        known = bucket_labels(attribute.buckets)
    if not known:
        return F.lit(0)
    place = F.array_position(F.array(*[F.lit(v) for v in known]), col)
    return F.when(place > 0, place - 1).otherwise(len(known)).cast("int")


def fnv1a32(col: Column, start: int = FNV_OFFSET) -> Column:
    """FNV-1a of the UTF-8 bytes of ``col``, continuing from ``start``."""
    # Read as Latin-1, every byte is one character whose code is the byte.
    octets = F.split(F.decode(F.encode(col, "utf-8"), "iso-8859-1"), "")
    first = F.lit(start).cast("bigint")
    value = F.aggregate(
        octets, first,
        lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("bigint")) * F.lit(FNV_PRIME).cast("bigint"))
        .bitwiseAND(F.lit(FNV_MASK).cast("bigint")),
    )
    return F.when(F.octet_length(col) == 0, first).otherwise(value)


def fnv1a32_text(text: str) -> int:
    """The same hash for one driver-side string."""
    value = FNV_OFFSET
    for octet in text.encode("utf-8"):
        value = (value ^ octet) * FNV_PRIME & FNV_MASK
    return value


def in_control(segment_id: str, key: Column, holdout_pct: float) -> Column:
    """Whether a member belongs to the control group of ``segment_id``.

    The hash covers ``segment_id:key``; the constant first part is hashed once here.
    """
    if not 0 <= holdout_pct <= 50:
        raise ValueError("holdout_pct must lie between 0 and 50")
    threshold = round(holdout_pct * 10000 / 100)
    if threshold == 0:
        return F.lit(False)
    start = fnv1a32_text(f"{segment_id}:")
    return fnv1a32(key.cast("string"), start) % 10000 < threshold
