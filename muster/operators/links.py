"""User-made links between accounts, applied as batches.

``links(src, dst, link_type, source)`` holds one row per unordered pair, and ``created_at`` where the
links or what is applied to them tell when a link was made.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.ranking import aggregate_apart

# Fixed value: how a link made by a user is marked.
USER = "user"


class Linked(NamedTuple):
    links: DataFrame
    rejected: DataFrame


class Unlinked(NamedTuple):
    links: DataFrame
    removed: DataFrame
    missing: DataFrame


def _ends(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return df.withColumns({"__low": F.least(a, b), "__high": F.greatest(a, b)})


def _checked(pairs: DataFrame, accounts: DataFrame, key: str, types: Sequence[str]) -> DataFrame:
    """Pairs with ``reason``: null where the link may be made."""
    known = accounts.select(F.col(key).alias("__account"), F.lit(True).alias("__known")).distinct()
    out = pairs
    for end in ("a", "b"):
        side = known.withColumnsRenamed({"__account": f"__{end}", "__known": f"__known_{end}"})
        out = out.join(side, F.col(end) == F.col(f"__{end}"), "left").drop(f"__{end}")
    reason = (
        F.when(~F.coalesce(F.col("link_type").isin(list(types)), F.lit(False)), "unknown type")
        .when(F.col("a") == F.col("b"), "self link")
        .when(F.col("__known_a").isNull() | F.col("__known_b").isNull(), "unknown account")
    )
    return out.withColumn("reason", reason).drop("__known_a", "__known_b")


def link(links: DataFrame, pairs: DataFrame, accounts: DataFrame, key: str,
         types: Sequence[str]) -> Linked:
    """Link ``pairs(seq, a, b, link_type)``; a pair linked before only changes its type.

    A pair keeps the direction it was first linked in. The last type per pair wins, and with it
    the time if ``pairs`` has one (``at``). Self links, unknown types and unknown accounts come back with a reason.
    """
    checked = _checked(pairs, accounts, key, types)
    fresh = _latest(_ends(checked.where(F.col("reason").isNull())))
    return Linked(_merged(links, fresh), checked.where(F.col("reason").isNotNull()))


def _latest(wanted: DataFrame) -> DataFrame:
    """Per pair the first direction, the last type and, if known, its time."""
    timed = [F.max_by("at", "seq").alias("__at")] if "at" in wanted.columns else []
    return aggregate_apart(wanted, ["__low", "__high"], F.min_by(F.struct("a", "b"), "seq").alias("__first"),
                           F.max_by("link_type", "seq").alias("__type"), *timed)


def _merged(links: DataFrame, fresh: DataFrame) -> DataFrame:
    """Links with the pairs of ``fresh`` added, or their type and time replaced."""
    old = _ends(links, "src", "dst")
    merged = old.join(fresh, ["__low", "__high"], "full_outer")
    made = F.col("__type").isNotNull()
    times = [F.col(c) for c in ("__at", "created_at") if c in merged.columns]
    timed = [F.when(made, times[0]).otherwise(times[-1] if "created_at" in old.columns else None)
             .alias("created_at")] if times else []
    return merged.select(
        F.coalesce("src", "__first.a").alias("src"),
        F.coalesce("dst", "__first.b").alias("dst"),
        F.coalesce("__type", "link_type").alias("link_type"),
        F.when(made, USER).otherwise(F.col("source")).alias("source"), *timed)


def star_pairs(groups: DataFrame) -> DataFrame:
    """``groups(seq, accounts, link_type)`` to pairs of the first account with each other one."""
    first = F.element_at("accounts", 1)
    others = F.array_distinct("accounts")
    return (
        groups.where(F.size(others) >= 2)
        .select("seq", "link_type", first.alias("a"), F.posexplode(others).alias("place", "b"))
        .where(F.col("place") > 0)
        .select(F.struct("seq", "place").alias("seq"), "a", "b", "link_type")
    )


def link_group(links: DataFrame, groups: DataFrame, accounts: DataFrame, key: str,
               types: Sequence[str]) -> Linked:
    """Link every account of a group to its first; a group needs two different accounts."""
    done = link(links, star_pairs(groups), accounts, key, types)
    short = groups.where(F.size(F.array_distinct("accounts")) < 2).select(
        F.struct("seq", F.lit(0).alias("place")).alias("seq"),
        F.element_at("accounts", 1).alias("a"),
        F.element_at("accounts", 1).alias("b"),
        "link_type", F.lit("fewer than two accounts").alias("reason"))
    return Linked(done.links, done.rejected.unionByName(short))


def unlink(links: DataFrame, pairs: DataFrame) -> Unlinked:
    """Remove links in either direction; pairs without a link are reported."""
    wanted = _ends(pairs).select("__low", "__high").distinct()
    have = _ends(links, "src", "dst")
    ends = ["__low", "__high"]
    removed = have.join(wanted, ends, "left_semi").drop(*ends)
    kept = have.join(wanted, ends, "left_anti").drop(*ends)
    missing = wanted.join(have, ends, "left_anti").select(
        F.col("__low").alias("a"), F.col("__high").alias("b"))
    return Unlinked(kept, removed, missing)


def apply_link_log(links: DataFrame, ops: DataFrame, accounts: DataFrame, key: str,
                   types: Sequence[str]) -> Linked:
    """Replay ``ops(seq, action, a, b, link_type)`` (``link`` / ``unlink``) in order of ``seq``.

    A link that could not be made directly is skipped and comes back with its reason. Of a pair's
    others only those after its last unlink matter: the last type wins, with its time (``at``), and
    the direction is that of the surviving link, else of the first operation after the unlink.
    """
    ends = ["__low", "__high"]
    cleared = aggregate_apart(_ends(ops.where(F.col("action") == "unlink")), ends,
                              F.max("seq").alias("__cleared"))
    checked = _checked(ops.where(F.col("action") == "link"), accounts, key, types)
    after = _ends(checked.where(F.col("reason").isNull())).join(cleared, ends, "left").where(
        F.col("__cleared").isNull() | (F.col("seq") > F.col("__cleared")))
    kept = _ends(links, "src", "dst").join(cleared, ends, "left_anti").drop(*ends)
    return Linked(_merged(kept, _latest(after)), checked.where(F.col("reason").isNotNull()))
