"""Reading and loading keyed tables and edge tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.ranking import aggregate_apart


def read_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def as_of_date(df: DataFrame, column: str) -> date | None:
    """Latest date of a column: one aggregate, one value."""
    return df.agg(F.max(F.col(column)).cast("date")).first()[0]


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the largest ``order`` per key, combined on the map side."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    newest = F.max_by(F.struct(*rest), F.col(order)).alias("__row")
    return rows.groupBy(*keys).agg(newest).select(*keys, *(f"__row.{c}" for c in rest))


def upsert(target: DataFrame, rows: DataFrame, key: str, order: str,
           columns: Sequence[str] | None = None) -> DataFrame:
    """Merge ``rows`` into ``target`` by key.

    The latest row per key (by ``order``) overwrites the listed columns, nulls included;
    unlisted columns keep their value, and new keys are added.
    """
    columns = list(columns or [c for c in rows.columns if c not in (key, order)])
    fresh = latest_per_key(rows.select(key, order, *columns), [key], order)
    fresh = fresh.select(F.col(key).alias("__key"), F.lit(True).alias("__new"),
                         *(F.col(c).alias(f"__{c}") for c in columns))
    merged = target.join(fresh, F.col(key) == F.col("__key"), "full_outer")
    out = []
    for c in target.columns:
        if c == key:
            out.append(F.coalesce(key, "__key").alias(key))
        elif c in columns:
            out.append(F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    out += [F.col(f"__{c}").alias(c) for c in columns if c not in target.columns]
    return merged.select(*out)


def load_edges(edges: DataFrame, sources: DataFrame, source_key: str, targets: DataFrame,
               target_key: str, order: str | None = None, undirected: bool = False) -> DataFrame:
    """Edges whose ends both exist, one per ``(src, dst)``.

    Of repeated edges the one with the largest ``order`` (else the largest attributes) stays.
    Undirected edges count as repeated in either direction, and a pair keeps the direction it was
    first given: that of the smallest ``order``, else the one with the smaller end first.
    """
    known = edges.join(sources.select(F.col(source_key).alias("src")), "src", "left_semi")
    known = known.join(targets.select(F.col(target_key).alias("dst")), "dst", "left_semi")
    rest = [c for c in edges.columns if c not in ("src", "dst", order)]
    ends = F.struct("src", "dst")
    if undirected:
        known = known.withColumns({"__low": F.least("src", "dst"), "__high": F.greatest("src", "dst")})
    keys = ["__low", "__high"] if undirected else ["src", "dst"]
    whole = F.struct(F.lit(0).alias("__one"), *rest)
    pick = F.max_by(whole, F.struct(F.col(order), whole)) if order else F.max(whole)
    first = F.min_by(ends, F.struct(F.col(order), ends)) if order else F.min(ends)
    one = aggregate_apart(known, keys, first.alias("__ends"), pick.alias("__row"))
    return one.select("__ends.src", "__ends.dst", *(f"__row.{c}" for c in rest))
