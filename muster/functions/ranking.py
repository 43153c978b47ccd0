"""Grouping and ordering helpers that keep working when one group or tie is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muster.session import cut_lineage


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """1-based position in a total order, without an unpartitioned window.

    The rows are range-partitioned and sorted once; each row's place inside its
    partition is read off its id, and only one count per partition is summed up.
    ``order`` must be unique, so that a retried task sorts the same way.
    """
    spot = F.monotonically_increasing_id()
    placed = cut_lineage(df.orderBy(*order).withColumn("__spot", spot))
    part = F.shiftrightunsigned("__spot", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    # One row per partition: bounded by the partition count, so the window and broadcast are safe.
    before = F.coalesce(
        F.sum("__rows").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__before") + F.col("__spot").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("__part", "__before", "__spot")
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                  name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark trims each group before the shuffle."""
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def aggregate_apart(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregate per key, for joining the result back to rows that may have a hot key.

    Grouping by one struct leaves the result partitioned unlike the plain keys. The join then
    shuffles both sides itself, one row per key on this side, and only joins of that shape
    are split by AQE where a key of the other side is hot.
    """
    grouped = df.groupBy(F.struct(*keys).alias("__keys")).agg(*aggregates)
    rest = [c for c in grouped.columns if c != "__keys"]
    return grouped.select(*(F.col(f"__keys.{k}").alias(k) for k in keys), *rest)


def distinct_apart(df: DataFrame) -> DataFrame:
    """Distinct rows, combined on the map side even if ``df`` is partitioned by one column."""
    return df.select(F.struct("*").alias("__row")).distinct().select("__row.*")
