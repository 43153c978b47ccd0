"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the quality and near-duplicate contracts: runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Words of the benchmark and licence contracts: ASCII letters, digits and everything above ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, with ``value`` computed once per row.

    A plain alias used inside a lambda may be inlined into it by the optimizer and then be
    computed once per element; a lambda variable never is.
    """
    return F.transform(F.array(value), body)[0]


def numbers(first: int, count: Column) -> Column:
    """``first``, ``first + 1``, … as an array of ``count`` integers; empty for none."""
    return F.when(count > 0, F.sequence(F.lit(first), (count + (first - 1)).cast("int"))).otherwise(
        F.array().cast("array<int>"))


def row_keys(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two 64-bit keys that name a row by its content, for joining facts about it back to it.

    Rows equal in all these columns share a key and thus get the same result.
    """
    values = [F.col(c) for c in columns]
    missing = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values])
    return [F.xxhash64(*values, missing).alias("key_a"),
            F.xxhash64(F.lit(1), missing, *reversed(values)).alias("key_b")]

