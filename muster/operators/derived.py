"""Derived columns audiences rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.ranking import top_per_group

# Least total revenue per tier.
VALUE_TIERS = (("Platinum", 400), ("Gold", 200), ("Silver", 90), ("Bronze", None))


def mean_of_last_active(monthly: DataFrame, keys: DataFrame, key: str, month: str, value: str,
                        name: str, n: int = 3) -> DataFrame:
    """Mean of ``value`` over each key's last ``n`` months that have rows; 0 without any."""
    last = top_per_group(monthly.select(key, month, value), [key], [F.desc(month)], n)
    means = last.groupBy(key).agg(F.avg(value).alias(name))
    return keys.select(key).join(means, key, "left").na.fill(0.0, [name])


def value_tier(total: Column, tiers=VALUE_TIERS) -> Column:
    chain = F
    for label, least in tiers[:-1]:
        chain = chain.when(total >= least, label)
    return chain.otherwise(tiers[-1][0])


def last_date(rows: DataFrame, key: str, date: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(date).alias(name))
