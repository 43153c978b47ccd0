from datetime import date

import pytest
from pyspark.sql import functions as F

from muster.functions.columns import (
    bucket,
    bucket_labels,
    fnv1a32,
    fnv1a32_text,
    in_control,
    in_months,
    value_position,
)
from muster.functions.ranking import global_row_number, top_per_group
from muster.model import Attribute

VECTORS = {"": 0x811C9DC5, "a": 0xE40C292C, "foobar": 0xBF9CF968, "abc123:966500000007": 193667198}


def test_hash_vectors(spark):
    texts = [*VECTORS, "é→x", "日本"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = dict(df.select("t", fnv1a32(F.col("t"))).collect())
    assert {t: got[t] for t in VECTORS} == VECTORS
    assert got == {t: fnv1a32_text(t) for t in texts}


def test_hash_continues(spark):
    df = spark.createDataFrame([("abc123:", "966500000007")], "a string, b string")
    start = fnv1a32_text("abc123:")
    assert df.select(fnv1a32(F.col("b"), start)).first()[0] == 193667198


def test_holdout_of_known_keys(spark):
    keys = spark.range(966500000001, 966500000013)
    held = keys.where(in_control("abc123", F.col("id").cast("string"), 25)).collect()
    assert sorted(r.id - 966500000000 for r in held) == [1, 5, 9, 12]


def test_holdout_share_and_limits(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    share = keys.where(in_control("seg", F.col("k"), 10)).count() / 20000
    assert abs(share - 0.1) < 0.01
    assert keys.where(in_control("seg", F.col("k"), 0)).count() == 0
    with pytest.raises(ValueError):
        in_control("seg", F.col("k"), 51)


def test_bucket_labels_and_values(spark):
    assert bucket_labels((18, 25, 35)) == ["< 18", "18 – 25", "25 – 35", "≥ 35"]
    assert bucket_labels((0.2, 0.4)) == ["< 0.2", "0.2 – 0.4", "≥ 0.4"]
    df = spark.createDataFrame([(None,), (17.9,), (18.0,), (24.0,), (35.0,)], "x double")
    got = [r[0] for r in df.select(bucket(F.col("x"), (18, 25, 35))).collect()]
    assert got == [None, "< 18", "18 – 25", "18 – 25", "≥ 35"]


def test_value_position(spark):
    df = spark.createDataFrame([("B",), ("A",), ("?",)], "v string")
    got = [r[0] for r in df.select(value_position(F.col("v"), Attribute("x", "enum", values=("A", "B")))).collect()]
    assert got == [1, 0, 2]


def test_month_window_is_open_on_the_left(spark):
    days = [date(2026, 2, 28), date(2026, 3, 1), date(2026, 3, 31), date(2026, 4, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.where(in_months(F.col("d"), date(2026, 3, 31), 1)).collect()]
    assert got == days[1:3]


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g"))
    got = global_row_number(df.repartition(7), [F.col("g"), F.desc("v")]).collect()
    expected = sorted(got, key=lambda r: (r.g, -r.v))
    assert [r.row_number for r in expected] == list(range(1, 1001))


def test_top_per_group_trims_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    top = top_per_group(df, ["g"], [F.desc("id")], 3)
    assert sorted(r.id for r in top.collect()) == [94, 95, 96, 97, 98, 99]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 3, Partial" in plan and "row_number(), 3, Final" in plan
