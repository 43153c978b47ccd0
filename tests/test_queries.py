"""Every registered query against its SQL oracle on the smallest data."""

import os
from datetime import date, datetime

import duckdb
import pytest
from conftest import DATA

from __spark_entry__ import entry
from muster.plans.oracles import ORACLES
from muster.plans.queries import QUERIES


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(value):
    if isinstance(value, datetime) and value.time() == datetime.min.time():
        return value.date().isoformat()
    return value.isoformat() if isinstance(value, date) else value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    result = sql.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, result.fetchall())


def test_only_communities_have_no_oracle():
    assert set(QUERIES) - set(ORACLES) == {"communities_of_buyers", "community_stats"}
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).columns == ["c_custkey"] and entry(spark).count() > 0
