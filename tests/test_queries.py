"""Every registered query against its SQL on the smallest tables."""

import pytest
from verify import compare, views

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return views(DATA)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, DATA, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL))
def test_query_without_sql_gives_distinct_rows(spark, name):
    got = QUERIES[name](spark, DATA).collect()
    assert got and len({str(r) for r in got}) == len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_averages_keep_large_and_infinite_readings(spark):
    data, name = DATA.replace("0.001", "0.01"), "tsbs_double_groupby_1"
    assert compare(spark, views(data), data, QUERIES[name], SQL[name]) == ""
    got = QUERIES[name](spark, data)
    assert got.where("abs(avg_v) = double('infinity')").count() > 0


def test_trailing_averages_and_infinite_sums_are_returned(spark):
    data = DATA.replace("0.001", "0.01")
    got = QUERIES["p3_averages"](spark, data)
    assert {"avg_7", "avg_30"} <= set(got.columns)
    assert got.where("abs(sum_7) = double('infinity') AND abs(avg_7) = double('infinity')").count() > 0
    assert got.where("sum_7 IS NULL AND NOT nan_7 OR sum_30 IS NULL AND NOT nan_30 OR avg_7 IS NULL AND n_7 > 0 AND NOT nan_7").count() == 0
