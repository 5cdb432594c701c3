"""Every query that has SQL against DuckDB over the driver's tables."""

import os

import pytest

import __spark_entry__
from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_same_rows(spark, name):
    assert not compare(__spark_entry__.queries()[name](spark, DATA), connect(DATA), __spark_entry__.oracle_sql()[name])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["uneven_peaks", "uneven_stats"])
def test_same_rows_from_many_tasks(spark, name):
    conf = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert not compare(__spark_entry__.queries()[name](spark, DATA), connect(DATA), __spark_entry__.oracle_sql()[name])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_queries_have_unique_columns(spark):
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).count() > 0
