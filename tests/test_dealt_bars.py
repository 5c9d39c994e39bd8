"""Bars dealt by symbol: equal to bars, with one exchange for all that follows."""

import datetime as dt
from unittest import mock

import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions.columns import lag
from tidemark.sources import adapters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [adapters.HOT, 0])
def test_dealt_bars_are_the_bars(spark, sf, hot):
    with mock.patch.object(adapters, "HOT", hot):
        dealt = adapters.bars_by_symbol(spark, sf)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, adapters.bars(spark, sf).collect()))
    assert plan(dealt.withColumn("before", lag("close"))).count("Exchange hashpartitioning") == (2 if hot == 0 else 1)


def test_lines_without_a_supplier_or_a_day_are_kept(spark, tmp_path):
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    at = dt.datetime(1996, 1, 2)
    spark.createDataFrame([(1, 1, 1, None, 2.0, 10.0, at), (2, 1, 1, 7, 1.0, 3.0, None), (3, 1, 1, 7, 1.0, 4.0, at)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = adapters.bars_by_symbol(spark, str(tmp_path)).select("symbol", F.col("session").cast("string"), "close").collect()
    assert sorted(map(tuple, got)) == [("", "1996-01-02", 5.0), ("S7", adapters.NO_DAY, 3.0), ("S7", "1996-01-02", 4.0)]


@pytest.mark.parametrize("name", ["weighted_overall", "ranked_candidates"])
def test_lines_are_not_sent_by_symbol_and_day(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert "min_by" not in text and "hashpartitioning(symbol" in text
    dealt = [x for x in text.splitlines() if "Exchange hashpartitioning(symbol" in x]
    assert not [x for x in dealt if "REPARTITION" not in x and "hashpartitioning(symbol#" in x and ", session#" in x and "low" in x]
    assert text.count("REPARTITION_BY_COL") == 2  # the same exchange, for the market and for the symbols; AQE runs it once
