"""Plug-in strategies: state by symbol, SQL form, equal to the rule table, and failures with a name."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import plugins, strategies
from tidemark.plans.plugged import VolumeBreakout
from tidemark.plans.strategies import feature_rows


def made():
    """Classes of a test module don't reach the workers by name; local ones travel whole."""

    class Rising(plugins.Plugin):
        name, direction = "rising_rows", "short"

        def __init__(self):
            self.before, self.seen = None, 0

        def step(self, row):
            self.seen += 1
            up = self.before is not None and row["close"] > self.before
            self.before = row["close"]
            return plugins.Verdict(None if up else "falls", float(self.seen)) if self.seen > 1 else None

    class Broken(plugins.Plugin):
        name = "broken"

        def step(self, row):
            return 1 / 0

    return Rising, Broken


def rows(spark):
    return spark.createDataFrame([(s, f"2024-01-0{d}", float(c)) for s, cs in (("A", [1, 2, 1]), ("B", [5, 6, 7])) for d, c in zip((3, 1, 2), (cs[2], cs[0], cs[1]), strict=True)], "symbol string, session string, close double").withColumn("session", F.to_date("session"))


def test_rows_come_in_order_and_apart_by_symbol(spark):
    Rising, _ = made()
    want = [("A", 2, None, 2.0), ("A", 3, "falls", 3.0), ("B", 2, None, 2.0), ("B", 3, None, 3.0)]
    see = lambda df: sorted((r["symbol"], r["session"].day, r["decline"], r["score"]) for r in df.collect())
    assert see(plugins.run(rows(spark), Rising)) == want
    plugins.register(spark, Rising)
    rows(spark).createOrReplaceTempView("rows_of_plugins")
    assert see(spark.sql("select * from rising_rows(table(rows_of_plugins) partition by symbol order by session)")) == want
    assert plugins.run(rows(spark).limit(0), Rising).count() == 0


def test_failures_name_the_plugin(spark):
    _, Broken = made()
    with pytest.raises(Exception, match="the plug-in broken failed at"):
        plugins.run(rows(spark), Broken).collect()
    with pytest.raises(ValueError, match="name"):
        plugins.table_function(plugins.Plugin)


def test_plugin_equals_the_rule_table(spark, sf):
    f = feature_rows(spark, sf).cache()
    see = lambda df: {(r["symbol"], r["session"]): (r["decline"], None if r["decline"] else (round(r["score"], 9), round(r["stop"], 9))) for r in df.collect()}
    assert see(plugins.run(f, VolumeBreakout)) == see(strategies.evaluate(f, ["volume_breakout"]))
