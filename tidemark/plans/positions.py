"""Exits of positions that the trades of the warehouse would have had under stops, staged targets and a time limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import exits, indicators as ind
from tidemark.registry import query
from tidemark.sources.adapters import NO_DAY, bars_and_lines, earnings, trades

RULES = exits.Rules(average=True, report_days=1, participation=0.5, spread=0.0005, impact=0.001)


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Trades as positions: every strategy but the reversal long; stops and targets at fixed shares of the entry."""
    t = trades(spark, sf).withColumns({"position_id": F.col("trade_id"), "long": F.col("strategy") != "reversal"})
    return _positions(spark, sf, t.select("position_id", "symbol", "long", "entry_session", "entry_price", "shares"))


def _positions(spark: SparkSession, sf: str, t: DataFrame) -> DataFrame:
    """Reports come as one map of years a symbol, so that positions that lie by symbol stay where they are."""
    e, side = F.col("entry_price"), F.when(F.col("long"), 1.0).otherwise(-1.0)
    due = earnings(spark, sf).where("confirmed").groupBy("symbol", F.year("report_date").alias("year")).agg(F.max("report_date").alias("report")).where("year is not null")
    due = due.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("year", "report"))).alias("reports"))
    t = t.join(due, "symbol", "left").withColumn("report", F.try_element_at("reports", F.year("entry_session")))
    return t.select(
        "position_id", "symbol", F.when(F.col("long"), "long").otherwise("short").alias("direction"), "entry_session", "entry_price", F.ceil("shares").alias("shares"),
        (e * (1 - side * 0.08)).alias("stop"), (e * (1 + side * 0.10)).alias("target1"), (e * (1 + side * 0.25)).alias("target2"), F.lit(20).alias("hold"),
        F.when(F.col("report") > F.col("entry_session"), F.col("report")).alias("report"),
    )


def held_and_series(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """positions() and the bars with their mean, dealt by symbol together; the kernel adds the true range."""
    b, lines = bars_and_lines(spark, sf)
    supplier = F.nullif(F.substring("symbol", 2, 40), F.lit(""))
    name = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), supplier)
    t = lines.select(name.alias("position_id"), "symbol", (F.col("l_linenumber") % 4 != 2).alias("long"), "entry_session", (F.col("l_extendedprice") / F.col("l_quantity")).alias("entry_price"), F.col("l_quantity").alias("shares"))
    return _positions(spark, sf, t), b.withColumn("average", ind.sma("close", 20)).where(F.col("session") != F.lit(NO_DAY).cast("date"))


@query("position_exits")
def position_exits(spark: SparkSession, sf: str) -> DataFrame:
    """Each exit of each position, partial ones included."""
    x = exits.exits(*held_and_series(spark, sf), RULES)
    return x.withColumns({"symbol": F.nullif("symbol", F.lit("")), "session": F.col("session").cast("string"), "price": rounded("price"), "stop": rounded("stop")})
