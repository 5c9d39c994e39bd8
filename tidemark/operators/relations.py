"""Joins and set operations with fixed semantics: as-of, latest, upsert, insert-ignore, universe, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backward_asof(left: DataFrame, right: DataFrame, values: list[str], keep_key: str) -> DataFrame:
    """left(symbol, session) with the values of the last right row at or before it: a union and one window, no range join."""
    l = left.select("symbol", "session", F.lit(1).alias("side"), *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values), F.lit(None).cast("date").alias(keep_key))
    r = right.select("symbol", "session", F.lit(0).alias("side"), *values, F.col("session").alias(keep_key))
    w = Window.partitionBy("symbol").orderBy("session", "side").rowsBetween(Window.unboundedPreceding, 0)
    filled = l.unionByName(r).select("symbol", "session", "side", *(F.last(v, True).over(w).alias(v) for v in [*values, keep_key]))
    return filled.where("side = 1").drop("side")


def forward_asof(left: DataFrame, right: DataFrame, keep_key: str) -> DataFrame:
    """left(symbol, session) with the first right session at or after it."""
    l = left.select("symbol", "session", F.lit(0).alias("side"), F.lit(None).cast("date").alias(keep_key))
    r = right.select("symbol", "session", F.lit(1).alias("side"), F.col("session").alias(keep_key))
    w = Window.partitionBy("symbol").orderBy("session", "side").rowsBetween(0, Window.unboundedFollowing)
    filled = l.unionByName(r).select("symbol", "session", "side", F.first(keep_key, True).over(w).alias(keep_key))
    return filled.where("side = 0").drop("side")


def latest(rows: DataFrame, key: list[str], order: str, n: int = 1) -> DataFrame:
    """The newest n rows of each key; Spark limits groups before the shuffle."""
    return rows.withColumn("newest", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where(F.col("newest") <= n).drop("newest")


def upsert(old: DataFrame, new: DataFrame, key: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """old with new written over it, and what was done to each row."""
    o, n = old.select(*key, *(F.col(v).alias(f"old_{v}") for v in values), F.lit(True).alias("in_old")), new.select(*key, *values, F.lit(True).alias("in_new"))
    j = n.join(o, key, "full")
    differs = F.lit(False)
    for v in values:
        differs = differs | (F.abs(F.col(v) - F.col(f"old_{v}")) > tolerance)
    action = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "keep").when(differs, "restate").otherwise("same")
    return j.select(*key, *(F.coalesce(v, f"old_{v}").alias(v) for v in values), action.alias("action"))


def insert_ignore(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    return fresh.join(stored.select(*key), key, "left_anti")


def universe(securities: DataFrame, exchanges_out: tuple = ("AFRICA",), sectors_out: tuple = ("CHINA", "INDIA"), floor: float = 1e9) -> DataFrame:
    """The first rule that drops each security, or 'selected'."""
    reason = (
        F.when(F.col("delisted_date").isNotNull(), "inactive")
        .when(F.col("exchange").isin(*exchanges_out), "exchange")
        .when(F.col("is_etf"), "etf")
        .when(F.col("sector").isin(*sectors_out), "sector")
        .when(F.col("market_cap_usd").isNull(), "no cap")
        .when(F.col("market_cap_usd") < floor, "cap")
        .otherwise("selected")
    )
    return securities.withColumn("reason", reason)


def bar_issues(bars: DataFrame) -> DataFrame:
    """One row for each issue of a bar."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("session"))
    b = bars.withColumn("jump", F.abs(F.try_divide(F.col("close"), before) - 1) >= 0.5)
    kinds = F.array(
        F.when(F.col("volume") == 0, "zero_volume"),
        F.when((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")), "ohlc"),
        F.when(F.col("jump"), "jump"),
        F.when(F.weekday("session") >= 5, "weekend"),
    )
    return b.select("symbol", "session", F.explode(kinds).alias("kind")).where("kind is not null")
