"""Trailing-window indicators as column expressions over bars(symbol, session, open, high, low, close, volume).

Every function gives columns for one shared window per symbol, so that Spark plans one exchange. Recursive averages
have no finite window: they run as one numpy kernel for each symbol (`smoothed`).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import by_symbol, full, lag, ratio, rolling_percentile, streak_group
from tidemark.operators.kernels import NAMES, smoothed_frame



def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def so_far():
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def sma(x: str, n: int) -> Column:
    return full(F.avg, x, n)


def roc(x: str, n: int) -> Column:
    return (ratio(F.col(x), lag(x, n)) - 1) * 100


def slope(x: str, n: int) -> Column:
    return (F.col(x) - lag(x, n)) / n


def true_range() -> Column:
    before = lag("close")
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def bollinger(n: int = 20, width: float = 2.0) -> dict[str, Column]:
    mid, sd = sma("close", n), full(F.stddev_pop, "close", n)
    up, down = mid + width * sd, mid - width * sd
    return {"bb_mid": mid, "bb_up": up, "bb_down": down, "pct_b": ratio(F.col("close") - down, up - down), "bandwidth": ratio(up - down, mid) * 100}


def donchian(n: int = 20) -> dict[str, Column]:
    return {"don_high": full(F.max, "high", n), "don_low": full(F.min, "low", n)}


def relative_volume(n: int = 20) -> Column:
    return ratio(F.col("volume"), full(F.avg, "volume", n, prior=True))


def gap_pct() -> Column:
    return ratio(F.col("open") - lag("close"), lag("close")) * 100


def historical_volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    back = bars.withColumn("log_return", F.ln(ratio(F.col("close"), lag("close"))))
    return back.withColumn("hist_vol", full(F.stddev_samp, "log_return", n) * math.sqrt(252))


def on_balance_volume(bars: DataFrame) -> DataFrame:
    step = bars.withColumn("step", F.coalesce(F.signum(F.col("close") - lag("close")) * F.col("volume"), F.lit(0.0)))
    return step.withColumn("obv", F.sum("step").over(so_far()))


def accumulation_distribution(bars: DataFrame) -> DataFrame:
    flow = F.when(F.col("high") != F.col("low"), ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / (F.col("high") - F.col("low"))).otherwise(0.0) * F.col("volume")
    return bars.withColumn("flow", flow).withColumn("ad_line", F.sum("flow").over(so_far()))


def vwap(n: int = 20) -> Column:
    return ratio(full(F.sum, typical() * F.col("volume"), n), full(F.sum, "volume", n))


def money_flow_index(bars: DataFrame, n: int = 14) -> DataFrame:
    t = bars.withColumn("typical", typical()).withColumn("change", F.col("typical") - lag("typical"))
    t = t.withColumn("up_flow", F.when(F.col("change") > 0, F.col("typical") * F.col("volume")).otherwise(0.0)).withColumn("down_flow", F.when(F.col("change") < 0, F.col("typical") * F.col("volume")).otherwise(0.0))
    t = t.withColumn("up_sum", full(F.sum, "up_flow", n)).withColumn("down_sum", full(F.sum, "down_flow", n))
    mfi = F.when((F.col("up_sum") == 0) & (F.col("down_sum") == 0), 50.0).when(F.col("down_sum") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("up_sum", "down_sum")))
    return t.withColumn("mfi", F.when(F.col("up_sum").isNotNull(), mfi))


def streaks(bars: DataFrame) -> DataFrame:
    """Lengths of runs of rising and of falling closes; null on a symbol's first row, 0 where a run breaks."""
    d = bars.withColumn("d", F.col("close") - lag("close"))
    d = d.withColumn("rise", F.coalesce(F.col("d") > 0, F.lit(False))).withColumn("fall", F.coalesce(F.col("d") < 0, F.lit(False)))
    d = d.withColumn("rise_group", streak_group(F.col("rise"))).withColumn("fall_group", streak_group(F.col("fall")))
    for side in ("rise", "fall"):
        w = Window.partitionBy("symbol", f"{side}_group").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn(f"{side}_streak", F.when(F.col("d").isNotNull(), F.sum(F.col(side).cast("int")).over(w)))
    return d


def rows_since_high(bars: DataFrame, n: int = 252) -> DataFrame:
    """Rows since the earliest maximum of the last n highs."""
    numbered = bars.withColumn("rn", F.row_number().over(by_symbol()))
    best = F.max(F.struct(F.col("high"), (-F.col("rn")).alias("at"))).over(by_symbol().rowsBetween(-(n - 1), 0))
    return numbered.withColumn("since_high", F.when(F.count("high").over(by_symbol().rowsBetween(-(n - 1), 0)) >= n, F.col("rn") + best["at"]))


def volatility_contraction(bars: DataFrame, n: int = 126) -> DataFrame:
    b = bars.withColumn("bandwidth", bollinger()["bandwidth"])
    return rolling_percentile(b, "bandwidth", n, "share").withColumn("contraction", (1 - F.col("share")) * 100)


SMOOTHED = {name: "double" for name in NAMES}


def smoothed(bars: DataFrame, columns: tuple[str, ...] = tuple(SMOOTHED)) -> DataFrame:
    """One kernel call for each symbol gives the recursive averages asked for; a symbol's history fits a task."""

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        return smoothed_frame(frame.sort_values("session", ignore_index=True), columns)

    schema = f"symbol string, session date, {', '.join(f'{k} {SMOOTHED[k]}' for k in columns)}"
    return bars.select("symbol", "session", "high", "low", "close").groupBy("symbol").applyInPandas(kernel, schema)
