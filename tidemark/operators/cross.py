"""Measures across series: against the market's mean close, over all symbols of a session, and the market's state."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import by_symbol, lag, percentile_in, ratio
from tidemark.operators.indicators import sma
from tidemark.operators.kernels import cluster


def returns(bars: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """Bars with one-day returns of the symbol and of the benchmark (mean close of a session); bench(session, bclose, ...), one row a session,
    is broadcast where it is given."""
    j = bars.join(bars.groupBy("session").agg(F.avg("close").alias("bclose")) if bench is None else F.broadcast(bench), "session")
    return j.withColumn("ret", ratio(F.col("close"), lag("close")) - 1).withColumn("bret", ratio(F.col("bclose"), lag("bclose")) - 1)


def relative_strength(bars: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    return returns(bars, bench).withColumn("rs_line", ratio(1 + F.col("ret"), 1 + F.col("bret")))


def beta(bars: DataFrame, n: int = 60) -> DataFrame:
    """Covariance over variance of pair-complete returns; null before n rows, below two pairs, or without variance."""
    w = by_symbol().rowsBetween(-(n - 1), 0)
    paired = F.when(F.col("ret").isNotNull(), F.col("bret"))
    r = returns(bars).withColumn("rn", F.row_number().over(by_symbol())).withColumn("var", F.var_samp(paired).over(w)).withColumn("pairs", F.count(paired).over(w))
    ok = (F.col("rn") >= n) & (F.col("pairs") >= 2) & (F.col("var") > 0)
    return r.withColumn("beta", F.when(ok, F.covar_samp("ret", "bret").over(w) / F.col("var")))


def breadth(bars: DataFrame, n: int = 50) -> DataFrame:
    """Share of symbols above their own n-session mean; 0.5 where none has one yet."""
    above = bars.withColumn("ma", sma("close", n)).withColumn("above", (F.col("close") > F.col("ma")).cast("int"))
    return above.groupBy("session").agg(F.count("ma").alias("members"), F.coalesce(F.avg("above"), F.lit(0.5)).alias("breadth"), F.avg("close").alias("bclose"))


def regime(bars: DataFrame) -> DataFrame:
    """One row a session. The market series has one row for each trading day, so its windows stay small."""
    day = Window.partitionBy(F.lit(0)).orderBy("session")

    def mean(n: int):
        return F.avg("bclose").over(day.rowsBetween(-(n - 1), 0))

    b = breadth(bars).withColumn("lr", F.ln(F.col("bclose") / F.lag("bclose").over(day)))
    trend = 0.2 * sum((F.signum(F.col("bclose") - mean(n)) for n in (20, 50, 200)), F.lit(0.0))
    b = b.withColumn("trend", trend)
    w = day.rowsBetween(-19, 0)
    b = b.withColumn("vol", F.when(F.count("lr").over(w) >= 20, F.stddev_samp("lr").over(w)))
    b = b.withColumn("vols", F.collect_list("vol").over(day.rowsBetween(-251, 0)))
    b = b.withColumn("vol_percentile", F.when(F.col("vol").isNotNull(), percentile_in(F.col("vols"), F.col("vol"))))
    calm = F.coalesce(F.col("vol_percentile") < 0.8, F.lit(False))
    state = F.when((F.col("trend") > 0.2) & (F.col("breadth") >= 0.55), F.when(calm, "bull_quiet").otherwise("bull_volatile"))
    state = state.when((F.col("trend") < -0.2) & (F.col("breadth") <= 0.4), F.when(calm, "bear_quiet").otherwise("bear_volatile")).otherwise("neutral")
    return b.withColumn("regime", state)


def clustered_levels(swings: DataFrame, lookback: int = 100, tolerance: float = 0.015) -> DataFrame:
    """Resistance from the swing highs and support from the swing lows of the last `lookback` rows: of the clusters of each the one
    with most touches, then the one touched last, with its touches (0 without one) and the rows since its last touch.

    Levels change only where a point enters or leaves the window, so points are clustered that often, not for every row."""

    def side(f: pd.DataFrame, price: str, flag: str) -> list[tuple[float | None, int, int | None]]:
        v, flags = f[price].to_numpy(), f[flag].to_numpy(bool)
        at = np.flatnonzero(flags).tolist()
        known, best, rows = None, None, []
        for i in range(len(f)):
            span = bisect_right(at, i - lookback), bisect_right(at, i)
            if span != known:
                known = span
                best = max(cluster([(float(v[k]), k) for k in at[span[0] : span[1]]], tolerance), key=lambda c: (c[1], c[2]), default=None)
            rows.append((best[0], best[1], i - best[2]) if best else (None, 0, None))
        return rows

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("session", ignore_index=True)
        out = {"symbol": f["symbol"], "session": f["session"]}
        for name, price in (("resistance", "high"), ("support", "low")):
            level, touches, age = zip(*side(f, price, f"swing_{price}"), strict=True)
            out |= {name: pd.Series(level, dtype=float), f"{name}_touches": touches, f"{name}_recency": pd.Series(age, dtype="Int64")}
        return pd.DataFrame(out)

    schema = "symbol string, session date, resistance double, resistance_touches long, resistance_recency long, support double, support_touches long, support_recency long"
    found = swings.select("symbol", "session", "high", "low", "swing_high", "swing_low").groupBy("symbol").applyInPandas(kernel, schema)
    return found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("resistance", "support")})


def strength(bars: DataFrame, n: int = 20, bench: DataFrame | None = None) -> DataFrame:
    """Relative strength against the benchmark: the line, its slope over n rows, and the share of its last n values that are at most the
    current one (null until n values are there), from 0 to 100 as the score."""
    w = by_symbol().rowsBetween(-(n - 1), 0)
    r = relative_strength(bars, bench).withColumn("rs_slope", (F.col("rs_line") - lag("rs_line", n)) / n).withColumn("lines", F.collect_list("rs_line").over(w))
    percentile = F.when(F.size("lines") >= n, percentile_in(F.col("lines"), F.col("rs_line")))
    return r.withColumn("rs_percentile", percentile).withColumn("rs_score", percentile * 100).drop("lines")


def correlation(bars: DataFrame, n: int = 60) -> DataFrame:
    """Correlation of pair-complete returns with the benchmark's; null before n rows, below two pairs, or where either never varies."""
    w = by_symbol().rowsBetween(-(n - 1), 0)
    own, other = F.when(F.col("bret").isNotNull(), F.col("ret")), F.when(F.col("ret").isNotNull(), F.col("bret"))
    r = returns(bars).withColumn("rn", F.row_number().over(by_symbol()))
    r = r.withColumns({"s1": F.stddev_samp(own).over(w), "s2": F.stddev_samp(other).over(w), "cov": F.covar_samp("ret", "bret").over(w), "pairs": F.count(own).over(w)})
    ok = (F.col("rn") >= n) & (F.col("pairs") >= 2) & (F.col("s1") > 0) & (F.col("s2") > 0)
    return r.withColumn("corr", F.when(ok, F.col("cov") / (F.col("s1") * F.col("s2"))))


def sector_strength(bars: DataFrame, securities: DataFrame, n: int = 20) -> DataFrame:
    """Each sector's one-day ratio as a share of its own last n calendar rows that are at most it (partial at the start).

    A sector's series is the mean close of its symbols. The calendar is the union of all sectors' sessions; a ratio needs
    closes on two neighbouring rows of it. Days are numbered once over the calendar, one row a trading day, so the frames are ranges
    of numbers and no row is made for a sector's missing days."""
    closes = bars.join(securities.select("symbol", "sector"), "symbol").groupBy("sector", "session").agg(F.avg("close").alias("close"))
    days = closes.select("session").distinct().withColumn("day", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("session")))
    w = Window.partitionBy("sector").orderBy("day")
    s = closes.join(days, "session").withColumn("before", F.when(F.lag("day").over(w) == F.col("day") - 1, F.lag("close").over(w)))
    s = s.withColumn("line", ratio(F.col("close"), F.col("before"))).withColumn("lines", F.collect_list("line").over(w.rangeBetween(-(n - 1), 0)))
    return s.select("sector", "session", F.when(F.col("line").isNotNull(), percentile_in(F.col("lines"), F.col("line"))).alias("strength"))
