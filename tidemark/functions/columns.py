"""Column helpers: trailing windows with full-window rule, guarded ratios, half-even rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_symbol():
    """One partitioning and order for all trailing features, so that Spark plans one exchange and one sort."""
    return Window.partitionBy("symbol").orderBy("session")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last_n(n: int):
    return by_symbol().rowsBetween(-(n - 1), 0)


def prior_n(n: int):
    return by_symbol().rowsBetween(-n, -1)


LONG = 30  # rows from which a mean is taken as the difference of two running sums


def full(aggregate, x: str | Column, n: int, prior: bool = False) -> Column:
    """An aggregate over the last (or the prior) n rows, null until n values are there.

    Spark sums a sliding frame anew for each row, but a frame that only grows in one step: a long mean is the difference
    of two such sums."""
    if aggregate is F.avg and n >= LONG:
        last = -1 if prior else 0
        near, far = (by_symbol().rowsBetween(Window.unboundedPreceding, end) for end in (last, last - n))
        count = F.count(col(x)).over(near) - F.count(col(x)).over(far)
        return F.when(count >= n, (F.sum(col(x)).over(near) - F.coalesce(F.sum(col(x)).over(far), F.lit(0.0))) / n)
    w = prior_n(n) if prior else last_n(n)
    return F.when(F.count(col(x)).over(w) >= n, aggregate(col(x)).over(w))


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(col(x), n).over(by_symbol())


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def rounded(x: str | Column, digits: int = 6) -> Column:
    """Half-even, after a shift that is far below the last digit: quotients of prices often end exactly on a tie, which
    engines break differently. Adding 0.0 makes a negative zero positive."""
    return F.bround(col(x) + F.lit(3e-8), digits) + F.lit(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ramp_up(x: Column, low: float, high: float) -> Column:
    """0 at low, 1 at high, linear between; equal bounds make a step."""
    if high <= low:
        return F.when(x >= high, 1.0).when(x.isNotNull(), 0.0)
    return clamp((x - low) / (high - low), 0.0, 1.0)


def ramp_down(x: Column, low: float, high: float) -> Column:
    return F.lit(1.0) - ramp_up(x, low, high)


def band(x: Column, low: float, high: float, slack: float) -> Column:
    """1 inside [low, high], falling to 0 over slack to either side."""
    return F.least(ramp_up(x, low - slack, low), ramp_down(x, high, high + slack))


def percentile_in(window: Column, x: Column) -> Column:
    """Share of the values of an array that are at most x."""
    return F.size(F.filter(window, lambda v: v <= x)) / F.size(window)


def rolling_percentile(rows: DataFrame, x: str, n: int, name: str) -> DataFrame:
    """symbol, session, x and the share of its last n values that are at most the current one; null until n are there.

    n comparisons a row, in numpy over a symbol's series: a list column would hold each value n times."""

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("session", ignore_index=True)
        v = f[x].to_numpy(float)
        out = np.full(len(v), np.nan)
        for lo in range(n - 1, len(v), 4096):
            hi = min(lo + 4096, len(v))
            windows = np.lib.stride_tricks.sliding_window_view(v[lo - n + 1 : hi], n)
            out[lo:hi] = np.where(np.isnan(windows).any(1), np.nan, (windows <= v[lo:hi, None]).mean(1))
        f[name] = out
        return f

    found = rows.select("symbol", "session", x).groupBy("symbol").applyInPandas(kernel, f"symbol string, session date, {x} double, {name} double")
    return found.withColumn(name, F.nanvl(name, F.lit(None).cast("double"))).withColumn(x, F.nanvl(x, F.lit(None).cast("double")))


def streak_group(flag: Column) -> Column:
    """A number that is constant along each run of true flags."""
    return F.sum((~flag).cast("int")).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
