"""Price patterns over bars: pivots, breakouts, gaps, levels. A flag stands on the bar that confirms it, never earlier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import by_symbol, full, lag, ratio
from tidemark.operators.indicators import relative_volume, roc, sma

#: Retracement ratios, and round-number steps by price.
RATIOS = {"fib_23_6": 0.236, "fib_38_2": 0.382, "fib_50_0": 0.5, "fib_61_8": 0.618, "fib_78_6": 0.786}


def swings(bars: DataFrame, side: int = 3) -> DataFrame:
    """swing_high and swing_low: a strict extreme against `side` rows to either side, flagged `side` rows later;
    recent_high and recent_low carry the price of the confirming row."""
    before, after = by_symbol().rowsBetween(-2 * side, -side - 1), by_symbol().rowsBetween(-side + 1, 0)
    whole = F.count("high").over(by_symbol().rowsBetween(-2 * side, 0)) >= 2 * side + 1
    high = whole & (lag("high", side) > F.max("high").over(before)) & (lag("high", side) > F.max("high").over(after))
    low = whole & (lag("low", side) < F.min("low").over(before)) & (lag("low", side) < F.min("low").over(after))
    s = bars.withColumn("swing_high", F.coalesce(high, F.lit(False))).withColumn("swing_low", F.coalesce(low, F.lit(False)))
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("recent_high", F.last(F.when(F.col("swing_high"), F.col("high")), True).over(w)).withColumn("recent_low", F.last(F.when(F.col("swing_low"), F.col("low")), True).over(w))


def structure_score(bars: DataFrame, lookback: int = 60, pivots: int = 3) -> DataFrame:
    """Mean of the signs of change over the last confirmed swing highs and lows."""
    s = swings(bars)
    w = by_symbol().rowsBetween(-(lookback - 1), 0)
    for side in ("high", "low"):
        s = s.withColumn(f"{side}s", F.collect_list(F.when(F.col(f"swing_{side}"), F.col(side))).over(w))
        s = s.withColumn(f"{side}s", F.slice(f"{side}s", F.greatest(F.lit(1), F.size(f"{side}s") - pivots + 1), pivots))

    def signs(x: str) -> Column:
        return F.transform(F.sequence(F.lit(2), F.size(x)), lambda i: F.when(F.element_at(x, i) > F.element_at(x, i - 1), 1.0).otherwise(-1.0))

    enough = (F.size("highs") >= 2) & (F.size("lows") >= 2)
    every = F.concat(signs("highs"), signs("lows"))
    return s.withColumn("structure", F.when(enough, F.aggregate(every, F.lit(0.0), lambda a, x: a + x) / F.size(every)))


def breakout(bars: DataFrame, n: int = 20, volume_factor: float = 1.5) -> DataFrame:
    level, usual = full(F.max, "high", n, prior=True), full(F.avg, "volume", n, prior=True)
    b = bars.withColumn("level", level).withColumn("usual_volume", usual)
    return b.withColumn("breakout", F.coalesce((F.col("close") > F.col("level")) & (F.col("volume") > volume_factor * F.col("usual_volume")), F.lit(False)))


def first_within(bars: DataFrame, event: Column, level: Column, ahead: tuple[int, int], columns: tuple[str, ...], holds, name: str) -> DataFrame:
    """bars with a flag on the first row, from ahead[0] to ahead[1] rows after an event, where holds(row, level of the event).

    Row r is such a row for the event k rows before it, if none of the rows between holds: lags in the one window by symbol, no join.
    """
    low, high = ahead
    b = bars.withColumn("_event", F.coalesce(event, F.lit(False))).withColumn("_level", level)
    b = b.withColumns({f"_{c}_{k}": lag(c, k) for c in (*columns, "_event", "_level") for k in range(1, high + 1)})

    def at(k: int) -> dict[str, Column]:
        return {c: F.col(f"_{c}_{k}") if k else F.col(c) for c in (*columns, "_event", "_level")}

    flag = F.lit(False)
    for k in range(low, high + 1):
        then = at(k)
        hit = F.coalesce(then["_event"], F.lit(False)) & F.coalesce(holds(at(0), then["_level"]), F.lit(False))
        for j in range(1, k - low + 1):
            hit = hit & ~F.coalesce(holds(at(j), then["_level"]), F.lit(False))
        flag = flag | hit
    return b.withColumn(name, flag).drop(*(c for c in b.columns if c.startswith("_")))


def failed_breakout(bars: DataFrame, ahead: int = 5, n: int = 20, volume_factor: float = 1.5) -> DataFrame:
    """Flag on the first close below the broken level within `ahead` rows."""
    return first_within(breakout(bars, n, volume_factor), F.col("breakout"), F.col("level"), (1, ahead), ("close",), lambda r, level: r["close"] < level, "failed_breakout")


def gap_fill(bars: DataFrame, ahead: int = 10) -> DataFrame:
    """gap_pct, and gap_filled on the first row, 0 to `ahead` later, whose range covers the close before the gap."""
    b = bars.withColumn("prev_close", lag("close")).withColumn("gap_pct", ratio(F.col("open") - F.col("prev_close"), F.col("prev_close")) * 100)
    return first_within(b, F.col("gap_pct") != 0, F.col("prev_close"), (0, ahead), ("low", "high"), lambda r, level: (r["low"] <= level) & (level <= r["high"]), "gap_filled")


def gap_continuation(bars: DataFrame, up: bool = True, ahead: int = 3, n: int = 20, volume_factor: float = 1.5) -> DataFrame:
    """Within `ahead` rows after an event, an open beyond the level with a gap in its direction. Up: a breakout, above its level.
    Down: a failed breakout, below the prior high as of the bar that confirms the failure."""
    b = (breakout(bars, n, volume_factor) if up else failed_breakout(bars, n=n, volume_factor=volume_factor)).withColumn("prev_close", lag("close"))
    beyond = (lambda r, level: (r["open"] > level) & (r["open"] > r["prev_close"])) if up else (lambda r, level: (r["open"] < level) & (r["open"] < r["prev_close"]))
    return first_within(b, F.col("breakout" if up else "failed_breakout"), F.col("level"), (1, ahead), ("open", "prev_close"), beyond, "gap_continuation")


def pivot_points() -> dict[str, Column]:
    h, low, c = lag("high"), lag("low"), lag("close")
    p = (h + low + c) / 3
    return {"pivot": p, "r1": 2 * p - low, "s1": 2 * p - h, "r2": p + (h - low), "s2": p - (h - low)}


def fibonacci(high: str = "recent_high", low: str = "recent_low") -> dict[str, Column]:
    return {k: F.col(low) + r * (F.col(high) - F.col(low)) for k, r in RATIOS.items()}


def round_number(x: Column) -> Column:
    step = F.when(x < 20, 1.0).when(x < 100, 5.0).otherwise(10.0)
    return F.bround(x / step, 0) * step


def confluence(bars: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """How many of four methods have a level within `tolerance` percent of the close."""
    s = swings(bars).select("*", *(v.alias(k) for k, v in pivot_points().items()), sma("close", 20).alias("ma20"), sma("close", 50).alias("ma50"))
    s = s.select("*", *(v.alias(k) for k, v in fibonacci().items()), round_number(F.col("close")).alias("round_level"))

    def near(names: list[str]) -> Column:
        return F.exists(F.array(*names), lambda v: F.coalesce(F.abs(F.col("close") - v) / F.abs(F.col("close")) * 100 <= tolerance, F.lit(False))).cast("int")

    methods = [["recent_high", "recent_low"], ["pivot", "r1", "s1", "r2", "s2"], list(RATIOS), ["round_level"], ["ma20", "ma50"]]
    return s.withColumn("confluence", sum((near(m) for m in methods), F.lit(0)))


def volume_divergence() -> Column:
    return F.coalesce((relative_volume() >= 1.5) & (F.abs(roc("close", 1)) < 1), F.lit(False))


def consolidation(bars: DataFrame, n: int = 10, width: float = 5.0) -> DataFrame:
    high, low = full(F.max, "high", n), full(F.min, "low", n)
    b = bars.withColumn("range_pct", ratio(high - low, low) * 100)
    return b.withColumn("tight", F.coalesce(F.col("range_pct") <= width, F.lit(False)))


def reclaim(bars: DataFrame, n: int = 10) -> DataFrame:
    """Above the 20-row mean today after a close below it in the prior n rows."""
    b = bars.withColumn("ma", sma("close", 20)).withColumn("below", (F.col("close") < F.col("ma")).cast("int"))
    return b.withColumn("reclaim", F.coalesce((F.col("close") > F.col("ma")) & (F.max("below").over(by_symbol().rowsBetween(-n, -1)) == 1), F.lit(False)))


def pullback(bars: DataFrame, trend: int = 50, near: float = 3.0) -> DataFrame:
    b = bars.withColumn("ma", sma("close", 20)).withColumn("trend", sma("close", trend))
    rising = F.col("trend") > F.lag("trend", 10).over(by_symbol())
    close_by = F.abs(F.col("close") - F.col("ma")) / F.col("ma") * 100 <= near
    b = b.withColumn("quiet", F.when(F.col("close") < lag("close"), F.col("volume")))
    b = b.withColumn("down_volume", F.avg("quiet").over(by_symbol().rowsBetween(-4, 0))).withColumn("down_before", F.avg("quiet").over(by_symbol().rowsBetween(-9, -5)))
    return b.withColumn("pullback", F.coalesce((F.col("close") > F.col("trend")) & rising & close_by & (F.col("down_volume") <= F.col("down_before")), F.lit(False)))
