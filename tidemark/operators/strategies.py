"""Strategies as rule tables: ordered vetoes, weighted parts and plan prices, as SQL expressions over one feature row.

A strategy is a plug-in: a name and a `Strategy`. `evaluate` turns the table into one pass over the features, so all strategies of
all sessions and symbols come from a single plan. `register` adds one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import by_symbol, full, lag, ratio
from tidemark.operators.indicators import relative_volume, roc, sma

THRESHOLD = 48.0


def up(x: str, low: float, high: float) -> str:
    return f"least(1.0, greatest(0.0, (({x}) - ({low})) / ({high - low})))"


def down(x: str, low: float, high: float) -> str:
    return f"(1.0 - {up(x, low, high)})"


@dataclass(frozen=True)
class Strategy:
    direction: str
    vetoes: tuple[tuple[str, str], ...]  # reason, and the condition that must hold
    parts: tuple[tuple[str, float], ...]  # share of the maximum, and the maximum
    stop: str
    target: str
    baseline: float = 20.0


REGISTRY: dict[str, Strategy] = {}


def register(name: str, strategy: Strategy) -> None:
    if name in REGISTRY:
        raise ValueError(f"two strategies named {name}")
    REGISTRY[name] = strategy


_CONFIRMED = "coalesce(mentions >= 2 and mood > 0.15, false)"
_BREAK = (("warming_up", "level is not null and ma50 is not null"), ("no_breakout", "close > level"), ("thin_volume", "rel_volume >= 1.2"))
_BREAK_PARTS = ((up("rel_volume", 1.2, 3.0), 25.0), (up("(close / level - 1) * 100", 0.0, 5.0), 20.0), (up("roc20", 0.0, 15.0), 15.0), (up("(close / ma50 - 1) * 100", 0.0, 20.0), 10.0))
register("sentiment_breakout", Strategy("long", (*_BREAK, ("no_sentiment", _CONFIRMED)), (*_BREAK_PARTS, (up("mood", 0.0, 0.8), 10.0)), "level * 0.97", "close + 2 * (close - level * 0.97)"))
register("volume_breakout", Strategy("long", (*_BREAK, ("sentiment_confirmed_elsewhere", f"not {_CONFIRMED}")), (*_BREAK_PARTS, ("case when coalesce(mood < -0.15, false) then -1.0 else 0.0 end", 12.0)), "level * 0.97", "close + 2 * (close - level * 0.97)"))
register("sentiment_pullback", Strategy("long", (("warming_up", "ma50 is not null and high20 is not null"), ("no_trend", "close > ma50"), ("no_pullback", "close < high20 * 0.98"), ("too_deep", "close > high20 * 0.6")), ((down("rel_volume", 0.5, 1.5), 25.0), (down("abs(close / ma20 - 1) * 100", 0.0, 10.0), 25.0), (up("coalesce(mood, 0.0)", 0.0, 0.6), 15.0)), "low * 0.98", "high20"))
register("capitulation_reversal", Strategy("long", (("warming_up", "ma50 is not null and vol20 is not null"), ("not_extended", "close < ma20 * 0.8"), ("no_climax", "rel_volume >= 1.1"), ("no_reversal", "close >= open")), ((up("rel_volume", 1.1, 3.0), 30.0), (down("(close / ma20 - 1) * 100", -60.0, -20.0), 30.0)), "low * 0.97", "ma20"))
register("hype_failure_short", Strategy("short", (("warming_up", "level is not null and ma20 is not null"), ("no_failure", "prev_close > prev_level and close < prev_level"), ("not_bearish", "close < open")), ((up("rel_volume", 0.8, 2.0), 25.0), (up("coalesce(mentions, 0)", 0.0, 10.0), 20.0), (down("(close / prev_level - 1) * 100", -10.0, 0.0), 20.0)), "high * 1.02", "ma20"))
register("post_earnings_drift", Strategy("long", (("no_report", "days_since between 0 and 10"), ("no_surprise", "surprise > 5"), ("no_follow_through", "close > prev_close")), ((up("surprise", 5.0, 20.0), 30.0), (up("rel_volume", 0.8, 2.0), 20.0), (down("days_since", 0.0, 10.0), 20.0)), "low * 0.96", "close * 1.1"))


def features(bars: DataFrame, sentiment: DataFrame, reports: DataFrame) -> DataFrame:
    """One row a bar: trailing features, the day's sentiment, and the last report with its age. sentiment(symbol, session,
    mood, mentions); reports(symbol, session, report, days_since, surprise), both known at the session."""
    b = bars.select("*", sma("close", 20).alias("ma20"), sma("close", 50).alias("ma50"), roc("close", 20).alias("roc20"), relative_volume().alias("rel_volume"), full(F.max, "high", 20, prior=True).alias("level"), full(F.max, "high", 20).alias("high20"), lag("close").alias("prev_close"), ratio(F.col("close"), lag("close")).alias("r"))
    b = b.withColumn("prev_level", F.lag("level").over(by_symbol())).withColumn("vol20", full(F.stddev_samp, "r", 20)).drop("r")
    return b.join(sentiment, ["symbol", "session"], "left").join(reports, ["symbol", "session"], "left")


def decline_sql(s: Strategy) -> str:
    return "case " + " ".join(f"when not coalesce({condition}, false) then '{reason}'" for reason, condition in s.vetoes) + " end"


def score_sql(s: Strategy) -> str:
    parts = " + ".join(f"coalesce({share}, 0.0) * {most}" for share, most in s.parts)
    return f"least(100.0, greatest(0.0, {s.baseline} + {parts}))"


def evaluate(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Every (strategy, symbol, session): the first veto, or a score with stop and target."""
    chosen = names or list(REGISTRY)
    structs = [F.struct(F.lit(n).alias("strategy"), F.lit(REGISTRY[n].direction).alias("direction"), F.expr(decline_sql(REGISTRY[n])).alias("decline"), F.expr(score_sql(REGISTRY[n])).alias("score"), F.expr(REGISTRY[n].stop).alias("stop"), F.expr(REGISTRY[n].target).alias("target")) for n in chosen]
    return rows.select("symbol", "session", "close", F.explode(F.array(*structs)).alias("x")).select("symbol", "session", "close", "x.*")


def valid_plan() -> "F.Column":
    """The reason why a proposal's prices make no sense, or null."""
    long_ = F.col("direction") == "long"
    return F.when(long_ & (F.col("stop") >= F.col("close")), "stop_above").when(long_ & (F.col("target") <= F.col("close")), "target_below").when(~long_ & (F.col("stop") <= F.col("close")), "stop_below").when(~long_ & (F.col("target") >= F.col("close")), "target_above")
