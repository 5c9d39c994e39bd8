"""Component scores, polarity and attention axes, data confidence, hard gates, weighted overall, status, portfolio limits.

All are row-wise expressions over candidates: one row a symbol, session and direction, with features, the daily sentiment row (nulls
where there is none), regime and earnings distance already joined. Nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp

#: Weights of the overall score.
WEIGHTS = {"momentum": 0.20, "volume": 0.10, "sentiment": 0.15, "acceleration": 0.05, "catalyst": 0.05, "earnings": 0.10, "liquidity": 0.10, "regime": 0.10, "manipulation": 0.10, "data_confidence": 0.05}
#: Limits of the hard gates.
LIMITS = {
    "min_price": 5.0, "max_price": 1500.0, "min_cap": 3e8, "min_adv": 20_000.0, "max_atr_pct": 12.0, "min_atr_pct": 0.5, "max_hv": 1.5,
    "min_days": 3, "max_days": 60, "min_authors": 5, "min_confidence": 0.05, "max_manipulation": 0.45, "min_reward_risk": 1.5,
}
MIN_POSTS, MIN_AUTHORS, EARNINGS_BUFFER = 8, 5, 3


def scale(x: Column, low: float, high: float) -> Column:
    """0 at low, 100 at high."""
    return clamp((x - low) / (high - low) * 100.0, 0.0, 100.0)


def hundred(x: Column) -> Column:
    return clamp(x, 0.0, 100.0)


def _or(x: str, value: float) -> Column:
    return F.coalesce(F.col(x), F.lit(value))


def sign() -> Column:
    return F.when(F.col("direction") == "short", -1.0).otherwise(1.0)


def absent() -> Column:
    return F.coalesce(F.col("post_count"), F.lit(0)) == 0


def components() -> dict[str, Column]:
    momentum = scale(sign() * (0.4 * _or("roc_10", 0.0) + 0.6 * _or("roc_20", 0.0)), -15.0, 15.0)
    strength = F.when(F.col("direction") == "short", 100.0 - _or("rs_percentile", 50.0)).otherwise(_or("rs_percentile", 50.0))
    blend = 0.20 * F.col("raw") + 0.25 * F.col("engagement_weighted") + 0.25 * F.col("credibility_weighted") + 0.30 * F.col("unique_author")
    ratio = _or("adv_20", 0.0) / LIMITS["min_adv"]
    days = F.col("days_to_earnings")
    regime = scale(_or("trend_score", 0.0), -1.0, 1.0)
    return {
        "momentum": hundred(0.65 * momentum + 0.35 * strength),
        "volume": hundred(0.7 * scale(_or("rel_volume_20", 1.0), 0.6, 2.5) + 0.3 * F.when(_or("obv_slope_10", 0.0) > 0, 60.0).otherwise(40.0)),
        "sentiment": F.when(absent(), 50.0).otherwise(scale(sign() * blend, -0.6, 0.6)),
        "acceleration": F.when(absent(), 50.0).otherwise(scale(sign() * _or("acceleration", 0.0), -0.5, 0.5)),
        "catalyst": F.when(absent(), 50.0).otherwise(hundred(100.0 * _or("catalyst_quality", 0.0) * (1.0 - 0.5 * _or("rumour", 0.0)))),
        # an unconfirmed date counts as the earlier bound of its window
        "earnings": F.when(days.isNull(), 60.0).when(days <= EARNINGS_BUFFER, 0.0).otherwise(hundred(scale(days.cast("double"), EARNINGS_BUFFER, 30.0) - F.when(F.col("confirmed"), 0.0).otherwise(10.0))),
        "liquidity": F.when(ratio <= 0, 0.0).when(ratio <= 1.0, hundred(50.0 * ratio)).otherwise(hundred(50.0 + 25.0 * F.least(F.lit(2.0), ratio / 5.0) + 10.0 * F.least(F.lit(1.0), ratio / 20.0))),
        "regime": hundred(F.when(F.col("direction") == "short", 100.0 - regime).otherwise(regime) + 15.0 * _or("bias", 0.0) * sign()),
        "manipulation": F.when(absent(), 80.0).otherwise(hundred(100.0 * (1.0 - _or("manipulation_risk", 0.0)))),
        "data_confidence": data_confidence(),
    }


def data_confidence() -> Column:
    """100 less what the sample lacks: bars, posts, authors; a little for manipulation."""
    bars = F.when(F.col("bars_available") < 200, (200 - F.col("bars_available")) * 0.1).otherwise(0.0)
    sample = F.when(F.col("post_count") < MIN_POSTS, 20.0).otherwise(0.0) + F.when(F.col("authors") < MIN_AUTHORS, 15.0).otherwise(0.0) + 10.0 * _or("manipulation_risk", 0.0)
    return hundred(100.0 - bars - F.when(absent(), 20.0).otherwise(sample))


def overall(weights: dict[str, float] = WEIGHTS, unmeasured: dict[str, Column] | None = None) -> Column:
    """Weighted mean over the components that were measured."""
    has = {c: (~unmeasured[c] if unmeasured and c in unmeasured else F.lit(True)).cast("double") for c in weights}
    top = sum((F.col(c) * w * has[c] for c, w in weights.items()), F.lit(0.0))
    return F.try_divide(top, sum((has[c] * w for c, w in weights.items()), F.lit(0.0)))


def gate_failures() -> Column:
    """Names of all hard gates that a candidate fails; a gate on an unknown value does not fail."""
    x, days = LIMITS, F.col("days_to_earnings")
    crowd = ~absent() & F.col("requires_sentiment")
    rules = {
        "price_below_minimum": F.col("price") < x["min_price"],
        "price_above_maximum": F.col("price") > x["max_price"],
        "exchange_not_permitted": ~F.col("exchange").isin("AMERICA", "EUROPE", "ASIA"),
        "market_cap_too_small": F.col("market_cap_usd") < x["min_cap"],
        "illiquid": _or("adv_20", 0.0) < x["min_adv"],
        "leveraged_etf": F.col("is_etf"),
        "volatility_too_high": F.col("atr_pct") > x["max_atr_pct"],
        "volatility_too_low": (F.col("atr_pct") > 0) & (F.col("atr_pct") < x["min_atr_pct"]),
        "realised_volatility_too_high": F.col("hv_20") > x["max_hv"],
        "earnings_window": (days >= 0) & (days < x["min_days"]),
        "earnings_window_max": days > x["max_days"],
        "sentiment_thin": crowd & (F.col("authors") < x["min_authors"]),
        "sentiment_confidence_low": crowd & (F.col("confidence") < x["min_confidence"]),
        "manipulation_risk": ~absent() & (F.col("manipulation_risk") > x["max_manipulation"]),
        "reward_risk_floor": F.col("reward_risk") < x["min_reward_risk"],
    }
    return F.filter(F.array(*(F.when(rule, name) for name, rule in rules.items())), lambda v: v.isNotNull())


def status(extended_by_atr: float = 0.75) -> Column:
    """Where the price sits relative to the entry zone."""
    p, slack = F.col("price"), extended_by_atr * F.col("atr")
    far = F.when(F.col("direction") == "short", p < F.col("entry_low") - slack).otherwise(p > F.col("entry_high") + slack)
    return F.when(p.between(F.col("entry_low"), F.col("entry_high")), "actionable").when(far, "extended").otherwise("approaching")


#: Portfolio limits, in percent of equity but for the number of positions.
PORTFOLIO = {"max_positions": 10, "max_heat": 6.0, "max_position": 20.0, "max_sector": 30.0, "max_group": 40.0, "max_daily_loss": 2.0, "max_weekly_loss": 5.0}


def limit_breaches(allow_shorts: bool = False) -> Column:
    """All limits that a new position breaches, against the portfolio's state in the same row."""
    p, equity = PORTFOLIO, F.col("equity")
    share = 100.0 * F.col("notional") / equity
    solvent = equity > 0
    rules = {
        "kill_switch": F.col("kill_switch"),
        "no_equity": equity <= 0,
        "shorts_disabled": (F.col("direction") == "short") & F.lit(not allow_shorts),
        "already_held": F.col("held"),
        "position_count": F.col("open_positions") >= p["max_positions"],
        "heat": F.col("heat_pct") + 100.0 * F.col("dollar_risk") / equity > p["max_heat"] + 1e-9,
        "position_size": share > p["max_position"] + 1e-9,
        "sector": F.col("sector_pct") + share > p["max_sector"] + 1e-9,
        "correlated": F.col("group_pct") + share > p["max_group"] + 1e-9,
        "daily_loss": -100.0 * F.col("pnl_today") / equity >= p["max_daily_loss"],
        "weekly_loss": -100.0 * F.col("pnl_week") / equity >= p["max_weekly_loss"],
        "cash": (F.col("direction") == "long") & (F.col("notional") > F.col("cash")),
    }
    first = ("kill_switch", "no_equity")
    return F.filter(F.array(*(F.when(rule if name in first else solvent & rule, name) for name, rule in rules.items())), lambda v: v.isNotNull())

