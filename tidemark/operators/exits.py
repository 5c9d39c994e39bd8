"""Exits of open positions bar by bar: gaps, stops that trail, staged targets, time, moving average, reports, and partial fills.

Positions and bars of a symbol meet in one task, streamed by no join of rows with rows: each position walks its own bars from the one
after its entry until it is closed. For one bar, in this order, the first that applies counts:

1. the open is beyond the stop, or beyond the next target (a gap: filled at the open);
2. both lie within the bar: the stop, or with `optimistic` the target; then the stop alone, the target alone;
3. the time stop is due: at the close, whole;
4. the close has crossed the moving average against the position; 5. a report is near: at the close.

A bar without volume decides nothing. After the decision the stop trails behind the best close since entry by a multiple of the true
range known at that close; it never loosens. Fills but the time stop are capped at a share of the bar's volume, the rest stays open.

Defined results: a position whose symbol has no later bar has no row; one still open at the end has the exits it had so far, and with
`close_at_end` one more at its last close; null stops, targets, averages and dates don't apply; repeated position ids each have their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.kernels import smoothed_frame

SCHEMA = "position_id string, symbol string, session date, reason string, price double, shares long, remaining long, target_index int, stop double"


@dataclass(frozen=True)
class Rules:
    """Fixed shares of staged targets, and how fills cost."""

    fractions: tuple[float, ...] = (0.5, 1.0)
    trail: float | None = 2.0  # true ranges behind the best close
    average: bool = False  # leave when the close crosses bars.average
    report_days: int | None = None
    optimistic: bool = False
    participation: float | None = None  # most of a bar's volume
    spread: float = 0.0  # of the price
    impact: float = 0.0  # of the price, for a fill of the whole volume
    gap_factor: float = 2.0  # times the impact where a gap is filled
    close_at_end: bool = False


def _crossed(bar, level: float, below: bool) -> tuple[bool, float, bool]:
    """Whether the bar reaches a level from above (or below), at what price, and whether its open was already beyond."""
    if level != level:
        return False, 0.0, False
    gapped = bar["open"] <= level if below else bar["open"] >= level
    hit = gapped or (bar["low"] <= level if below else bar["high"] >= level)
    return hit, bar["open"] if gapped else level, gapped


def walk(p: dict, bars: list[dict], rules: Rules) -> list[tuple]:
    """Exits of a position over the bars after its entry."""
    sign = 1 if p["direction"] == "long" else -1
    stop, first_stop, left, best, done, out = p["stop"], p["stop"], int(p["shares"]), p["entry_price"], 0, []
    targets = [t for t in (p["target1"], p["target2"]) if t == t]

    def leave(bar, reason: str, raw: float, wanted: int, gapped: bool = False, capped: bool = True, target: int | None = None) -> int:
        most = wanted if rules.participation is None or not capped else min(wanted, int(rules.participation * bar["volume"]))
        if most <= 0:
            return 0
        cost = raw * (rules.spread + rules.impact * most / max(bar["volume"], 1e-9) * (rules.gap_factor if gapped else 1.0))
        name = ("target" if most >= left else "partial_target") if reason == "target" else reason
        out.append((p["position_id"], p["symbol"], bar["session"], name, raw - sign * cost, most, left - most, target, stop))
        return most

    for k, bar in enumerate(bars):
        if left == 0:
            break
        if bar["volume"] > 0:
            hit, at, gapped = _crossed(bar, stop, sign > 0)
            level = targets[done] if done < len(targets) else float("nan")
            reached, there, jumped = _crossed(bar, level, sign < 0)
            stop_name = "gap_through_stop" if gapped else "trailing_stop" if stop != first_stop else "stop_loss"
            share = rules.fractions[done] if done < len(rules.fractions) else 1.0
            wanted = max(1, min(round(int(p["shares"]) * share), left))
            use_target = reached and not (hit and gapped) and (jumped or not hit or rules.optimistic)
            if hit and not use_target:
                left -= leave(bar, stop_name, at, left, gapped)
            elif use_target:
                filled = leave(bar, "target", there, wanted, jumped, target=done)
                left -= filled
                done += filled > 0
            elif k + 1 >= p["hold"]:
                left -= leave(bar, "time_stop", bar["close"], left, capped=False)
            elif rules.average and bar["average"] == bar["average"] and (bar["close"] < bar["average"]) == (sign > 0):
                left -= leave(bar, "moving_average_exit", bar["close"], left)
            elif rules.report_days is not None and p["report"] is not None and (p["report"] - bar["session"]).days <= rules.report_days:
                left -= leave(bar, "pre_earnings_exit", bar["close"], left)
        best = max(best, bar["close"]) if sign > 0 else min(best, bar["close"])
        if rules.trail is not None and bar["atr"] == bar["atr"] and bar["atr"] > 0:
            behind = best - sign * rules.trail * bar["atr"]
            stop = behind if stop != stop else max(stop, behind) if sign > 0 else min(stop, behind)
    if left and rules.close_at_end and bars:
        leave(bars[-1], "end", bars[-1]["close"], left, capped=False)
    return out


def exits(positions: DataFrame, bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rows of SCHEMA for positions(position_id, symbol, direction, entry_session, entry_price, shares, stop, target1, target2, hold, report)
    and bars(symbol, session, open, high, low, close, volume, atr, average); where bars have no atr, it is the one of 14 bars."""
    ranged = "atr" in bars.columns

    def both(held: pd.DataFrame, series: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(held) and len(series):
            series = series.sort_values("session", ignore_index=True)
            if not ranged:
                series["atr"] = smoothed_frame(series, ("atr14",))["atr14"]
            days = series["session"].to_numpy()
            table = series.to_dict("records")
            for p in held.to_dict("records"):
                p["report"] = None if pd.isna(p["report"]) else p["report"]
                first = int(np.searchsorted(days, p["entry_session"], "right"))
                rows += walk(p, table[first:] if rules.close_at_end else table[first : first + int(p["hold"]) + 1], rules)
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
        return out.astype({"target_index": "Int32"})

    held = positions.select("position_id", "symbol", "direction", "entry_session", "entry_price", "shares", "stop", "target1", "target2", "hold", "report")
    series = bars.select("symbol", "session", "open", "high", "low", "close", "volume", *(["atr"] if ranged else []), "average")
    return held.groupBy("symbol").cogroup(series.groupBy("symbol")).applyInPandas(both, SCHEMA)


def trailed(positions: DataFrame, bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """position_id and the last stop of each position that left by one that had trailed."""
    return exits(positions, bars, rules).where("reason = 'trailing_stop'").select("position_id", "session", "stop")
