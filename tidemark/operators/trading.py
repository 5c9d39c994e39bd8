"""Sizing, gates, scores, costs, exits and performance as expressions over trades; sequential runs as kernels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def size(trades: DataFrame, equity: float, risk: float = 0.0075, stop: float = 0.08, notional: float = 0.15, participation: float = 0.5) -> DataFrame:
    """Shares as the least of the risk, notional and volume caps, and the cap that binds."""
    z = trades.withColumn("by_risk", F.floor(F.lit(equity * risk) / (F.col("entry_price") * stop))).withColumn("by_notional", F.floor(F.lit(equity * notional) / F.col("entry_price"))).withColumn("by_volume", F.floor(F.col("shares") * participation))
    binding = F.when((F.col("by_risk") <= F.col("by_notional")) & (F.col("by_risk") <= F.col("by_volume")), "risk").when(F.col("by_notional") <= F.col("by_volume"), "notional").otherwise("volume")
    return z.withColumn("sized", F.least("by_risk", "by_notional", "by_volume")).withColumn("binding", binding)


def failed_gates(low: float = 50.0, high: float = 2000.0, volume: float = 5.0, cost: float = 0.005) -> Column:
    """All rules that a candidate fails, not only the first."""
    rules = F.array(
        F.when(F.col("entry_price") < low, "price_low"),
        F.when(F.col("entry_price") > high, "price_high"),
        F.when(F.col("shares") < volume, "volume"),
        F.when(F.col("cost") / (F.col("entry_price") * F.col("shares")) > cost, "cost"),
    )
    return F.filter(rules, lambda x: x.isNotNull())


def weighted(weights: dict[str, float]) -> Column:
    """Weighted mean over the components that were measured."""
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return F.try_divide(total, weight)


def costs() -> dict[str, Column]:
    shares, notional = F.col("shares"), F.col("entry_price") * F.col("shares")
    held = F.greatest(F.lit(0), F.datediff("exit_session", "entry_session"))
    return {
        "commission": F.greatest(F.lit(1.0), shares * 0.005),
        "fees": F.col("exit_price") * shares * 0.0000278 + F.least(F.lit(8.3), shares * 0.000166),
        "slippage": notional * (F.lit(0.0005) + 0.1 * F.sqrt(shares / 10000.0) * 0.01),
        "borrow": notional * 0.03 / 360 * held,
    }


def outcome() -> Column:
    return F.when(F.col("return_pct") > 0.05, "win").when(F.col("return_pct") < -0.05, "loss").otherwise("flat")


def metrics(trades: DataFrame, by: list[str]) -> DataFrame:
    t = trades.withColumn("outcome", outcome())
    won, lost = F.sum(F.greatest(F.col("net"), F.lit(0.0))), -F.sum(F.least(F.col("net"), F.lit(0.0)))
    return t.groupBy(*by).agg(F.count("*").alias("trades"), F.count_if(F.col("outcome") == "win").alias("wins"), F.count_if(F.col("outcome") == "loss").alias("losses"), F.sum("net").alias("net"), F.try_divide(won, lost).alias("profit_factor"), F.avg("return_pct").alias("expectancy"), F.median("return_pct").alias("median_return"))


def segments(trades: DataFrame) -> DataFrame:
    """Totals by each dimension's buckets: rows are stacked once, then summed on the map side."""
    band = F.when(F.col("shares") < 10, "small").when(F.col("shares") < 30, "mid").otherwise("large")
    pairs = {"strategy": F.col("strategy"), "regime": F.col("regime"), "outcome": outcome(), "size": band}
    rows = trades.select("net", F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("bucket")) for k, v in pairs.items()))).alias("x"))
    return rows.groupBy("x.dimension", "x.bucket").agg(F.count("*").alias("trades"), F.sum("net").alias("net"))


def equity(trades: DataFrame, start: float) -> DataFrame:
    """Equity and drawdown by day. Days are summed first, so the running window sees one row for each trading day."""
    d = trades.groupBy(F.col("exit_session").alias("session")).agg(F.sum("net").alias("pnl"))
    w = Window.partitionBy(F.lit(0)).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    e = d.withColumn("equity", start + F.sum("pnl").over(w)).withColumn("top", F.max("equity").over(w))
    return e.withColumn("drawdown_pct", (F.col("equity") - F.col("top")) / F.col("top") * 100)


def walk_forward(trades: DataFrame, train: int = 504, test: int = 126) -> DataFrame:
    """Overlapping folds: a trade is dealt to the few folds that hold its day by arithmetic, without a range join."""
    span = trades.agg(F.min("entry_session").alias("lo"), F.max("entry_session").alias("hi"))
    t = trades.crossJoin(F.broadcast(span))  # one row
    day, length = F.datediff("entry_session", "lo"), F.datediff("hi", "lo")
    last = F.least(F.floor(day / test), F.floor((length - (train + test)) / test))
    first = F.greatest(F.lit(0), F.floor((day - (train + test)) / test) + 1)
    t = t.withColumn("day", day).where(first <= last).withColumn("fold", F.explode(F.sequence(first, last)))
    out = F.col("day") >= F.col("fold") * test + train
    return t.groupBy((F.col("fold") + 1).alias("fold"), "strategy").agg(F.count_if(~out).alias("in_sample"), F.count_if(out).alias("out_sample"), F.coalesce(F.avg(F.when(out, F.col("return_pct"))), F.lit(0.0)).alias("out_return"))


def first_exit(bars: DataFrame, stop: float = 0.92, target: float = 1.15, hold: int = 20) -> DataFrame:
    """A position opened on every bar and its first exit: gap stop, gap target, stop, target, time. No row where none applies yet.

    The next `hold` rows come from the one window by symbol, without a join."""
    w = Window.partitionBy("symbol").orderBy("session").rowsBetween(1, hold)
    p = bars.select("symbol", F.col("session").alias("day"), F.col("open").alias("entry"), F.collect_list(F.struct("open", "high", "low")).over(w).alias("ahead"))
    entry = F.col("entry")

    def reason(r: Column, i: Column) -> Column:
        why = F.when(r["open"] <= entry * stop, "gap_stop").when(r["open"] >= entry * target, "gap_target").when(r["low"] <= entry * stop, "stop").when(r["high"] >= entry * target, "target").when(i == hold - 1, "time")
        return F.struct((i + 1).alias("held"), why.alias("reason"))

    first = F.get(F.filter(F.transform("ahead", reason), lambda x: x["reason"].isNotNull()), F.lit(0))
    return p.select("symbol", "day", first.alias("x")).where("x is not null").select("symbol", "day", "x.held", "x.reason")


def poisson_weights(ids: np.ndarray, resamples: int) -> np.ndarray:
    """Poisson(1) weights of rows in resamples, from the rows' own 64-bit ids: no stream, so partitions don't matter."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).view(np.uint64)[None] + np.arange(1, resamples + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    steps, total, p = [], 0.0, math.exp(-1.0)
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    return np.searchsorted(np.array(steps), u, side="right")


def bootstrap(trades: DataFrame, resamples: int = 2000) -> DataFrame:
    """Percentile interval of the mean return by the Poisson bootstrap: a trade's weight in a resample follows from a hash of its id,
    so another partitioning gives the same interval; each partition sends on resample sums, no group's returns."""

    def sums(frames):
        total: dict[str, np.ndarray] = {}
        for f in frames:
            for name, g in f.groupby("strategy"):
                acc = total.setdefault(name, np.zeros((resamples + 1, 2)))
                x, ids = g["return_pct"].to_numpy(float), g["id"].to_numpy()
                acc[0] += (x.sum(), len(x))
                for i in range(0, len(x), 500):
                    k = poisson_weights(ids[i : i + 500], resamples)
                    acc[1:, 0] += k @ x[i : i + 500]
                    acc[1:, 1] += k.sum(1)
        for name, acc in total.items():
            yield pd.DataFrame({"strategy": name, "i": np.arange(resamples + 1), "s": acc[:, 0], "n": acc[:, 1]})

    parts = trades.select("strategy", "return_pct", F.xxhash64("trade_id").alias("id")).mapInPandas(sums, "strategy string, i long, s double, n double")
    means = parts.groupBy("strategy", "i").agg((F.sum("s") / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    real = F.col("i") == 0
    return means.groupBy("strategy").agg(F.max(F.when(real, F.col("n"))).cast("long").alias("trades"), F.max(F.when(real, F.col("m"))).alias("mean"), F.percentile(F.when(~real, F.col("m")), F.lit(0.025)).alias("low"), F.percentile(F.when(~real, F.col("m")), F.lit(0.975)).alias("high"))


def ledger(trades: DataFrame, cash: float, positions: int = 8, share: float = 0.15) -> DataFrame:
    """Trades taken in order while cash and slots last. A run is one strategy in one year, with its own capital: sequential
    over a run's trades, parallel over runs."""

    def kernel(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["entry_session", "trade_id"], ignore_index=True)
        free, open_, taken, skipped, top, worst = cash, [], 0, 0, cash, 0.0
        for entry, leave, price, out, cost in zip(f["entry_session"], f["exit_session"], f["entry_price"], f["exit_price"], f["cost"], strict=True):
            still = []
            for day, value in open_:
                if day <= entry:
                    free += value
                else:
                    still.append((day, value))
            open_ = still
            shares = int(min(free, cash * share) // price) if price > 0 else 0
            if len(open_) >= positions or shares < 1:
                skipped += 1
                continue
            free -= shares * price
            open_.append((leave, shares * out - cost))
            taken += 1
            worth = free + sum(v for _, v in open_)
            top = max(top, worth)
            worst = min(worst, (worth - top) / top * 100)
        return pd.DataFrame({"strategy": [key[0]], "run": [key[1]], "taken": [taken], "skipped": [skipped], "final_cash": [free + sum(v for _, v in open_)], "max_drawdown_pct": [worst]})

    schema = "strategy string, run int, taken long, skipped long, final_cash double, max_drawdown_pct double"
    return trades.select("strategy", "trade_id", "entry_session", "exit_session", "entry_price", "exit_price", "cost").groupBy("strategy", F.year("entry_session").alias("run")).applyInPandas(kernel, schema)


def ledger_of_heads(some: DataFrame, days: DataFrame, low: float, cash: float, positions: int = 8, share: float = 0.15) -> DataFrame:
    """What ledger() gives, from a part of the trades, and whether it is sure of it: strategy, run, taken, skipped, final_cash,
    max_drawdown_pct, sure.

    days(strategy, entry_session, trades) counts all trades. some has a flag `head`: of each day the first trades in order, all of them up
    to some place, are heads; of the trades behind that place it has at least those of a price of at most `low`. A day whose slots are taken by its heads, or
    whose cash then buys nothing above `low`, needs no other trade; on any other day the run ends and is not sure."""

    def kernel(key: tuple, f: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        f, d = f.sort_values(["entry_session", "trade_id"], ignore_index=True), d.sort_values("entry_session", ignore_index=True)
        rows = list(zip(f["exit_session"], f["entry_price"], f["exit_price"], f["cost"], f["head"], strict=True))
        entries = f["entry_session"].to_numpy()
        free, open_, taken, top, worst, sure = cash, [], 0, cash, 0.0, True

        def release(today) -> None:
            nonlocal free, open_
            still = []
            for day, value in open_:
                if day <= today:
                    free += value
                else:
                    still.append((day, value))
            open_ = still

        def may_buy_unseen() -> bool:
            return len(open_) < positions and min(free, cash * share) > low

        for today, n in zip(d["entry_session"], d["trades"], strict=True):
            release(today)
            if len(open_) >= positions:
                continue
            a, b = (int(np.searchsorted(entries, today, s)) for s in ("left", "right"))
            for leave, price, out, cost, head in rows[a:b]:
                release(today)
                if len(open_) >= positions:
                    break
                if not head and may_buy_unseen():
                    sure = False
                    break
                shares = int(min(free, cash * share) // price) if price > 0 else 0
                if shares < 1:
                    continue
                free -= shares * price
                open_.append((leave, shares * out - cost))
                taken += 1
                worth = free + sum(v for _, v in open_)
                top = max(top, worth)
                worst = min(worst, (worth - top) / top * 100)
            if b - a < n:
                release(today)
                sure = sure and not may_buy_unseen()
            if not sure:
                break
        return pd.DataFrame({"strategy": [key[0]], "run": [key[1]], "taken": [taken], "skipped": [int(d["trades"].sum()) - taken], "final_cash": [free + sum(v for _, v in open_)], "max_drawdown_pct": [worst], "sure": [sure]})

    run = F.year("entry_session").alias("run")
    schema = "strategy string, run int, taken long, skipped long, final_cash double, max_drawdown_pct double, sure boolean"
    left = some.select("strategy", "trade_id", "entry_session", "exit_session", "entry_price", "exit_price", "cost", "head", run).groupBy("strategy", "run")
    return left.cogroup(days.select("strategy", "entry_session", "trades", run).groupBy("strategy", "run")).applyInPandas(kernel, schema)


def sensitivity(trades: DataFrame, stops: list[float]) -> DataFrame:
    rows = trades.withColumn("stop", F.explode(F.array(*(F.lit(s) for s in stops))))
    return rows.groupBy("stop", "strategy").agg(F.count("*").alias("trades"), F.avg(F.greatest(F.col("return_pct"), -F.col("stop"))).alias("expectancy"))
