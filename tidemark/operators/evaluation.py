"""Fills, performance ratios with their floors, warnings, splits and stitched equity over trades and daily equity.

Trades are aggregated by strategy on the map side; windows without a partition see one row a trading day and strategy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS, MIN_OBSERVATIONS, ZERO_VARIANCE, Z95, BREAKEVEN = 252, 20, 1e-9, 1.96, 0.05
MIN_VALIDATED, MIN_CONFIDENT = 30, 100
PARTICIPATION, HALF_SPREAD, IMPACT, GAP_SLIP = 0.1, 0.0005, 0.1, 0.001


def entry_fill(orders: DataFrame) -> DataFrame:
    """Orders(symbol, order_type, side, level, shares) joined with their next bar: filled shares and price, null where nothing is filled.

    A limit gets the better of its level and the open, a stop entry the worse; shares are capped at a share of the bar's volume.
    """
    buy = F.col("side") > 0
    limit = F.when(buy, F.when(F.col("low") <= F.col("level"), F.least("open", "level"))).otherwise(F.when(F.col("high") >= F.col("level"), F.greatest("open", "level")))
    stop = F.when(buy, F.when(F.col("high") >= F.col("level"), F.greatest("open", "level"))).otherwise(F.when(F.col("low") <= F.col("level"), F.least("open", "level")))
    raw = F.when(F.col("order_type") == "market_on_open", F.col("open")).when(F.col("order_type") == "limit", limit).otherwise(stop)
    gapped = (F.col("order_type") == "stop_entry") & F.when(buy, F.col("open") > F.col("level")).otherwise(F.col("open") < F.col("level"))
    o = orders.withColumn("raw", F.when(F.col("volume") > 0, raw)).withColumn("filled", F.least(F.col("shares"), F.floor(F.col("volume") * PARTICIPATION)))
    slip = IMPACT * F.sqrt(F.col("filled") / F.col("volume")) * 0.01 + F.when(gapped, GAP_SLIP).otherwise(0.0)
    ok = F.col("raw").isNotNull() & (F.col("filled") > 0)
    return o.select("*", F.when(ok, F.col("raw") + F.col("side") * F.col("raw") * (HALF_SPREAD + slip)).alias("fill_price"), F.when(ok, F.col("filled")).otherwise(0).alias("fill_shares"), (ok & (F.col("filled") < F.col("shares"))).alias("partial"))


def daily_returns(trades: DataFrame, capital: float) -> DataFrame:
    """Equity, its return, high-water mark and days under water of each strategy and exit day."""
    day = trades.groupBy("strategy", F.col("exit_session").alias("session")).agg(F.sum("net").alias("pnl"))
    w = Window.partitionBy("strategy").orderBy("session")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    e = day.withColumn("equity", F.lit(capital) + F.sum("pnl").over(so_far))
    e = e.withColumn("ret", F.col("pnl") / (F.col("equity") - F.col("pnl"))).withColumn("top", F.greatest(F.lit(capital), F.max("equity").over(so_far)))
    e = e.withColumn("drawdown", (F.col("top") - F.col("equity")) / F.col("top") * 100).withColumn("peak", F.sum((F.col("equity") >= F.col("top")).cast("int")).over(so_far))
    return e.withColumn("under", F.sum((F.col("equity") < F.col("top")).cast("int")).over(Window.partitionBy("strategy", "peak").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)))


def ratios(trades: DataFrame, capital: float) -> DataFrame:
    """Sharpe, Sortino and Calmar ratios; null with a reason where the sample can't support them."""
    d = daily_returns(trades, capital)
    down = F.when(F.col("ret") < 0, F.col("ret"))
    g = d.groupBy("strategy").agg(
        F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.count(down).alias("n_down"), F.stddev_samp(down).alias("sd_down"),
        F.max("drawdown").alias("max_drawdown_pct"), F.max("under").alias("max_drawdown_days"), F.max_by("equity", "session").alias("last"), F.datediff(F.max("session"), F.min("session")).alias("days"),
    )
    year, enough = math.sqrt(TRADING_DAYS), F.col("n") >= MIN_OBSERVATIONS
    growth = F.when((F.col("days") > 0) & (F.col("last") > 0), F.pow(F.col("last") / capital, F.lit(365.0) / F.col("days")) - 1)
    return g.select(
        "strategy", "n", "max_drawdown_pct", "max_drawdown_days",
        F.when(enough & (F.col("sd") >= ZERO_VARIANCE), F.col("mean") / F.col("sd") * year).alias("sharpe"),
        F.when(enough & (F.col("n_down") >= 2) & (F.col("sd_down") >= ZERO_VARIANCE), F.col("mean") / F.col("sd_down") * year).alias("sortino"),
        F.when(enough & (F.col("max_drawdown_pct") > 0), growth * 100 / F.col("max_drawdown_pct")).alias("calmar"),
        F.when(~enough, "insufficient_sample").when(F.col("sd") < ZERO_VARIANCE, "zero_variance").when(F.col("n_down") < 2, "insufficient_downside_sample").otherwise("ok").alias("reason"),
    )


def performance(trades: DataFrame, by: list[str], capital: float) -> DataFrame:
    """Counts, means, interval of the win rate, turnover and concentration of profit."""
    won, lost = F.col("return_pct") > BREAKEVEN, F.col("return_pct") < -BREAKEVEN
    m = trades.groupBy(*by).agg(
        F.count("*").alias("trades"), F.count_if(won).alias("wins"), F.count_if(lost).alias("losses"), F.avg("net").alias("expectancy"), F.stddev_samp("net").alias("sd"), F.avg(F.when(won, F.col("net"))).alias("average_win"), F.avg(F.when(lost, -F.col("net"))).alias("average_loss"),
        F.sum(F.greatest(F.lit(0.0), F.col("net"))).alias("profit"), F.sum(F.greatest(F.lit(0.0), -F.col("net"))).alias("loss"), F.sum("gross").alias("gross"), F.sum("net").alias("net"), (F.sum((F.col("entry_price") + F.col("exit_price")) * F.col("shares")) / capital).alias("turnover"),
    )
    top = trades.groupBy(*by, "symbol").agg(F.sum(F.greatest(F.lit(0.0), F.col("net"))).alias("p")).groupBy(*by).agg(F.max("p").alias("top_symbol"))
    n = F.col("wins") + F.col("losses")
    rate = F.try_divide(F.col("wins"), n)
    half = Z95 * F.sqrt(rate * (1 - rate) / n)
    return m.join(top, by).withColumns({
        "win_loss_ratio": F.try_divide("wins", "losses"), "profit_factor": F.try_divide("profit", "loss"), "win_rate": rate, "win_rate_low": F.greatest(F.lit(0.0), rate - half), "win_rate_high": F.least(F.lit(1.0), rate + half),
        "top_symbol_pct": F.coalesce(F.try_divide(F.col("top_symbol") * 100, F.col("profit")), F.lit(0.0)),
    })


def concentration(trades: DataFrame, by: list[str], sectors: DataFrame) -> DataFrame:
    """Shares of all profit, in percent, that the three best trades and the best sector made; 0 without profit.

    Spark keeps three rows a group and task before it sorts; sectors are joined after profits are summed up by symbol."""
    won = trades.where("net > 0")
    total = won.groupBy(*by).agg(F.sum("net").alias("profit"))
    best = won.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("net")))).where("place <= 3").groupBy(*by).agg(F.sum("net").alias("top3"))
    of_symbol = won.groupBy(*by, "symbol").agg(F.sum("net").alias("p"))
    sector = F.coalesce("sector", F.lit("unknown"))
    of_sector = of_symbol.join(sectors.select("symbol", "sector"), "symbol", "left").groupBy(*by, sector.alias("sector")).agg(F.sum("p").alias("p")).groupBy(*by).agg(F.max("p").alias("best_sector"))
    out = total.join(best, by).join(of_sector, by)
    return out.select(*by, (F.col("top3") * 100 / F.col("profit")).alias("top3_pct"), (F.col("best_sector") * 100 / F.col("profit")).alias("top_sector_pct"))


def significance() -> Column:
    """Why a sample's expectancy can't be told from 0, null where it can: too few trades, or 0 within 1.96 standard errors of it."""
    spans = F.abs("expectancy") <= Z95 * F.coalesce("sd", F.lit(0.0)) / F.sqrt("trades")
    return F.when(F.col("trades") < MIN_VALIDATED, "trade_count_below_floor").when(spans, "expectancy_interval_includes_zero")


def warnings() -> Column:
    """What a reader must know before trusting the headline figures."""
    wins = F.coalesce("win_loss_ratio", F.lit(float("inf")))
    rules = {
        "not_significant": F.col("significance").isNotNull(),
        "too_few_trades": F.col("trades") < MIN_VALIDATED,
        "few_trades_for_ratio": (F.col("trades") >= MIN_VALIDATED) & (F.col("trades") < MIN_CONFIDENT) & (wins > 1),
        "wins_but_loses_money": (F.col("expectancy") <= 0) & (wins > 1),
        "loss_over_twice_win": (F.col("average_win") > 0) & (F.col("average_loss") > 2 * F.col("average_win")),
        "three_trades": F.col("top3_pct") > 50.0,
        "one_symbol": F.col("top_symbol_pct") > 40.0,
        "one_sector": F.col("top_sector_pct") > 40.0,
        "edge_lost_to_costs": (F.col("gross") > 0) & (F.col("net") <= 0),
        "no_losses": (F.col("losses") == 0) & (F.col("trades") > 0),
    }
    return F.filter(F.array(*(F.when(r, name) for name, r in rules.items())), lambda v: v.isNotNull())


def judged(trades: DataFrame, by: list[str], capital: float, sectors: DataFrame) -> DataFrame:
    """performance() with concentration, significance (null: significant) and warnings."""
    shares = {c: F.coalesce(c, F.lit(0.0)) for c in ("top3_pct", "top_sector_pct")}
    p = performance(trades, by, capital).join(concentration(trades, by, sectors), by, "left").withColumns(shares)
    return p.withColumn("significance", significance()).withColumn("warnings", warnings())


def report_sections(trades: DataFrame, by: list[str], capital: float, sectors: DataFrame, train: int = 504, test: int = 126) -> DataFrame:
    """A section for each book: on what its evidence rests, its folds, its headline and its warnings.

    Each fold's test window follows its training window and they tile the time after the first one, so a trade's fold is arithmetic on its
    entry day. A book whose history is shorter than one fold is judged on all its trades, but that never counts as evidence. A book with
    folds but without trades in them has a section, too. Folds start from the same capital; their returns are chained.
    """
    day, span = F.datediff("entry_session", "lo"), F.datediff("hi", "lo")
    books = trades.groupBy(*by).agg(F.min("entry_session").alias("lo"), F.max("entry_session").alias("hi"))
    books = books.withColumn("folds", F.greatest(F.lit(0), F.floor((span - (train + test)) / test) + 1).cast("int"))
    dealt = trades.join(books, by).withColumn("fold", F.when(F.col("folds") == 0, 0).otherwise(F.floor((day - train) / test)).cast("int"))
    dealt = dealt.where((F.col("fold") >= 0) & (F.col("fold") < F.greatest(F.lit(1), F.col("folds"))))
    per_fold = dealt.groupBy(*by, "fold").agg(F.count("*").alias("n"), F.sum("net").alias("net"))
    chained = per_fold.groupBy(*by).agg(F.count("*").cast("int").alias("folds_with_trades"), F.max("n").alias("most_in_a_fold"), ((F.exp(F.sum(F.ln(F.greatest(F.lit(1e-9), 1 + F.col("net") / capital)))) - 1) * 100).alias("chained_return_pct"))
    shown = judged(dealt, by, capital, sectors).select(*by, "trades", "expectancy", "significance", "warnings").join(chained, by)
    s = books.join(shown, by, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("trades", "folds_with_trades", "most_in_a_fold")})
    reason = F.when(F.col("folds") == 0, "insufficient_history").when(F.col("trades") == 0, "zero_completed_trades").otherwise(F.col("significance"))
    s = s.withColumn("evidence", F.when(F.col("folds") > 0, "out_of_sample").otherwise("in_sample")).withColumn("reason", reason)
    s = s.withColumn("headline", F.when(reason.isNull(), "significant").otherwise("insufficient evidence"))
    return s.select(*by, "lo", "hi", "evidence", "folds", "folds_with_trades", "most_in_a_fold", "trades", "expectancy", "chained_return_pct", "headline", "reason", F.coalesce(F.col("warnings"), F.array().cast("array<string>")).alias("warnings"))


def objective() -> Column:
    """The win/loss ratio where edge, payoff and profit factor pass, else 0; 0 too without losses."""
    bad = (F.col("expectancy") <= 0) | ((F.col("average_win") > 0) & (F.col("average_loss") > 2 * F.col("average_win"))) | (F.coalesce("profit_factor", F.lit(float("inf"))) <= 1.0)
    return F.when(bad | F.col("win_loss_ratio").isNull(), 0.0).otherwise(F.col("win_loss_ratio"))


def chronological_split(trades: DataFrame, holdout: float = 0.25) -> DataFrame:
    """Trades with the block of their entry day: train, validation, test; the blocks are contiguous and disjoint."""
    span = trades.agg(F.min("entry_session").alias("lo"), F.max("entry_session").alias("hi"))
    t = trades.crossJoin(F.broadcast(span))  # one row
    total = F.datediff("hi", "lo") + 1
    test = F.greatest(F.lit(1), F.floor(total * holdout))
    train = (total - test) - F.floor((total - test) / 2)
    day = F.datediff("entry_session", "lo")
    return t.withColumn("block", F.when(day < train, "train").when(day < total - test, "validation").otherwise("test"))


def stitched_equity(trades: DataFrame, capital: float) -> DataFrame:
    """Yearly folds, each with its own capital, chained into one compounding series with its drawdown."""
    day = trades.groupBy(F.year("exit_session").alias("fold"), F.col("exit_session").alias("session")).agg(F.sum("net").alias("pnl"))
    own = Window.partitionBy("fold").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    d = day.withColumn("equity", F.lit(capital) + F.sum("pnl").over(own))
    first = F.first("equity").over(own)
    d = d.withColumn("relative", F.col("equity") / first)
    folds = d.groupBy("fold").agg(F.max_by("relative", "session").alias("growth"))
    before = F.coalesce(F.sum(F.ln("growth")).over(Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # one row a fold
    d = d.join(F.broadcast(folds.select("fold", F.exp(before).alias("base"))), "fold").withColumn("stitched", F.col("base") * F.col("relative") * capital)
    top = F.greatest(F.lit(capital), F.max("stitched").over(Window.orderBy("session").rowsBetween(Window.unboundedPreceding, 0)))  # one row a day
    return d.withColumn("drawdown_pct", (top - F.col("stitched")) / top * 100)
