"""Queries over trades and candidates: sizing, gates, scores, costs, exits, performance, segments, folds, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import band, ramp_down, ramp_up, rounded
from tidemark.operators import trading as tr
from tidemark.registry import query
from tidemark.sources.adapters import BARS, TRADES, bars, table, trades

_R = lambda x, n: f"round_even({x} + 3e-8, 6) + 0.0 as {n}"


@query("position_sizing", f"with {TRADES}, z as (select trade_id, entry_price, floor(750 / (entry_price * 0.08)) as by_risk, floor(15000 / entry_price) as by_notional, floor(shares * 0.5) as by_volume from trades) select trade_id, least(by_risk, by_notional, by_volume)::bigint as shares, case when by_risk <= by_notional and by_risk <= by_volume then 'risk' when by_notional <= by_volume then 'notional' else 'volume' end as binding from z")
def position_sizing(spark: SparkSession, sf: str) -> DataFrame:
    return tr.size(trades(spark, sf), equity=100_000.0).select("trade_id", F.col("sized").cast("long").alias("shares"), "binding")


@query("gates", f"with {TRADES} select trade_id, array_to_string(list_filter([case when entry_price < 50 then 'price_low' end, case when entry_price > 2000 then 'price_high' end, case when shares < 5 then 'volume' end, case when cost / (entry_price * shares) > 0.005 then 'cost' end], lambda x: x is not null), ',') as failed from trades")
def gates(spark: SparkSession, sf: str) -> DataFrame:
    return trades(spark, sf).select("trade_id", F.array_join(tr.failed_gates(), ",").alias("failed"))


@query("rejection_funnel", f"with {TRADES}, g as (select strategy, unnest([case when entry_price < 50 then 'price_low' end, case when entry_price > 2000 then 'price_high' end, case when shares < 5 then 'volume' end, case when cost / (entry_price * shares) > 0.005 then 'cost' end]) as reason from trades) select strategy, reason, count(*) as n from g where reason is not null group by all")
def rejection_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return trades(spark, sf).select("strategy", F.explode(tr.failed_gates()).alias("reason")).groupBy("strategy", "reason").agg(F.count("*").alias("n"))


_UP = "least(1.0, greatest(0.0, ({0} - ({1})) / (({2}) - ({1}))))"


@query("weighted_score", f"with {TRADES}, c as (select trade_id, {_UP.format('return_pct', '-5.0', '15.0')} * 100 as momentum, (1 - {_UP.format('cost', '1.0', '1.25')}) * 100 as liquidity, case when regime not like '5%' then least({_UP.format('shares', '5.0', '10.0')}, 1 - {_UP.format('shares', '40.0', '45.0')}) * 100 end as fit from trades) select trade_id, {_R('momentum', 'momentum')}, {_R('liquidity', 'liquidity')}, {_R('fit', 'fit')}, {_R('(momentum * 0.5 + liquidity * 0.3 + coalesce(fit * 0.2, 0)) / (0.8 + case when fit is not null then 0.2 else 0 end)', 'score')} from c")
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf)
    parts = t.select("trade_id", (ramp_up(F.col("return_pct"), -5.0, 15.0) * 100).alias("momentum"), (ramp_down(F.col("cost"), 1.0, 1.25) * 100).alias("liquidity"), F.when(~F.col("regime").startswith("5"), band(F.col("shares"), 10.0, 40.0, 5.0) * 100).alias("fit"))
    scored = parts.withColumn("score", tr.weighted({"momentum": 0.5, "liquidity": 0.3, "fit": 0.2}))
    return scored.select("trade_id", *(rounded(c).alias(c) for c in ("momentum", "liquidity", "fit", "score")))


@query("scan_rank", f"with {TRADES}, s as (select entry_session, trade_id, round_even(return_pct + 3e-8, 6) as score from trades), r as (select *, row_number() over (partition by entry_session order by score desc, trade_id) as rank from s) select cast(entry_session as varchar) as session, trade_id, score, rank from r where rank <= 5")
def scan_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The five best candidates of each session (a top-k report)."""
    s = trades(spark, sf).select("entry_session", "trade_id", F.bround(F.col("return_pct") + 3e-8, 6).alias("score"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("entry_session").orderBy(F.desc("score"), "trade_id")))
    return r.where("rank <= 5").select(F.col("entry_session").cast("string").alias("session"), "trade_id", "score", "rank")


@query("cost_model", f"with {TRADES}, n as (select *, entry_price * shares as notional from trades) select trade_id, {_R('greatest(1.0, 0.005 * shares)', 'commission')}, {_R('exit_price * shares * 0.0000278 + least(8.3, shares * 0.000166)', 'fees')}, {_R('notional * (0.0005 + 0.1 * sqrt(shares / 10000.0) * 0.01)', 'slippage')}, {_R('notional * 0.03 / 360 * greatest(0, exit_session - entry_session)', 'borrow')} from n")
def cost_model(spark: SparkSession, sf: str) -> DataFrame:
    costs = tr.costs()
    return trades(spark, sf).select("trade_id", *(rounded(v).alias(k) for k, v in costs.items()))


_TM = f"with {TRADES}, o as (select *, case when return_pct > 0.05 then 'win' when return_pct < -0.05 then 'loss' else 'flat' end as outcome from trades)"


@query("trade_metrics", f"{_TM} select strategy, count(*) as trades, count(*) filter (outcome = 'win') as wins, count(*) filter (outcome = 'loss') as losses, {_R('sum(net)', 'net')}, {_R('sum(case when net > 0 then net else 0 end) / nullif(-sum(case when net < 0 then net else 0 end), 0)', 'profit_factor')}, {_R('avg(return_pct)', 'expectancy')}, {_R('median(return_pct)', 'median_return')} from o group by strategy")
def trade_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = tr.metrics(trades(spark, sf), ["strategy"])
    return m.select("strategy", "trades", "wins", "losses", *(rounded(c).alias(c) for c in ("net", "profit_factor", "expectancy", "median_return")))


@query("segment_metrics", f"{_TM}, s as (select unnest(['strategy', 'regime', 'outcome', 'size']) as dimension, unnest([strategy, regime, outcome, case when shares < 10 then 'small' when shares < 30 then 'mid' else 'large' end]) as bucket, net from o) select dimension, bucket, count(*) as trades, {_R('sum(net)', 'net')} from s group by all")
def segment_metrics(spark: SparkSession, sf: str) -> DataFrame:
    s = tr.segments(trades(spark, sf))
    return s.select("dimension", "bucket", "trades", rounded("net").alias("net"))


_EQ = f"with {TRADES}, d as (select exit_session as session, sum(net) as pnl from trades group by exit_session), e as (select *, 100000 + sum(pnl) over (order by session rows unbounded preceding) as equity from d), p as (select *, max(equity) over (order by session rows unbounded preceding) as top from e)"


@query("equity_drawdown", f"{_EQ} select cast(session as varchar) as session, {_R('pnl', 'pnl')}, {_R('equity', 'equity')}, {_R('(equity - top) / top * 100', 'drawdown_pct')} from p")
def equity_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    e = tr.equity(trades(spark, sf), 100_000.0)
    return e.select(F.col("session").cast("string").alias("session"), *(rounded(c).alias(c) for c in ("pnl", "equity", "drawdown_pct")))


@query("gross_vs_net", f"with {TRADES} select strategy, {_R('sum(gross)', 'gross_usd')}, {_R('sum(net)', 'net_usd')}, {_R('sum(cost)', 'cost_usd')} from trades group by strategy")
def gross_vs_net(spark: SparkSession, sf: str) -> DataFrame:
    g = trades(spark, sf).groupBy("strategy").agg(F.sum("gross").alias("gross_usd"), F.sum("net").alias("net_usd"), F.sum("cost").alias("cost_usd"))
    return g.select("strategy", *(rounded(c).alias(c) for c in ("gross_usd", "net_usd", "cost_usd")))


@query("reconciliation", f"{_EQ}, t as (select 100000 + sum(net) as total from trades) select abs(arg_max(equity, session) - any_value(total)) <= 1.0 as reconciled, count(*) as sessions from p, t")
def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf)
    total = t.agg((F.lit(100_000.0) + F.sum("net")).alias("total"))
    e = tr.equity(t, 100_000.0).agg(F.max_by("equity", "session").alias("last"), F.count("*").alias("sessions"))
    return e.crossJoin(total).select((F.abs(F.col("last") - F.col("total")) <= 1.0).alias("reconciled"), "sessions")


@query("walk_forward", f"with {TRADES}, r as (select min(entry_session) as lo, max(entry_session) as hi from trades), f as (select row_number() over (order by s) as fold, s, s + 504 as split, s + 630 as stop from (select lo + cast(unnest(generate_series(0, cast(hi - lo as bigint) - 630, 126)) as int) as s from r)) select fold, strategy, count(*) filter (entry_session < split) as in_sample, count(*) filter (entry_session >= split) as out_sample, {_R('coalesce(avg(case when entry_session >= split then return_pct end), 0.0)', 'out_return')} from f join trades on entry_session >= s and entry_session < stop group by all")
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    return tr.walk_forward(trades(spark, sf)).select("fold", "strategy", "in_sample", "out_sample", rounded("out_return").alias("out_return"))


@query("exit_decision", f"with {BARS}, p as (select symbol, session as day, open as entry, row_number() over (partition by symbol order by session) as rn from bars), o as (select *, rn + unnest(range(1, 21)) as target from p), b as (select *, row_number() over (partition by symbol order by session) as rn from bars), j as (select o.symbol, o.day, b.rn - o.rn as held, case when b.open <= entry * 0.92 then 'gap_stop' when b.open >= entry * 1.15 then 'gap_target' when b.low <= entry * 0.92 then 'stop' when b.high >= entry * 1.15 then 'target' when b.rn - o.rn = 20 then 'time' end as reason from o join b on b.symbol = o.symbol and b.rn = o.target) select symbol, cast(day as varchar) as day, min(held) as held, arg_min(reason, held) as reason from j where reason is not null group by symbol, day")
def exit_decision(spark: SparkSession, sf: str) -> DataFrame:
    """A position opened on every bar, closed by the first exit that applies within 20 rows."""
    x = tr.first_exit(bars(spark, sf))
    return x.select("symbol", F.col("day").cast("string").alias("day"), "held", "reason")


@query("trailing_stop", f"with {BARS} select symbol, cast(session as varchar) as session, {_R('max(high) over (partition by symbol order by session rows unbounded preceding) * 0.9', 'stop')} from bars")
def trailing_stop(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return bars(spark, sf).select("symbol", F.col("session").cast("string").alias("session"), rounded(F.max("high").over(w) * 0.9).alias("stop"))


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    b = tr.bootstrap(trades(spark, sf))
    return b.select("strategy", "trades", *(rounded(c).alias(c) for c in ("mean", "low", "high")))


HEAD, MORE, LOW_SHARE, HEADS = 512, 8, 0.1, 2_000_000  # orders of a day, times as many when they don't do; share of the cheapest lines; orders that are broadcast


def ledger(spark: SparkSession, sf: str, cash: float, head: int = HEAD, low_share: float = LOW_SHARE) -> DataFrame:
    """tr.ledger() over all trades, without sending them all.

    Trades of a day are taken in the order of their ids, which begin with the order's key, and few fill the slots. So the ledger is run over the lines of
    the first orders of each day and over the cheapest lines of the others; all lines are only counted by day. The kernel knows where that
    is not enough: such runs are done again with more orders of a day, and at last over all of their trades."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    day, price = F.to_date("o_orderdate"), F.col("l_extendedprice") / F.col("l_quantity")
    o = o.select("o_orderkey", "o_orderdate", "o_orderpriority", day.alias("day"), F.concat(F.col("o_orderkey").cast("string"), F.lit("-")).alias("key"))
    sizes = {r["day"]: r["n"] for r in o.groupBy("day").agg(F.count("*").alias("n")).collect()}  # one row a day
    if None in sizes or all(n <= head for n in sizes.values()):
        return tr.ledger(trades(spark, sf), cash)
    low = l.agg(F.percentile_approx(F.when(price > 0, price), low_share)).first()[0] or 0.0
    days = trades(spark, sf).groupBy("strategy", "entry_session").agg(F.count("*").alias("trades"))
    days = spark.createDataFrame(days.collect(), days.schema)  # one row a strategy and day
    run, runs, done = F.struct("strategy", F.year("entry_session")), None, []

    def left(some: DataFrame) -> DataFrame:
        return some if runs is None else some.where(F.col("strategy").isin(sorted({s for s, _ in runs})) & run.isin(*(F.struct(F.lit(s), F.lit(y)) for s, y in runs)))

    while any(n > head for n in sizes.values()):
        nth = F.row_number().over(Window.partitionBy("day").orderBy("key"))
        cuts = F.broadcast(spark.createDataFrame(o.select("day", "key", nth.alias("n")).where(F.col("n") == head).select("day", "key").collect(), "day date, cut string"))  # one row a day
        marked = o.join(cuts, "day", "left").withColumn("head", F.coalesce(F.col("key") <= F.col("cut"), F.lit(True)))
        first, rest = marked.where("head"), marked.where("not head")
        first = F.broadcast(first) if sum(min(n, head) for n in sizes.values()) <= HEADS else first
        some = trades(spark, sf, orders=first).withColumn("head", F.lit(True)).unionByName(trades(spark, sf, l.where(price.between(0, low)), rest).withColumn("head", F.lit(False)))
        found = tr.ledger_of_heads(left(some), left(days), low, cash).collect()  # one row a strategy and year
        done += [r for r in found if r["sure"]]
        runs = sorted((r["strategy"], r["run"]) for r in found if not r["sure"])
        years = {y for _, y in runs}
        o, sizes, head = o.where(F.year("day").isin(years)), {d: n for d, n in sizes.items() if d.year in years}, head * MORE
    sure = spark.createDataFrame(done, "strategy string, run int, taken long, skipped long, final_cash double, max_drawdown_pct double, sure boolean").drop("sure")
    return sure.unionByName(tr.ledger(left(trades(spark, sf, orders=o)), cash)) if runs else sure


@query("backtest_ledger")
def backtest_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Cash-constrained ledger of each strategy and year: one sequential kernel for each run."""
    r = ledger(spark, sf, 100_000.0)
    return r.select("strategy", "run", "taken", "skipped", rounded("final_cash").alias("final_cash"), rounded("max_drawdown_pct").alias("max_drawdown_pct"))


@query("parameter_sensitivity", f"with {TRADES}, p as (select unnest([5.0, 10.0, 15.0]) as stop) select stop, strategy, count(*) as trades, {_R('avg(greatest(return_pct, -stop))', 'expectancy')} from trades, p group by all")
def parameter_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return tr.sensitivity(trades(spark, sf), [5.0, 10.0, 15.0]).select("stop", "strategy", "trades", rounded("expectancy").alias("expectancy"))
