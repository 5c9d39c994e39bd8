"""Queries over trades: fills, ratios, warnings, objective, splits, stitched equity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import by_symbol, rounded
from tidemark.operators import evaluation as ev
from tidemark.registry import query
from tidemark.sources.adapters import BARS, SECURITIES, TRADES, bars, securities, trades

_r = lambda x, n: f"round_even({x} + 3e-8, 6) + 0.0 as {n}"
CAPITAL = 100_000.0


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("rn", F.row_number().over(by_symbol()))
    nxt = {c: F.lead(c).over(by_symbol()) for c in ("session", "open", "high", "low", "volume")}
    o = b.select("symbol", F.col("session").alias("placed"), "rn", F.col("close").alias("last"), *(x.alias(c) for c, x in nxt.items())).where("session is not null")
    kind = F.element_at(F.array(F.lit("market_on_open"), F.lit("limit"), F.lit("stop_entry")), F.col("rn") % 3 + 1)
    return o.withColumns({"order_type": kind, "side": F.when(F.col("rn") % 2 == 0, 1.0).otherwise(-1.0), "level": F.col("last") * (0.98 + (F.col("rn") % 5) / 100), "shares": (F.col("rn") % 7 + 1).cast("long")})


@query("entry_fill", f"""with {BARS}, b as (select *, row_number() over s as rn, lead(session) over s as n_session, lead(open) over s as n_open, lead(high) over s as n_high, lead(low) over s as n_low, lead(volume) over s as n_volume from bars window s as (partition by symbol order by session)),
o as (select symbol, session as placed, n_open as open, n_high as high, n_low as low, n_volume as volume, ['market_on_open', 'limit', 'stop_entry'][rn % 3 + 1] as order_type, case when rn % 2 = 0 then 1.0 else -1.0 end as side, close * (0.98 + (rn % 5) / 100) as level, rn % 7 + 1 as shares from b where n_session is not null),
f as (select *, case when volume > 0 then case order_type when 'market_on_open' then open when 'limit' then case when side > 0 then case when low <= level then least(open, level) end else case when high >= level then greatest(open, level) end end
  else case when side > 0 then case when high >= level then greatest(open, level) end else case when low <= level then least(open, level) end end end end as raw, least(shares, floor(volume * 0.1)::bigint) as filled,
  order_type = 'stop_entry' and case when side > 0 then open > level else open < level end as gapped from o)
select symbol, cast(placed as varchar) as placed, order_type, case when raw is not null and filled > 0 then filled else 0 end as fill_shares, raw is not null and filled > 0 and filled < shares as partial,
  {_r('case when raw is not null and filled > 0 then raw + side * raw * (0.0005 + 0.1 * sqrt(filled / volume) * 0.01 + case when gapped then 0.001 else 0.0 end) end', 'fill_price')} from f""")
def entry_fill(spark: SparkSession, sf: str) -> DataFrame:
    f = ev.entry_fill(_orders(spark, sf))
    return f.select("symbol", F.col("placed").cast("string").alias("placed"), "order_type", "fill_shares", "partial", rounded("fill_price").alias("fill_price"))


_DAILY = f"""with {TRADES}, d as (select strategy, exit_session as session, sum(net) as pnl from trades group by all), e as (select *, 100000 + sum(pnl) over (partition by strategy order by session rows unbounded preceding) as equity from d),
p as (select *, pnl / (equity - pnl) as ret, greatest(100000.0, max(equity) over (partition by strategy order by session rows unbounded preceding)) as top from e),
k as (select *, (top - equity) / top * 100 as drawdown, sum(cast(equity >= top as int)) over (partition by strategy order by session rows unbounded preceding) as peak from p),
u as (select *, sum(cast(equity < top as int)) over (partition by strategy, peak order by session rows unbounded preceding) as under from k),
g as (select strategy, count(*) as n, avg(ret) as mean, stddev_samp(ret) as sd, count(*) filter (ret < 0) as n_down, stddev_samp(case when ret < 0 then ret end) as sd_down, max(drawdown) as max_drawdown_pct, max(under)::bigint as max_drawdown_days, arg_max(equity, session) as last, max(session) - min(session) as days from u group by strategy)"""


@query("performance_ratios", f"""{_DAILY} select strategy, n, {_r('max_drawdown_pct', 'max_drawdown_pct')}, max_drawdown_days, {_r('case when n >= 20 and sd >= 1e-9 then mean / sd * sqrt(252) end', 'sharpe')}, {_r('case when n >= 20 and n_down >= 2 and sd_down >= 1e-9 then mean / sd_down * sqrt(252) end', 'sortino')},
{_r('case when n >= 20 and max_drawdown_pct > 0 and days > 0 and last > 0 then (pow(last / 100000.0, 365.0 / days) - 1) * 100 / max_drawdown_pct end', 'calmar')}, case when n < 20 then 'insufficient_sample' when sd < 1e-9 then 'zero_variance' when n_down < 2 then 'insufficient_downside_sample' else 'ok' end as reason from g""")
def performance_ratios(spark: SparkSession, sf: str) -> DataFrame:
    r = ev.ratios(trades(spark, sf), CAPITAL)
    return r.select("strategy", "n", rounded("max_drawdown_pct").alias("max_drawdown_pct"), "max_drawdown_days", *(rounded(c).alias(c) for c in ("sharpe", "sortino", "calmar")), "reason")


_PERF = f"""with {TRADES}, m as (select symbol_group, strategy, count(*) as trades, count(*) filter (return_pct > 0.05) as wins, count(*) filter (return_pct < -0.05) as losses, avg(net) as expectancy, avg(case when return_pct > 0.05 then net end) as average_win, avg(case when return_pct < -0.05 then -net end) as average_loss,
  sum(greatest(0.0, net)) as profit, sum(greatest(0.0, -net)) as loss, sum(gross) as gross, sum(net) as net, sum((entry_price + exit_price) * shares) / 100000.0 as turnover from (select *, right(symbol, 1) as symbol_group from trades) group by all),
s as (select right(symbol, 1) as symbol_group, strategy, symbol, sum(greatest(0.0, net)) as p from trades group by all), t as (select symbol_group, strategy, max(p) as top_symbol from s group by all),
x as (select *, wins / nullif(losses, 0) as win_loss_ratio, profit / nullif(loss, 0) as profit_factor, wins / nullif(wins + losses, 0) as win_rate, coalesce(top_symbol * 100 / nullif(profit, 0), 0.0) as top_symbol_pct from m join t using (symbol_group, strategy)),
perf as (select *, greatest(0.0, win_rate - 1.96 * sqrt(win_rate * (1 - win_rate) / (wins + losses))) as win_rate_low, least(1.0, win_rate + 1.96 * sqrt(win_rate * (1 - win_rate) / (wins + losses))) as win_rate_high from x)"""
_BY = ["symbol_group", "strategy"]


def _performance(spark: SparkSession, sf: str) -> DataFrame:
    return ev.performance(trades(spark, sf).withColumn("symbol_group", F.substring("symbol", -1, 1)), _BY, CAPITAL)


_SHOWN = ("expectancy", "average_win", "average_loss", "win_loss_ratio", "profit_factor", "win_rate", "win_rate_low", "win_rate_high", "turnover", "top_symbol_pct")


@query("performance_report", f"{_PERF} select symbol_group, strategy, trades, wins, losses, {', '.join(_r(c, c) for c in _SHOWN)} from perf")
def performance_report(spark: SparkSession, sf: str) -> DataFrame:
    return _performance(spark, sf).select(*_BY, "trades", "wins", "losses", *(rounded(c).alias(c) for c in _SHOWN))


def _judged_sql(source: str, by: str) -> str:
    """CTEs up to `judged`: measures, shares of profit, significance and warnings of each book of `source`."""
    return f"""m as (select {by}, count(*) as trades, count(*) filter (return_pct > 0.05) as wins, count(*) filter (return_pct < -0.05) as losses, avg(net) as expectancy, stddev_samp(net) as sd, avg(case when return_pct > 0.05 then net end) as average_win,
  avg(case when return_pct < -0.05 then -net end) as average_loss, sum(greatest(0.0, net)) as profit, sum(gross) as gross, sum(net) as net from {source} group by all),
won as (select * from {source} where net > 0), per_symbol as (select {by}, symbol, sum(net) as p from won group by all), t1 as (select {by}, max(p) as best_symbol from per_symbol group by all),
placed as (select *, row_number() over (partition by {by} order by net desc) as place from won), t3 as (select {by}, sum(net) as top3 from placed where place <= 3 group by all),
per_sector as (select {by}, coalesce(sector, 'unknown') as sector, sum(p) as p from per_symbol left join securities using (symbol) group by all), t2 as (select {by}, max(p) as best_sector from per_sector group by all),
x as (select m.*, wins / nullif(losses, 0) as wl, coalesce(best_symbol * 100 / nullif(profit, 0), 0.0) as s1, coalesce(top3 * 100 / nullif(profit, 0), 0.0) as s3, coalesce(best_sector * 100 / nullif(profit, 0), 0.0) as s2,
  case when trades < 30 then 'trade_count_below_floor' when abs(expectancy) <= 1.96 * coalesce(sd, 0.0) / sqrt(trades) then 'expectancy_interval_includes_zero' end as significance from m left join t1 using ({by}) left join t2 using ({by}) left join t3 using ({by})),
judged as (select *, array_to_string(list_filter([case when significance is not null then 'not_significant' end, case when trades < 30 then 'too_few_trades' end, case when trades >= 30 and trades < 100 and coalesce(wl, 'inf'::double) > 1 then 'few_trades_for_ratio' end,
  case when expectancy <= 0 and coalesce(wl, 'inf'::double) > 1 then 'wins_but_loses_money' end, case when average_win > 0 and average_loss > 2 * average_win then 'loss_over_twice_win' end, case when s3 > 50.0 then 'three_trades' end, case when s1 > 40.0 then 'one_symbol' end,
  case when s2 > 40.0 then 'one_sector' end, case when gross > 0 and net <= 0 then 'edge_lost_to_costs' end, case when losses = 0 and trades > 0 then 'no_losses' end], lambda v: v is not null), ',') as warnings from x)"""


@query("validation_warnings", f"with {TRADES}, {SECURITIES}, g as (select *, right(symbol, 1) as symbol_group from trades), {_judged_sql('g', 'symbol_group, strategy')} select symbol_group, strategy, {_r('s3', 'top3_pct')}, {_r('s2', 'top_sector_pct')}, warnings from judged")
def validation_warnings(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf).withColumn("symbol_group", F.substring("symbol", -1, 1))
    j = ev.judged(t, _BY, CAPITAL, securities(spark, sf))
    return j.select(*_BY, rounded("top3_pct").alias("top3_pct"), rounded("top_sector_pct").alias("top_sector_pct"), F.array_join("warnings", ",").alias("warnings"))


@query("report_sections", f"""with {TRADES}, {SECURITIES}, k as (select *, case when cast(substr(symbol, 2) as bigint) % 3 = 0 then cast(year(entry_session) as varchar) else 'all' end as book from trades),
b as (select strategy, book, min(entry_session) as lo, max(entry_session) as hi, max(entry_session) - min(entry_session) as span from k group by all), f as (select *, case when span < 630 then 0 else (span - 630) // 126 + 1 end as folds from b),
d as (select k.*, f.folds, case when f.folds = 0 then 0 else floor((entry_session - lo - 504) / 126.0) end as fold from k join f using (strategy, book)), g as (select * from d where fold >= 0 and fold < greatest(1, folds)),
pf as (select strategy, book, fold, count(*) as n, sum(net) as net from g group by all), ch as (select strategy, book, count(*) as folds_with_trades, max(n) as most_in_a_fold, (exp(sum(ln(greatest(1e-9, 1 + net / 10000000.0)))) - 1) * 100 as chained from pf group by all),
{_judged_sql('g', 'strategy, book')}
select f.strategy, f.book, cast(lo as varchar) as lo, cast(hi as varchar) as hi, case when folds > 0 then 'out_of_sample' else 'in_sample' end as evidence, folds, coalesce(folds_with_trades, 0) as folds_with_trades, coalesce(most_in_a_fold, 0) as most_in_a_fold, coalesce(trades, 0) as trades,
{_r('expectancy', 'expectancy')}, {_r('chained', 'chained_return_pct')}, case when folds = 0 then 'insufficient_history' when coalesce(trades, 0) = 0 then 'zero_completed_trades' else significance end as reason,
case when folds > 0 and trades > 0 and significance is null then 'significant' else 'insufficient evidence' end as headline, coalesce(warnings, '') as warnings from f left join judged using (strategy, book) left join ch using (strategy, book)""")
def report_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Some symbols' trades are booked by year, the others in one book, so both kinds of evidence occur."""
    number = F.expr("cast(substr(symbol, 2) as bigint)")
    t = trades(spark, sf).withColumn("book", F.when(number % 3 == 0, F.year("entry_session").cast("string")).otherwise("all"))
    s = ev.report_sections(t, ["strategy", "book"], 1e7, securities(spark, sf))
    shown = {"lo": F.col("lo").cast("string"), "hi": F.col("hi").cast("string"), "expectancy": rounded("expectancy"), "chained_return_pct": rounded("chained_return_pct"), "warnings": F.array_join("warnings", ",")}
    return s.withColumns(shown)


@query("objective_score", f"{_PERF} select symbol_group, strategy, {_r('''case when expectancy <= 0 or coalesce(average_win > 0 and average_loss > 2 * average_win, false) or coalesce(profit_factor, 'inf'::double) <= 1.0 or win_loss_ratio is null then 0.0 else win_loss_ratio end''', 'objective')} from perf")
def objective_score(spark: SparkSession, sf: str) -> DataFrame:
    return _performance(spark, sf).select(*_BY, rounded(ev.objective()).alias("objective"))


@query("chronological_split", f"""with {TRADES}, r as (select min(entry_session) as lo, max(entry_session) - min(entry_session) + 1 as total from trades), q as (select lo, total, greatest(1, floor(total * 0.25)::bigint) as test from r), z as (select *, (total - test) - (total - test) // 2 as train from q),
b as (select t.*, case when entry_session - lo < train then 'train' when entry_session - lo < total - test then 'validation' else 'test' end as block from trades t, z)
select block, strategy, count(*) as trades, cast(min(entry_session) as varchar) as first, cast(max(entry_session) as varchar) as last, {_r('avg(return_pct)', 'mean_return')} from b group by all""")
def chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    b = ev.chronological_split(trades(spark, sf)).groupBy("block", "strategy").agg(F.count("*").alias("trades"), F.min("entry_session").cast("string").alias("first"), F.max("entry_session").cast("string").alias("last"), F.avg("return_pct").alias("m"))
    return b.select("block", "strategy", "trades", "first", "last", rounded("m").alias("mean_return"))


@query("stitched_equity", f"""with {TRADES}, d as (select year(exit_session) as fold, exit_session as session, sum(net) as pnl from trades group by all), e as (select *, 1000000000 + sum(pnl) over (partition by fold order by session rows unbounded preceding) as equity from d),
f as (select *, equity / first_value(equity) over (partition by fold order by session) as relative from e), g as (select fold, arg_max(relative, session) as growth from f group by fold), h as (select fold, exp(coalesce(sum(ln(growth)) over (order by fold rows between unbounded preceding and 1 preceding), 0.0)) as base from g),
s as (select session, base * relative as stitched from f join h using (fold)), p as (select *, greatest(1.0, max(stitched) over (order by session rows unbounded preceding)) as top from s)
select cast(session as varchar) as session, {_r('stitched', 'multiple')}, {_r('(top - stitched) / top * 100', 'drawdown_pct')} from p""")
def stitched_equity(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.stitched_equity(trades(spark, sf), 1e9)
    return s.select(F.col("session").cast("string").alias("session"), rounded(F.col("stitched") / 1e9).alias("multiple"), rounded("drawdown_pct").alias("drawdown_pct"))
