"""Relational queries: as-of joins, latest rows, upserts, quality checks, universe, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import relations as rel
from tidemark.registry import query
from tidemark.sources.adapters import BARS, EARNINGS, POSTS, SECURITIES, TRADES, bars, earnings, posts, securities, trades

_RANKED = "row_number() over (partition by {} order by {})"


@query("asof_earnings", f"with {BARS}, {EARNINGS}, known as (select * from earnings where confirmed), e as (select symbol, report_date, max(event_id) as event_id from known group by all), j as (select b.symbol, b.session, e.report_date from bars b asof left join e on e.symbol = b.symbol and e.report_date <= b.session) select symbol, cast(session as varchar) as session, cast(report_date as varchar) as last_report, cast(session - report_date as bigint) as days_since from j")
def asof_earnings(spark: SparkSession, sf: str) -> DataFrame:
    e = earnings(spark, sf).where("confirmed").groupBy("symbol", "report_date").agg(F.max("event_id").alias("event_id"))
    j = rel.backward_asof(bars(spark, sf).select("symbol", "session"), e.withColumnRenamed("report_date", "session"), ["event_id"], keep_key="report_date")
    return j.select("symbol", F.col("session").cast("string").alias("session"), F.col("report_date").cast("string").alias("last_report"), F.datediff("session", "report_date").cast("long").alias("days_since"))


@query("days_to_earnings", f"with {BARS}, {EARNINGS}, e as (select distinct symbol, report_date from earnings), j as (select b.symbol, b.session, e.report_date from bars b asof left join e on e.symbol = b.symbol and e.report_date >= b.session) select symbol, cast(session as varchar) as session, cast(report_date - session as bigint) as days_to from j")
def days_to_earnings(spark: SparkSession, sf: str) -> DataFrame:
    e = earnings(spark, sf).select("symbol", "report_date").distinct()
    j = rel.forward_asof(bars(spark, sf).select("symbol", "session"), e.withColumnRenamed("report_date", "session"), "report_date")
    return j.select("symbol", F.col("session").cast("string").alias("session"), F.datediff("report_date", "session").cast("long").alias("days_to"))


@query("bitemporal_earnings", f"with {EARNINGS}, t as (select date '1998-06-30' as day) select symbol, cast(report_date as varchar) as report_date, case when report_date > day then null else surprise_pct end as surprise_pct, event_id from earnings, t where as_of <= day")
def bitemporal_earnings(spark: SparkSession, sf: str) -> DataFrame:
    """What was known on a day: later knowledge is out, results of reports still to come are blank."""
    at = F.lit("1998-06-30").cast("date")
    known = earnings(spark, sf).where(F.col("as_of") <= at)
    return known.select("symbol", F.col("report_date").cast("string").alias("report_date"), F.when(F.col("report_date") <= at, F.col("surprise_pct")).alias("surprise_pct"), "event_id")


@query("lookahead_check", f"with {EARNINGS} select count(*) as violations from earnings where as_of > report_date")
def lookahead_check(spark: SparkSession, sf: str) -> DataFrame:
    return earnings(spark, sf).where(F.col("as_of") > F.col("report_date")).agg(F.count("*").alias("violations"))


@query("latest_previous_delta", f"with {BARS}, r as (select *, {_RANKED.format('symbol', 'session desc')} as rn, lead(close) over (partition by symbol order by session desc) as prev_close, lead(session) over (partition by symbol order by session desc) as prev_session from bars) select symbol, cast(session as varchar) as session, cast(prev_session as varchar) as prev_session, round_even(close - prev_close + 3e-8, 6) + 0.0 as delta from r where rn = 1")
def latest_previous_delta(spark: SparkSession, sf: str) -> DataFrame:
    two = rel.latest(bars(spark, sf), ["symbol"], "session", 2)
    g = two.groupBy("symbol").agg(F.max_by("close", "session").alias("close"), F.min_by("close", "session").alias("prev"), F.max("session").alias("session"), F.min("session").alias("prev_session"), F.count("*").alias("n"))
    g = g.withColumn("prev_session", F.when(F.col("n") > 1, F.col("prev_session"))).withColumn("delta", F.when(F.col("n") > 1, F.col("close") - F.col("prev")))
    return g.select("symbol", F.col("session").cast("string").alias("session"), F.col("prev_session").cast("string").alias("prev_session"), rounded("delta").alias("delta"))


@query("next_bar_after", f"with {BARS} select symbol, cast(session as varchar) as session, cast(lead(session) over (partition by symbol order by session) as varchar) as next_session, round_even(lead(open) over (partition by symbol order by session) + 3e-8, 6) as next_open from bars")
def next_bar_after(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("session")
    b = bars(spark, sf)
    return b.select("symbol", F.col("session").cast("string").alias("session"), F.lead("session").over(w).cast("string").alias("next_session"), F.bround(F.lead("open").over(w) + 3e-8, 6).alias("next_open"))


@query("bars_upsert", f"with {BARS}, old as (select * from bars where session < date '1998-07-01'), new as (select symbol, session, open, high, low, case when volume > 60 then close + 1 else close end as close, volume from bars where session >= date '1998-06-01') select coalesce(n.symbol, o.symbol) as symbol, cast(coalesce(n.session, o.session) as varchar) as session, round_even(coalesce(n.close, o.close) + 3e-8, 6) as close, case when o.symbol is null then 'insert' when n.symbol is null then 'keep' when abs(n.close - o.close) > 1e-9 then 'restate' else 'same' end as action from old o full join new n on o.symbol = n.symbol and o.session = n.session")
def bars_upsert(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    old = b.where("session < date'1998-07-01'")
    new = b.where("session >= date'1998-06-01'").withColumn("close", F.when(F.col("volume") > 60, F.col("close") + 1).otherwise(F.col("close")))
    m = rel.upsert(old, new, ["symbol", "session"], ["close"])
    return m.select("symbol", F.col("session").cast("string").alias("session"), F.bround(F.col("close") + 3e-8, 6).alias("close"), "action")


@query("insert_ignore", f"with {POSTS}, old as (select * from posts where post_id % 3 = 0), new as (select * from posts) select author, symbol, count(*) as added from new where not exists (select 1 from old where old.post_id = new.post_id) group by all")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a fresh load whose key is not stored yet; a third is stored already."""
    p = posts(spark, sf)
    return rel.insert_ignore(p.where("post_id % 3 = 0"), p, ["post_id"]).groupBy("author", "symbol").agg(F.count("*").alias("added"))


@query("incremental_skip", f"with {BARS}, m as (select symbol, max(session) as last from bars group by symbol), t as (select max(session) as top from bars) select symbol, cast(last as varchar) as last_session, top - last as days_behind from m, t where last < top")
def incremental_skip(spark: SparkSession, sf: str) -> DataFrame:
    m = bars(spark, sf).groupBy("symbol").agg(F.max("session").alias("last"))
    top = m.agg(F.max("last").alias("top"))
    return m.crossJoin(F.broadcast(top)).where("last < top").select("symbol", F.col("last").cast("string").alias("last_session"), F.datediff("top", "last").cast("long").alias("days_behind"))


_REASON = "c as (select *, case when delisted_date is not null then 'inactive' when exchange = 'AFRICA' then 'exchange' when is_etf then 'etf' when sector in ('CHINA', 'INDIA') then 'sector' when market_cap_usd is null then 'no cap' when market_cap_usd < 1e9 then 'cap' else 'selected' end as reason from securities)"


@query("universe_reasons", f"with {SECURITIES}, {_REASON} select symbol, reason from c")
def universe_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Every security with the first rule that drops it."""
    return rel.universe(securities(spark, sf)).select("symbol", "reason")


@query("universe_top", f"with {SECURITIES}, {_REASON} select symbol, market_cap_usd from c where reason = 'selected' order by market_cap_usd desc, symbol limit 50")
def universe_top(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 largest of what is selected (a top-k report)."""
    return rel.universe(securities(spark, sf)).where("reason = 'selected'").select("symbol", "market_cap_usd").orderBy(F.desc("market_cap_usd"), "symbol").limit(50)


@query("survivorship", f"with {SECURITIES} select exchange, count(*) as listed, count(delisted_date) as delisted, round_even(count(delisted_date) / count(*) + 3e-8, 6) as rate from securities group by exchange")
def survivorship(spark: SparkSession, sf: str) -> DataFrame:
    return securities(spark, sf).groupBy("exchange").agg(F.count("*").alias("listed"), F.count("delisted_date").alias("delisted"), F.bround(F.count("delisted_date") / F.count("*") + 3e-8, 6).alias("rate"))


@query("quality_issues", f"with {BARS}, l as (select *, lag(close) over (partition by symbol order by session) as pc from bars), i as (select symbol, session, unnest([case when volume = 0 then 'zero_volume' end, case when high < greatest(open, close) or low > least(open, close) then 'ohlc' end, case when abs(close / nullif(pc, 0) - 1) >= 0.5 then 'jump' end, case when isodow(session) >= 6 then 'weekend' end]) as kind from l) select symbol, kind, count(*) as issues, cast(max(session) as varchar) as last from i where kind is not null group by all")
def quality_issues(spark: SparkSession, sf: str) -> DataFrame:
    i = rel.bar_issues(bars(spark, sf))
    return i.groupBy("symbol", "kind").agg(F.count("*").alias("issues"), F.max("session").cast("string").alias("last"))


@query("staleness", f"with {BARS}, t as (select max(session) as top from bars) select symbol, any_value(top) - max(session) as days, count(*) as bars, any_value(top) - max(session) > 7 as stale from bars, t group by symbol")
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    joined = b.crossJoin(F.broadcast(b.agg(F.max("session").alias("top"))))
    days = F.datediff(F.max("top"), F.max("session"))
    return joined.groupBy("symbol").agg(days.cast("long").alias("days"), F.count("*").alias("bars"), (days > 7).alias("stale"))


_OHLCV = "concat_ws(':', cast(session as varchar), " + ", ".join(f"cast(cast(round_even({c} * 1e{d} + 3e-3, 0) as bigint) as varchar)" for c, d in (("open", 6), ("high", 6), ("low", 6), ("close", 6), ("volume", 4))) + ")"


@query("bar_digest", f"with {BARS} select symbol, sha256(string_agg({_OHLCV}, '|' order by session)) as digest, count(*) as rows from bars group by symbol")
def bar_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of each symbol's bars in order: prices to 6 places, volume to 4. A symbol's rows are joined in one value, some 60 bytes a day."""
    numbers = (F.bround(F.col(c) * 10**d + 3e-3, 0).cast("long").cast("string") for c, d in (("open", 6), ("high", 6), ("low", 6), ("close", 6), ("volume", 4)))
    rows = F.array_sort(F.collect_list(F.concat_ws(":", F.col("session").cast("string"), *numbers)))
    return bars(spark, sf).groupBy("symbol").agg(F.sha2(F.array_join(rows, "|"), 256).alias("digest"), F.count("*").alias("rows"))


@query("manifest_diff", f"with {BARS}, a as (select symbol, count(*) as n from bars where session < date '1999-01-01' group by symbol), b as (select symbol, count(*) as n from bars where session >= date '1995-03-01' group by symbol) select coalesce(a.symbol, b.symbol) as symbol, case when a.symbol is null then 'added' when b.symbol is null then 'removed' when a.n <> b.n then 'changed' else 'same' end as state from a full join b on a.symbol = b.symbol")
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    old = b.where("session < date'1999-01-01'").groupBy("symbol").agg(F.count("*").alias("n"))
    new = b.where("session >= date'1995-03-01'").groupBy("symbol").agg(F.count("*").alias("m"))
    state = F.when(F.col("n").isNull(), "added").when(F.col("m").isNull(), "removed").when(F.col("n") != F.col("m"), "changed").otherwise("same")
    return old.join(new, "symbol", "full").select("symbol", state.alias("state"))


@query("ledger_status_counts", f"with {TRADES}, rev as (select trade_id, strategy, 1 as revision, 'open' as status from trades union all select trade_id, strategy, 2, case when net > 0 then 'won' else 'lost' end from trades where exit_session < date '2000-01-01'), l as (select trade_id, strategy, arg_max(status, (revision, status)) as status from rev group by all) select strategy, status, count(*) as n from l group by all")
def ledger_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf).select("trade_id", "strategy", "net", "exit_session")
    opened = t.select("trade_id", "strategy", F.lit(1).alias("revision"), F.lit("open").alias("status"))
    closed = t.where("exit_session < date'2000-01-01'").select("trade_id", "strategy", F.lit(2).alias("revision"), F.when(F.col("net") > 0, "won").otherwise("lost").alias("status"))
    last = opened.unionByName(closed).groupBy("trade_id", "strategy").agg(F.max_by("status", F.struct("revision", "status")).alias("status"))
    return last.groupBy("strategy", "status").agg(F.count("*").alias("n"))


@query("expire_stale", f"with {TRADES}, t as (select date '1999-06-30' as day) select strategy, count(*) filter (exit_session < day) as expired, count(*) filter (exit_session >= day) as active from trades, t group by strategy")
def expire_stale(spark: SparkSession, sf: str) -> DataFrame:
    at = F.lit("1999-06-30").cast("date")
    return trades(spark, sf).groupBy("strategy").agg(F.count_if(F.col("exit_session") < at).alias("expired"), F.count_if(F.col("exit_session") >= at).alias("active"))


@query("collapse_recommendations", f"with {TRADES}, d as (select *, round_even(return_pct, 6) as score from trades), r as (select *, {_RANKED.format('symbol, strategy', 'entry_session desc, score desc, trade_id')} as rn, count(*) over (partition by symbol, strategy) as n from d) select symbol, strategy, trade_id, cast(entry_session as varchar) as entry_session, n - 1 as corroborating from r where rn = 1")
def collapse_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """The newest and best of each symbol and strategy, with how many others agree."""
    d = trades(spark, sf).withColumn("score", F.bround("return_pct", 6))
    w = Window.partitionBy("symbol", "strategy")
    r = d.withColumn("rn", F.row_number().over(w.orderBy(F.desc("entry_session"), F.desc("score"), "trade_id"))).withColumn("n", F.count("*").over(w))
    return r.where("rn = 1").select("symbol", "strategy", "trade_id", F.col("entry_session").cast("string").alias("entry_session"), (F.col("n") - 1).alias("corroborating"))


@query("top_candidates", f"with {TRADES}, r as (select *, {_RANKED.format('strategy', 'round_even(return_pct, 6) desc, trade_id')} as rank from trades) select strategy, trade_id, round_even(return_pct + 3e-8, 4) as score, rank from r where rank <= 10")
def top_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best of each strategy (a top-k report)."""
    t = trades(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc(F.bround("return_pct", 6)), "trade_id")))
    return t.where("rank <= 10").select("strategy", "trade_id", F.bround(F.col("return_pct") + 3e-8, 4).alias("score"), "rank")


@query("point_in_time_context", f"with {BARS}, {SECURITIES}, n as (select *, row_number() over (partition by symbol order by session) as rn from bars) select n.symbol, cast(n.session as varchar) as session, sector, rn as history from n join securities s on s.symbol = n.symbol where rn >= 30 and listed_date <= session and (delisted_date is null or session <= delisted_date)")
def point_in_time_context(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with at least 30 rows of history, of securities that were listed on that session."""
    n = bars(spark, sf).select("symbol", "session", F.row_number().over(Window.partitionBy("symbol").orderBy("session")).alias("history"))
    j = n.join(securities(spark, sf), "symbol").where((F.col("history") >= 30) & (F.col("listed_date") <= F.col("session")) & (F.col("delisted_date").isNull() | (F.col("session") <= F.col("delisted_date"))))
    return j.select("symbol", F.col("session").cast("string").alias("session"), "sector", "history")


@query("fallback_sources", f"with {POSTS}, f as (select symbol, source, count(*) as n, case source when 'click' then 1 when 'view' then 2 when 'purchase' then 3 else 4 end as priority from posts group by all) select symbol, arg_min(source, (priority, source)) as source, arg_min(n, (priority, source)) as n from f group by symbol")
def fallback_sources(spark: SparkSession, sf: str) -> DataFrame:
    priority = F.when(F.col("source") == "click", 1).when(F.col("source") == "view", 2).when(F.col("source") == "purchase", 3).otherwise(4)
    f = posts(spark, sf).groupBy("symbol", "source").agg(F.count("*").alias("n")).withColumn("o", F.struct(priority.alias("p"), "source"))
    return f.groupBy("symbol").agg(F.min_by("source", "o").alias("source"), F.min_by("n", "o").alias("n"))


@query("data_freshness", f"with {BARS} select cast(max(session) as varchar) as last_session, count(distinct symbol) as symbols, count(*) as rows from bars")
def data_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).agg(F.max("session").cast("string").alias("last_session"), F.countDistinct("symbol").alias("symbols"), F.count("*").alias("rows"))
