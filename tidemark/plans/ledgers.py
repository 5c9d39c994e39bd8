"""Queries of the ledger, keyed merges, listings, sector strength and small lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import SESSIONS_SQL, sessions
from tidemark.functions.columns import by_symbol, full, rounded
from tidemark.operators import ledgers as lg
from tidemark.registry import query
from tidemark.sources.adapters import BARS, EARNINGS, POSTS, SECURITIES, TRADES, bars, earnings, posts, securities, table, trades

_r = lambda x, n: f"round_even({x} + 3e-8, 6) + 0.0 as {n}"
_S = "cast(session as varchar) as session"
_INT = lambda x, d: f"cast(cast(round_even({x} * 1e{d} + 3e-4, 0) as bigint) as varchar)"
SIGNALS = f"""{TRADES}, signals as (select substr(sha256(concat_ws('|', symbol, strategy, trade_id)), 1, 24) as id, symbol, strategy, entry_session as created, exit_session as expires_after, net, trade_id,
  round_even(return_pct + 3e-8, 6) as score, sha256(concat_ws('|', symbol, strategy, {_INT('entry_price', 4)}, {_INT('shares', 2)})) as hash from trades)"""
REVISIONS = "revisions as (select id, 1 as revision, 'open' as status from signals union all select id, 2, case when net > 0 then 'won' else 'lost' end from signals where expires_after < date '1998-06-30')"


def signals(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf)
    return t.select(lg.signal_id("symbol", "strategy", "trade_id").alias("id"), "symbol", "strategy", F.col("entry_session").alias("created"), F.col("exit_session").alias("expires_after"), "net", "trade_id", rounded("return_pct").alias("score"), lg.payload_hash({"entry_price": 4, "shares": 2}, ("symbol", "strategy")).alias("hash"))


def revisions(s: DataFrame) -> DataFrame:
    closed = s.where("expires_after < date'1998-06-30'").select("id", F.lit(2).alias("revision"), F.when(F.col("net") > 0, "won").otherwise("lost").alias("status"))
    return s.select("id", F.lit(1).alias("revision"), F.lit("open").alias("status")).unionByName(closed)


@query("signal_ids", f"with {SIGNALS} select trade_id, id, hash from signals")
def signal_ids(spark: SparkSession, sf: str) -> DataFrame:
    return signals(spark, sf).select("trade_id", "id", "hash")


@query("ledger_append", f"with {SIGNALS}, old as (select id, case when right(trade_id, 1) = '7' then 'other' else hash end as stored from signals where created < date '1997-01-01') select s.id, case when stored is null then 'append' when stored = hash then 'same' else 'conflict' end as action from signals s left join old using (id)")
def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    s = signals(spark, sf)
    old = s.where("created < date'1997-01-01'").select("id", F.when(F.substring("trade_id", -1, 1) == "7", "other").otherwise(F.col("hash")).alias("hash"))
    return lg.append(old, s.select("id", "hash")).select("id", "action")


@query("ledger_integrity", f"with {SIGNALS}, st as (select *, case when right(trade_id, 2) = '13' then 'broken' else hash end as stored from signals) select strategy, count(*) as rows, count(*) filter (stored <> hash) as broken from st group by strategy")
def ledger_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Stored digests against those made anew from the rows."""
    st = signals(spark, sf).withColumn("stored", F.when(F.substring("trade_id", -2, 2) == "13", "broken").otherwise(F.col("hash")))
    return st.groupBy("strategy").agg(F.count("*").alias("rows"), F.count_if(F.col("stored") != F.col("hash")).alias("broken"))


@query("ledger_revise", f"with {SIGNALS}, {REVISIONS}, ch as (select id from signals where net < 0), l as (select id, max(revision) as last from revisions group by id) select ch.id, l.last + 1 as revision, 'reviewed' as status from ch join l using (id)")
def ledger_revise(spark: SparkSession, sf: str) -> DataFrame:
    s = signals(spark, sf)
    return lg.revise(revisions(s), s.where("net < 0").select("id", F.lit("reviewed").alias("status"))).select("id", "revision", "status")


@query("ledger_current", f"with {SIGNALS}, {REVISIONS} select id, max(revision) as revision, arg_max(status, revision) as status from revisions group by id")
def ledger_current(spark: SparkSession, sf: str) -> DataFrame:
    return lg.current(revisions(signals(spark, sf)))


@query("ledger_expire", f"with {SIGNALS}, {REVISIONS}, c as (select id, max(revision) as revision, arg_max(status, revision) as status from revisions group by id) select id, revision + 1 as revision, 'expired' as status from c join signals using (id) where expires_after < date '1999-06-30' and status not in ('won', 'lost', 'expired', 'cancelled')")
def ledger_expire(spark: SparkSession, sf: str) -> DataFrame:
    """The revision rows that expire open signals."""
    s = signals(spark, sf)
    return lg.expired(s, revisions(s), F.lit("1999-06-30").cast("date"))


@query("ledger_page", f"with {SIGNALS}, q as (select id, score, created from signals where score >= 1.0) select id, score + 0.0 as score, cast(created as varchar) as created, (select count(*) from q) as total from (select * from q order by score desc, created desc, id limit 50)")
def ledger_page(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 signals by score (a top-k report) and how many qualify."""
    p = lg.page(signals(spark, sf).select("id", "score", "created"), 1.0, 50)
    return p.select("id", "score", F.col("created").cast("string").alias("created"), "total")


@query("ledger_history", f"with {SIGNALS}, {REVISIONS} select s.symbol, count(distinct s.id) as signals, string_agg(distinct status, ',' order by status) as statuses, cast(max(created) as varchar) as newest from signals s join revisions r using (id) group by s.symbol")
def ledger_history(spark: SparkSession, sf: str) -> DataFrame:
    s = signals(spark, sf)
    j = s.join(revisions(s), "id").groupBy("symbol", "id").agg(F.collect_set("status").alias("st"), F.max("created").alias("created"))
    g = j.groupBy("symbol").agg(F.count("*").alias("signals"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("st")))).alias("st"), F.max("created").cast("string").alias("newest"))
    return g.select("symbol", "signals", F.array_join("st", ",").alias("statuses"), "newest")


@query("candidate_filter", f"with {SIGNALS} select strategy, symbol, count(*) as n, max(score) + 0.0 as best from signals where score between 0.5 and 20 and strategy in ('breakout', 'drift') and expires_after - created between 5 and 60 group by all")
def candidate_filter(spark: SparkSession, sf: str) -> DataFrame:
    days = F.datediff("expires_after", "created")
    s = signals(spark, sf).where(F.col("score").between(0.5, 20) & F.col("strategy").isin("breakout", "drift") & days.between(5, 60))
    return s.groupBy("strategy", "symbol").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query("research_append", f"with {SIGNALS}, prior as (select id, 1 as revision, score * 3 as delta, 'first look' as note from signals where net > 0), fresh as (select id, case when net > 100 then null else score * 5 end as delta, case when net < 0 then 'second look' end as note from signals) select f.id, coalesce(p.revision, 0) + 1 as revision, {_r('greatest(-20.0, least(20.0, coalesce(f.delta, p.delta, 0.0)))', 'delta')}, coalesce(f.note, p.note) as note from fresh f left join prior p using (id)")
def research_append(spark: SparkSession, sf: str) -> DataFrame:
    s = signals(spark, sf)
    prior = s.where("net > 0").select("id", F.lit(1).alias("revision"), (F.col("score") * 3).alias("delta"), F.lit("first look").alias("note"))
    fresh = s.select("id", F.when(F.col("net") > 100, None).otherwise(F.col("score") * 5).alias("delta"), F.when(F.col("net") < 0, "second look").alias("note"))
    return lg.research(prior, fresh).select("id", "revision", rounded("delta").alias("delta"), "note")


@query("thesis_text", f"with {SIGNALS} select id, concat(strategy, ' in ', symbol, ': score ', cast(cast(round_even(score, 0) as bigint) as varchar), ', from ', cast(created as varchar), ' to ', cast(expires_after as varchar)) as thesis from signals")
def thesis_text(spark: SparkSession, sf: str) -> DataFrame:
    s = signals(spark, sf)
    return s.select("id", F.concat("strategy", F.lit(" in "), "symbol", F.lit(": score "), F.bround("score", 0).cast("long").cast("string"), F.lit(", from "), F.col("created").cast("string"), F.lit(" to "), F.col("expires_after").cast("string")).alias("thesis"))


_QUOTE = "last as (select * from (select *, row_number() over (partition by symbol order by session desc) as k from bars) where k = 1), q as (select symbol, case when volume > 20 then session else session + 1 end as session, close as open, close * 1.01 as high, close * 0.985 as low, close * 1.002 as close, volume * 0.9 as volume from last)"
_FIVE = ", ".join(_r(c, c) for c in ("open", "high", "low", "close", "volume"))


@query("current_bar_merge", f"with {BARS}, {_QUOTE} select symbol, {_S}, {_FIVE}, false as inserted from bars union all select symbol, {_S}, {_FIVE}, true from q where not exists (select 1 from bars b where b.symbol = q.symbol and b.session = q.session)")
def current_bar_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes of today: some repeat a stored session and change nothing, the rest are appended."""
    b = bars(spark, sf)
    last = b.groupBy("symbol").agg(F.max_by(F.struct("session", "close", "volume"), "session").alias("x")).select("symbol", "x.*")
    c = F.col("close")
    quote = last.select("symbol", F.when(F.col("volume") > 20, F.col("session")).otherwise(F.date_add("session", 1)).alias("session"), c.alias("open"), (c * 1.01).alias("high"), (c * 0.985).alias("low"), (c * 1.002).alias("close"), (F.col("volume") * 0.9).alias("volume"))
    m = lg.merge_current_bar(b, quote)
    return m.select("symbol", F.col("session").cast("string").alias("session"), *(rounded(x).alias(x) for x in ("open", "high", "low", "close", "volume")), "inserted")


_NUM = "cast(substr(symbol, 2) as bigint)"


@query("securities_upsert", f"with {SECURITIES}, old as (select symbol, name, sector, market_cap_usd from securities where {_NUM} % 4 <> 0), new as (select symbol, case when {_NUM} % 3 = 0 then concat(name, ' Corp') else name end as name, cast(null as varchar) as sector, case when {_NUM} % 5 = 0 then null else market_cap_usd end as market_cap_usd from securities where {_NUM} % 7 <> 0) select coalesce(new.symbol, old.symbol) as symbol, coalesce(new.name, old.name) as name, coalesce(new.sector, old.sector) as sector, coalesce(new.market_cap_usd, old.market_cap_usd) as market_cap_usd, case when lower(new.name) <> lower(old.name) then old.name end as alias, case when old.name is null then 'insert' when new.name is null then 'keep' else 'update' end as action from new full join old on new.symbol = old.symbol")
def securities_upsert(spark: SparkSession, sf: str) -> DataFrame:
    s = securities(spark, sf).withColumn("k", F.expr("cast(substr(symbol, 2) as bigint)"))
    new = s.where("k % 7 <> 0").select("symbol", F.when(F.col("k") % 3 == 0, F.concat("name", F.lit(" Corp"))).otherwise(F.col("name")).alias("name"), F.lit(None).cast("string").alias("sector"), F.when(F.col("k") % 5 != 0, F.col("market_cap_usd")).alias("market_cap_usd"))
    return lg.upsert_securities(s.where("k % 4 <> 0"), new)


@query("earnings_upsert", f"with {EARNINGS} select symbol, cast(report_date as varchar) as report_date, cast(max(as_of) as varchar) as as_of, bool_or(confirmed) as confirmed, arg_max(surprise_pct, (as_of, event_id)) as surprise_pct from earnings group by symbol, report_date")
def earnings_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = lg.upsert_earnings(earnings(spark, sf))
    return e.select("symbol", F.col("report_date").cast("string").alias("report_date"), F.col("as_of").cast("string").alias("as_of"), "confirmed", "surprise_pct")


@query("platform_upsert", f"with {POSTS}, c as (select symbol, session, source, count(*) as mentions, max(post_id) as version from posts group by all), f as (select symbol, session, source, mentions + 1 as mentions, version + 1 as version from c where mentions > 1 union all select * from c) select symbol, {_S}, source, arg_max(mentions, version) as mentions from f group by symbol, session, source")
def platform_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots by symbol, day and platform: the newest version wins."""
    c = posts(spark, sf).groupBy("symbol", "session", "source").agg(F.count("*").alias("mentions"), F.max("post_id").alias("version"))
    fresh = c.where("mentions > 1").select("symbol", "session", "source", (F.col("mentions") + 1).alias("mentions"), (F.col("version") + 1).alias("version"))
    m = c.unionByName(fresh).groupBy("symbol", "session", "source").agg(F.max_by("mentions", "version").alias("mentions"))
    return m.select("symbol", F.col("session").cast("string").alias("session"), "source", "mentions")


@query("deactivate_unknown", f"with {BARS}, {SECURITIES}, f as (select distinct symbol from bars where session >= date '2000-01-01' and {_NUM} % 9 <> 0) select s.symbol, f.symbol is not null as active from securities s left join f using (symbol)")
def deactivate_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Listings that the last fetch didn't name become inactive."""
    f = bars(spark, sf).where("session >= date'2000-01-01' and cast(substr(symbol, 2) as bigint) % 9 <> 0").select("symbol").distinct().withColumn("seen", F.lit(True))
    return securities(spark, sf).join(f, "symbol", "left").select("symbol", F.coalesce("seen", F.lit(False)).alias("active"))


@query("purge_synthetic", f"with {POSTS} select source, count(*) as kept from posts where not (source = 'click' and author % 2 = 0) group by source")
def purge_synthetic(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf).where(~((F.col("source") == "click") & (F.col("author") % 2 == 0)))
    return p.groupBy("source").agg(F.count("*").alias("kept"))


@query("universe_union", f"with {SECURITIES}, packaged as (select concat('C', c_custkey) as symbol, c_name as name from customer union all select symbol, name from securities where {_NUM} % 2 = 0) select symbol, name, 'database' as origin from securities union all select symbol, name, 'packaged' from packaged p where not exists (select 1 from securities s where s.symbol = p.symbol)")
def universe_union(spark: SparkSession, sf: str) -> DataFrame:
    s = securities(spark, sf).select("symbol", "name")
    packaged = table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"), F.col("c_name").alias("name")).unionByName(s.where("cast(substr(symbol, 2) as bigint) % 2 = 0"))
    return s.withColumn("origin", F.lit("database")).unionByName(packaged.join(s.select("symbol"), "symbol", "left_anti").withColumn("origin", F.lit("packaged")))


@query("price_extras", f"with {BARS}, w as (select *, close * volume as dv from bars) select symbol, {_S}, {_r('case when count(close) over w20 >= 20 then (close / nullif(avg(close) over w20, 0) - 1) * 100 end', 'distance_pct')}, {_r('case when count(dv) over w20 >= 20 then avg(dv) over w20 end', 'avg_dollar_volume')}, {_r('case when count(close) over w14 >= 14 then avg(high - low) over w14 / nullif(close, 0) * 100 end', 'range_pct')} from w window w20 as (partition by symbol order by session rows between 19 preceding and current row), w14 as (partition by symbol order by session rows between 13 preceding and current row)")
def price_extras(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("dv", F.col("close") * F.col("volume")).withColumn("range", F.col("high") - F.col("low"))
    return b.select("symbol", F.col("session").cast("string").alias("session"), rounded((F.col("close") / full(F.avg, "close", 20) - 1) * 100).alias("distance_pct"), rounded(full(F.avg, "dv", 20)).alias("avg_dollar_volume"), rounded(full(F.avg, "range", 14) / F.col("close") * 100).alias("range_pct"))


@query("freshness_hours", f"with {BARS}, t as (select max(session) as top from bars) select symbol, (any_value(top) - max(session)) * 24 as hours from bars, t group by symbol")
def freshness_hours(spark: SparkSession, sf: str) -> DataFrame:
    last = bars(spark, sf).groupBy("symbol").agg(F.max("session").alias("last"))
    return last.crossJoin(F.broadcast(last.agg(F.max("last").alias("top")))).select("symbol", (F.datediff("top", "last") * 24).cast("long").alias("hours"))


@query("current_session", f"with {SESSIONS_SQL}, o as (select distinct cast(o_orderdate as date) as day from orders) select cast(day as varchar) as day, cast(s.session as varchar) as session from o asof join sessions s on s.session <= o.day")
def current_session(spark: SparkSession, sf: str) -> DataFrame:
    """Each day rolled back to the session at or before it: the calendar, each session with the days until the next, is broadcast."""
    w = Window.partitionBy(F.lit(0)).orderBy("session")
    s = sessions(spark, "1994-12-01", "2001-12-31").select("session", F.coalesce(F.date_sub(F.lead("session").over(w), 1), F.lit("2001-12-31").cast("date")).alias("until"))
    days = s.select("session", F.explode(F.sequence("session", "until")).alias("day"))
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return o.join(F.broadcast(days), "day").select(F.col("day").cast("string").alias("day"), F.col("session").cast("string").alias("session"))


@query("sessions_covered", f"with {SESSIONS_SQL}, f as (select o_custkey % 50 as fetch_id, min(o_orderdate) as since, max(o_orderdate) as until from orders group by 1) select fetch_id, count(*) as sessions, cast(min(session) as varchar) as first, cast(max(session) as varchar) as last from f join sessions on close_utc > since and close_utc <= until group by fetch_id")
def sessions_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions whose close falls into a fetch's span. Each end of a span finds the number of closes up to it by its day, so all joins are
    equalities with a calendar of one row a day, and no session is made a row for each fetch."""
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    s = sessions(spark, "1994-12-01", "2001-12-31").select("session", F.col("ordinal").cast("long").alias("ordinal"), "close_utc")
    days = s.agg(F.explode(F.sequence(F.min("session"), F.date_add(F.max("session"), 1))).alias("day"))
    closes = s.select(F.to_date("close_utc").alias("day"), "close_utc", "ordinal")
    days = days.join(closes, "day", "left").withColumn("before", F.coalesce(F.max("ordinal").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    f = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("fetch_id")).agg(F.min("o_orderdate").alias("since"), F.max("o_orderdate").alias("until"))

    def upto(x: DataFrame, end: str, name: str) -> DataFrame:
        """The number of closes at or before an end of the span."""
        found = x.join(F.broadcast(days.withColumnRenamed("day", "_day")), F.to_date(end) == F.col("_day"), "left")
        return found.withColumn(name, F.col("before") + F.when(F.col("close_utc") <= F.col(end), 1).otherwise(0)).drop("_day", "close_utc", "ordinal", "before")

    j = upto(upto(f, "since", "n0"), "until", "n1").where("n1 > n0")
    at = lambda name: F.broadcast(s.select(F.col("ordinal").alias(name), F.col("session").cast("string").alias(f"s_{name}")))
    j = j.withColumns({"a": F.col("n0") + 1, "z": F.col("n1")}).join(at("a"), "a").join(at("z"), "z")
    return j.select("fetch_id", (F.col("n1") - F.col("n0")).alias("sessions"), F.col("s_a").alias("first"), F.col("s_z").alias("last"))


@query("social_seed", f"with {POSTS}, {TRADES}, h as (select symbol, 1 as p, max(net) as s from trades where net > 0 group by symbol order by s desc, symbol limit 10), r as (select symbol, 2 as p, count(*) as s from trades where entry_session >= date '1998-01-01' group by symbol order by s desc, symbol limit 20), t as (select symbol, 3 as p, count(*) as s from posts group by symbol order by s desc, symbol limit 20), u as (select symbol, min(p) as p from (select symbol, p from h union all select symbol, p from r union all select symbol, p from t) group by symbol) select symbol, p as priority from u order by p, symbol limit 30")
def social_seed(spark: SparkSession, sf: str) -> DataFrame:
    """Held, recently signalled and trending symbols, each once by its first list, capped (a top-k report)."""
    t, p = trades(spark, sf), posts(spark, sf)
    top = lambda d, n, k: d.orderBy(F.desc("s"), "symbol").limit(n).select("symbol", F.lit(k).alias("priority"))
    held = top(t.where("net > 0").groupBy("symbol").agg(F.max("net").alias("s")), 10, 1)
    recent = top(t.where("entry_session >= date'1998-01-01'").groupBy("symbol").agg(F.count("*").alias("s")), 20, 2)
    trend = top(p.groupBy("symbol").agg(F.count("*").alias("s")), 20, 3)
    return held.union(recent).union(trend).groupBy("symbol").agg(F.min("priority").alias("priority")).orderBy("priority", "symbol").limit(30)
