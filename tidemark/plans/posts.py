"""Queries over posts: decayed and weighted sentiment, mention growth, manipulation signs, coverage, trending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import social
from tidemark.registry import query
from tidemark.sources.adapters import POSTS, SECURITIES, posts, securities

DAY = "cast(session as varchar) as session"


def _r(x: str, name: str) -> str:
    return f"round_even({x} + 3e-8, 6) + 0.0 as {name}"


def _show(df: DataFrame, keys: tuple, *names: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.col(k).cast("string").alias(k) if kinds[k] == "date" else F.col(k) for k in keys), *((rounded(n) if kinds[n] == "double" else F.col(n)).alias(n) for n in names))


_AGE = "(epoch(cast(session as timestamp)) + 72000 - epoch(created_at)) / 3600.0"
_W = f"with {POSTS}, w as (select *, pow(0.5, greatest({_AGE}, 0.0) / 18.0) as decay from posts)"


@query("decay_sentiment", f"{_W} select symbol, {DAY}, count(*) as post_count, {_r('sum(polarity * decay) / sum(decay)', 'raw')}, {_r('case when sum(decay * ln(1 + engagement)) > 1e-12 then sum(polarity * decay * ln(1 + engagement)) / sum(decay * ln(1 + engagement)) else avg(polarity) end', 'engagement_weighted')} from w group by symbol, session")
def decay_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return _show(social.daily_sentiment(posts(spark, sf)), ("symbol", "session"), "post_count", "raw", "engagement_weighted")


@query("unique_author_mean", f"{_W}, a as (select symbol, session, author, sum(polarity * decay) / sum(decay) as m, count(*) as n from w group by all) select symbol, {DAY}, count(*) as authors, sum(n)::bigint as post_count, {_r('avg(m)', 'unique_author_sentiment')} from a group by symbol, session")
def unique_author_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _show(social.unique_author_sentiment(posts(spark, sf)), ("symbol", "session"), "authors", "post_count", "unique_author_sentiment")


_G = f"""with {POSTS}, top as (select max(session) as t from posts), c as (select symbol, sum(case when session > t - 2 then 1 else 0 end) as recent, sum(case when session > t - 12 and session <= t - 2 then 1 else 0 end) as base from posts, top group by symbol)
select symbol, recent::bigint as recent, base::bigint as base, {_r("case when recent + base < 5 then 0.0 else least(10.0, greatest(-10.0, (recent / 2.0 + 0.5) / (base / 10.0 + 0.5) - 1)) end", 'growth')} from c"""


@query("mention_growth", _G)
def mention_growth(spark: SparkSession, sf: str) -> DataFrame:
    return _show(social.mention_growth(posts(spark, sf)), ("symbol",), "recent", "base", "growth")


@query("burst_score", f"with {POSTS}, b as (select symbol, session, count(*) over (partition by symbol order by created_at range between interval 15 minutes preceding and interval 15 minutes following) as near from posts) select symbol, {DAY}, count(*) as post_count, {_r('avg(cast(near >= 4 as int))', 'burst')} from b group by symbol, session")
def burst_score(spark: SparkSession, sf: str) -> DataFrame:
    return _show(social.burst(posts(spark, sf)), ("symbol", "session"), "post_count", "burst")


@query("source_concentration", f"with {POSTS}, c as (select symbol, source, count(*) as n from posts group by all) select symbol, count(*) as sources, {_r('sum(pow(n / t, 2))', 'hhi')} from (select *, sum(n) over (partition by symbol) as t from c) group by symbol")
def source_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return _show(social.concentration(posts(spark, sf), "source"), ("symbol",), "sources", "hhi")


@query("dispersion", f"{_W}, m as (select symbol, session, sum(polarity * decay) / sum(decay) as mean, count(*) as n from w group by all) select w.symbol, cast(w.session as varchar) as session, {_r('case when any_value(n) < 2 then 0.0 else sqrt(sum(decay * pow(polarity - mean, 2)) / sum(decay)) end', 'dispersion')}, {_r('count(*) filter (polarity > 0.2) / greatest(1, count(*) filter (polarity < -0.2))', 'bull_bear')} from w join m on w.symbol = m.symbol and w.session = m.session group by w.symbol, w.session")
def dispersion(spark: SparkSession, sf: str) -> DataFrame:
    return _show(social.dispersion(posts(spark, sf)), ("symbol", "session"), "dispersion", "bull_bear")


@query("coordination", f"with {POSTS}, g as (select symbol, cast(floor(polarity * 10) as int) as key, count(distinct author) as authors, count(*) as n, epoch(max(created_at)) - epoch(min(created_at)) as span from posts group by all) select symbol, key, authors, n, authors >= 2 and span <= 86400 as coordinated from g")
def coordination(spark: SparkSession, sf: str) -> DataFrame:
    return social.coordination(posts(spark, sf).withColumn("key", F.floor(F.col("polarity") * 10).cast("int")), 86400)


_DAYS = f"with {POSTS}, r as (select min(session) as lo, max(session) as hi from posts), cal as (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as session from r), sy as (select distinct symbol from posts), c as (select symbol, session, count(*) as n, sum(engagement) as e from posts group by all)"


@query("gap_filled_series", f"{_DAYS} select sy.symbol, cast(cal.session as varchar) as session, coalesce(n, 0) as mentions, {_r('coalesce(e, 0.0)', 'engagement')} from sy cross join cal left join c on c.symbol = sy.symbol and c.session = cal.session")
def gap_filled_series(spark: SparkSession, sf: str) -> DataFrame:
    return _show(social.gap_filled(posts(spark, sf)), ("symbol", "session"), "mentions", "engagement")


@query("coverage_gaps", f"{_DAYS}, s as (select source, cal.session, exists (select 1 from posts p where p.source = x.source and p.session = cal.session) as ok from cal, (select distinct source from posts) x), g as (select *, sum(cast(ok as int)) over (partition by source order by session) as grp from s), u as (select source, grp, count(*) filter (not ok) as missing, min(case when ok then session end) as lo, max(case when ok then session end) as hi from g group by all) select source, cast(min(lo) as varchar) as first_session, cast(max(hi) as varchar) as last_session, max(missing) as longest_gap, (select count(distinct session) from posts p where p.source = u.source) as sessions from u group by source")
def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return _show(social.coverage(posts(spark, sf)), ("source",), "first_session", "last_session", "longest_gap", "sessions")


@query("rising", f"with {POSTS}, top as (select max(session) as t from posts), c as (select symbol, count(*) filter (session > t - 3) as recent, count(*) filter (session <= t - 3 and session > t - 17) as base from posts, top group by symbol), s as (select symbol, recent, base, round_even(case when base = 0 then 10.0 else least(10.0, greatest(-10.0, (recent / 3.0) / (base / 14.0) - 1)) end + 3e-8, 6) as rise from c where recent >= 5) select * from s order by rise desc, symbol limit 20")
def rising(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 symbols whose mention rate rose most (a top-k report)."""
    return social.rising(posts(spark, sf)).orderBy(F.desc("rise"), "symbol").limit(20)


@query("trending", f"with {POSTS}, {SECURITIES}, top as (select max(session) as t from posts), c as (select symbol, count(*) as mentions, avg(polarity) as mood, max(session) as last from posts, top where session > t - 7 group by symbol) select c.symbol, name, mentions, {_r('mood', 'mood')}, cast(last as varchar) as last_session from c left join securities s on s.symbol = c.symbol order by mentions desc, c.symbol limit 20")
def trending(spark: SparkSession, sf: str) -> DataFrame:
    t = social.trending(posts(spark, sf)).join(securities(spark, sf).select("symbol", "name"), "symbol", "left")
    return t.select("symbol", "name", "mentions", rounded("mood").alias("mood"), F.col("last").cast("string").alias("last_session")).orderBy(F.desc("mentions"), "symbol").limit(20)


@query("tumbling_windows", f"with {POSTS} select cast(time_bucket(interval 1 hour, created_at) as varchar) as window_start, source, count(*) as n, {_r('sum(engagement)', 'engagement')} from posts group by all")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = posts(spark, sf).groupBy(F.window("created_at", "1 hour").alias("w"), "source").agg(F.count("*").alias("n"), F.sum("engagement").alias("engagement"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "source", "n", rounded("engagement").alias("engagement"))


@query("session_windows", f"with {POSTS}, g as (select *, case when created_at >= lag(created_at) over (partition by author order by created_at, post_id) + interval 2 hours then 1 else 0 end as cut from posts), s as (select *, sum(cut) over (partition by author order by created_at, post_id) as sid from g), c as (select author, sid, count(*) as n from s group by all) select author, count(*) as sittings, max(n) as longest from c group by author")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return social.sittings(posts(spark, sf), "2 hours")


@query("posting_rate", f"with {POSTS}, c as (select author, session, count(*) as n from posts group by all) select author, count(*) as days, max(n) as most, {_r('avg(n)', 'mean')} from c group by author")
def posting_rate(spark: SparkSession, sf: str) -> DataFrame:
    per_day = posts(spark, sf).groupBy("author", "session").agg(F.count("*").alias("n"))
    return _show(per_day.groupBy("author").agg(F.count("*").alias("days"), F.max("n").alias("most"), F.avg("n").alias("mean")), ("author",), "days", "most", "mean")


@query("first_write_wins", f"with {POSTS} select author, symbol, arg_min(post_id, (created_at, post_id)) as post_id, count(*) as seen from posts group by all")
def first_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf)
    return p.groupBy("author", "symbol").agg(F.min_by("post_id", F.struct("created_at", "post_id")).alias("post_id"), F.count("*").alias("seen"))


@query("latest_attention", f"with {POSTS}, c as (select symbol, source, session, count(*) as mentions, avg(polarity) as mood from posts group by all), l as (select *, max(session) over (partition by symbol) as top from c) select symbol, cast(top as varchar) as session, sum(mentions)::bigint as mentions, count(*) as platforms, {_r('sum(mood * mentions) / sum(mentions)', 'mood')} from l where session = top group by symbol, top")
def latest_attention(spark: SparkSession, sf: str) -> DataFrame:
    c = posts(spark, sf).groupBy("symbol", "source", "session").agg(F.count("*").alias("mentions"), F.avg("polarity").alias("mood"))
    last = c.withColumn("top", F.max("session").over(Window.partitionBy("symbol"))).where("session = top")
    out = last.groupBy("symbol", "session").agg(F.sum("mentions").alias("m"), F.count("*").alias("platforms"), (F.sum(F.col("mood") * F.col("mentions")) / F.sum("mentions")).alias("mood"))
    return _show(out.withColumnRenamed("m", "mentions"), ("symbol", "session"), "mentions", "platforms", "mood")
