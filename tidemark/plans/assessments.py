"""Queries over posts with account facts and texts: credibility, bot risk, promotion, manipulation, the daily row, near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import assessment as ops
from tidemark.registry import query
from tidemark.sources.adapters import POSTS, RICH, rich_posts

DAY = "cast(session as varchar) as session"
_r = lambda x, n: f"round_even({x} + 3e-8, 6) + 0.0 as {n}"
_CRED = """cred as (select *, case when author_age_days is null and author_karma is null and author_followers is null then case when kind = 'news' then 0.6 else 0.0 end
  else least(1.0, greatest(0.0, (least(1.0, coalesce(author_age_days, 0) / 365.0) + least(1.0, ln(1 + coalesce(author_karma, 0)) / ln(10001)) + least(1.0, ln(1 + coalesce(author_followers, 0)) / ln(100001))) / 3.0)) end as c from rich)"""
_BURST = """near as (select symbol, session, count(*) over (partition by symbol, session order by created_at range between interval 15 minutes preceding and interval 15 minutes following) as k from rich),
burst as (select symbol, session, avg(cast(k >= 4 as int)) as burst from near group by all)"""
_BOT = f"""{_BURST}, acc as (select symbol, session, count(*) as post_count, coalesce(count(*) filter (author_age_days < 30) / nullif(count(author_age_days), 0), 0.0) as new_accounts,
  greatest(coalesce(count(*) filter (author_karma < 20) / nullif(count(author_karma), 0), 0.0), coalesce(count(*) filter (author_followers < 10) / nullif(count(author_followers), 0), 0.0)) as low_credibility from rich group by all),
per_author as (select symbol, session, author, count(*) as n, (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 3.6e9 as hours from rich group by all),
rates as (select symbol, session, least(1.0, max(case when n >= 2 then n / greatest(1e-6, hours) / 4.0 else 0.0 end)) as posting_rate from per_author group by all),
bots as (select *, least(1.0, greatest(0.0, 0.30 * new_accounts + 0.25 * low_credibility + 0.25 * posting_rate + 0.20 * burst)) as bot_risk from acc join rates using (symbol, session) join burst using (symbol, session))"""
_PUMP = """pumped as (select symbol, session, avg(cast(regexp_matches(' ' || lower(text) || ' ', ' (to the moon|the squeeze|guaranteed gains|get in early) ') as int)) as density from rich group by all),
pump as (select symbol, session, density, burst, least(1.0, density * case when burst > 0.4 then 1.3 else 1.0 end) as pump from pumped join burst using (symbol, session))"""
_ASSESS = f"""{_BOT}, {_PUMP},
texts as (select symbol, session, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as key, count(*) as n, count(distinct author) as authors, epoch_us(max(created_at)) - epoch_us(min(created_at)) as span from rich group by all),
dupes as (select symbol, session, sum(n) as post_count, sum(case when n > 1 then n else 0 end) / sum(n) as duplicate_ratio, sum(case when n > 1 and authors >= 2 and span <= 1800000000 then n else 0 end) / sum(n) as coordination from texts group by all),
ca as (select symbol, session, author, count(*) as n from rich group by all), cc as (select symbol, session, community, count(*) as n from rich group by all),
ha as (select symbol, session, sum(n * n) / (sum(n) * sum(n)) as h from ca group by all), hc as (select symbol, session, sum(n * n) / (sum(n) * sum(n)) as h from cc group by all),
parts as (select symbol, session, d.post_count, case when d.post_count < 2 then 0.0 else duplicate_ratio end as duplicate_ratio, case when d.post_count < 2 then 0.0 else coordination end as coordination,
  case when d.post_count < 2 then 0.0 else greatest(ha.h, hc.h) end as source_concentration, case when d.post_count < 2 then 0.0 else bot_risk end as bot_risk, case when d.post_count < 2 then 0.0 else pump end as pump
  from dupes d join ha using (symbol, session) join hc using (symbol, session) join bots using (symbol, session) join pump using (symbol, session)),
assessed as (select *, least(1.0, greatest(0.0, 0.30 * duplicate_ratio + 0.20 * source_concentration + 0.20 * bot_risk + 0.20 * coordination + 0.10 * pump)) as manipulation_risk from parts)"""
DAILY = f"""{_CRED}, {_ASSESS},
aged as (select *, greatest((epoch(session) + 72000 - epoch(created_at)) / 3600.0, 0.0) as age from cred),
weighed as (select *, pow(0.5, age / 18.0) as d, pow(0.5, age / 18.0) * case when kind = 'news' then 1.0 else ln(1 + engagement) end as e from aged),
means as (select symbol, session, count(*) as post_count, sum(polarity * d) / sum(d) as raw, case when sum(e) > 1e-12 then sum(polarity * e) / sum(e) else avg(polarity) end as engagement_weighted,
  case when sum(d * c) > 1e-12 then sum(polarity * d * c) / sum(d * c) else avg(polarity) end as credibility_weighted,
  case when count(*) < 2 then 0.0 else sqrt(greatest(0.0, sum(d * polarity * polarity) / sum(d) - pow(sum(polarity * d) / sum(d), 2))) end as dispersion,
  count(*) filter (polarity > 0.2) / greatest(1, count(*) filter (polarity < -0.2)) as bull_bear, sum(engagement) as total_engagement, sum(age * d) / sum(d) as age_hours from weighed group by all),
by_author as (select symbol, session, author, sum(polarity * d) / sum(d) as m from weighed group by all),
uniq as (select symbol, session, count(*) as authors, avg(m) as unique_author from by_author group by all),
daily as (select m.*, authors, unique_author, a.duplicate_ratio, a.source_concentration, a.bot_risk, a.manipulation_risk,
  least(1.0, greatest(0.0, least(1.0, m.post_count / 8.0) * least(1.0, authors / 5.0) * greatest(0.0, 1.0 - duplicate_ratio) * (1.0 - manipulation_risk) * (1.0 - 0.7 * greatest(0.0, least(1.0, dispersion) - 0.3)) * pow(0.5, age_hours / 36.0))) as confidence
  from means m join uniq using (symbol, session) join assessed a using (symbol, session))"""


def show(df: DataFrame, plain: tuple, *numbers: str) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) if c == "session" else F.col(c) for c in plain), *(rounded(F.col(n).cast("double")).alias(n) for n in numbers))


def _sql(ctes: str, source: str, plain: tuple, *numbers: str) -> str:
    listed = ", ".join([DAY if c == "session" else c for c in plain] + [_r(n, n) for n in numbers])
    return f"with {POSTS}, {RICH}, {ctes} select {listed} from {source}"


@query("credibility_mean", _sql(f"{_CRED}, means as (select symbol, session, count(*) as post_count, avg(c) as credibility, case when sum(c) > 1e-12 then sum(polarity * c) / sum(c) else avg(polarity) end as credibility_weighted from cred group by all)", "means", ("symbol", "session", "post_count"), "credibility", "credibility_weighted"))
def credibility_mean(spark: SparkSession, sf: str) -> DataFrame:
    return show(ops.credibility_mean(rich_posts(spark, sf)), ("symbol", "session", "post_count"), "credibility", "credibility_weighted")


@query("bot_risk", _sql(_BOT, "bots", ("symbol", "session", "post_count"), "new_accounts", "low_credibility", "posting_rate", "burst", "bot_risk"))
def bot_risk(spark: SparkSession, sf: str) -> DataFrame:
    return show(ops.bot_risk(rich_posts(spark, sf)), ("symbol", "session", "post_count"), "new_accounts", "low_credibility", "posting_rate", "burst", "bot_risk")


@query("pump_pattern", _sql(f"{_BURST}, {_PUMP}", "pump", ("symbol", "session"), "density", "burst", "pump"))
def pump_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return show(ops.pump_pattern(rich_posts(spark, sf), F.lit(False)), ("symbol", "session"), "density", "burst", "pump")


@query("manipulation_assessment", _sql(_ASSESS, "assessed", ("symbol", "session"), *ops.WEIGHTS, "manipulation_risk"))
def manipulation_assessment(spark: SparkSession, sf: str) -> DataFrame:
    return show(ops.assess(rich_posts(spark, sf)), ("symbol", "session"), *ops.WEIGHTS, "manipulation_risk")


_NUMBERS = ("raw", "engagement_weighted", "credibility_weighted", "unique_author", "dispersion", "bull_bear", "total_engagement", "age_hours", "duplicate_ratio", "source_concentration", "bot_risk", "manipulation_risk", "confidence")


@query("sentiment_daily", _sql(DAILY, "daily", ("symbol", "session", "post_count", "authors"), *_NUMBERS))
def sentiment_daily(spark: SparkSession, sf: str) -> DataFrame:
    return show(ops.sentiment_daily(rich_posts(spark, sf)), ("symbol", "session", "post_count", "authors"), *_NUMBERS)


@query("near_duplicate_posts", f"""with {POSTS}, {RICH}, words as (select symbol, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) as w, min(post_id) as post_id from rich group by symbol, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')))),
pairs as (select a.symbol, a.post_id as first_post, b.post_id as second_post, len(list_intersect(a.w, b.w)) as shared, len(a.w) + len(b.w) as total from words a join words b on a.symbol = b.symbol and a.post_id < b.post_id)
select symbol, first_post, second_post, {_r('shared / (total - shared)', 'similarity')} from pairs where shared / (total - shared) >= 0.75""")
def near_duplicate_posts(spark: SparkSession, sf: str) -> DataFrame:
    return show(ops.near_duplicates(rich_posts(spark, sf)), ("symbol", "first_post", "second_post"), "similarity")


@query("readiness_tier", f"with {POSTS}, c as (select symbol, count(distinct session) as sessions from posts group by symbol) select symbol, sessions, case when sessions >= 120 then 'full' when sessions >= 60 then 'good' when sessions >= 20 then 'basic' else 'none' end as tier from c")
def readiness_tier(spark: SparkSession, sf: str) -> DataFrame:
    c = rich_posts(spark, sf).groupBy("symbol").agg(F.countDistinct("session").alias("sessions"))
    tier = F.when(F.col("sessions") >= 120, "full").when(F.col("sessions") >= 60, "good").when(F.col("sessions") >= 20, "basic").otherwise("none")
    return c.withColumn("tier", tier)


@query("platform_aggregate", f"""with {POSTS}, p as (select symbol, session, source, count(*) as mentions, avg(polarity) as mood, case when avg(polarity) > 0.1 then 'rising' when avg(polarity) < -0.1 then 'falling' else 'stable' end as trend from posts group by all),
v as (select symbol, session, trend, sum(mentions) as votes from p group by all), t as (select symbol, session, arg_max(trend, (votes, trend)) as trend from v group by all)
select symbol, {DAY}, sum(mentions)::bigint as mentions, count(*) as platforms, {_r('sum(mood * mentions) / sum(mentions)', 'mood')}, any_value(t.trend) as trend from p join t using (symbol, session) group by symbol, session""")
def platform_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    p = rich_posts(spark, sf).groupBy("symbol", "session", "source").agg(F.count("*").alias("mentions"), F.avg("polarity").alias("mood"))
    p = p.withColumn("trend", F.when(F.col("mood") > 0.1, "rising").when(F.col("mood") < -0.1, "falling").otherwise("stable"))
    votes = p.groupBy("symbol", "session", "trend").agg(F.sum("mentions").alias("votes"), F.sum(F.col("mood") * F.col("mentions")).alias("m"), F.count("*").alias("k"))
    out = votes.groupBy("symbol", "session").agg(F.sum("votes").alias("mentions"), F.sum("k").alias("platforms"), (F.sum("m") / F.sum("votes")).alias("mood"), F.max_by("trend", F.struct("votes", "trend")).alias("trend"))
    return out.select("symbol", F.col("session").cast("string").alias("session"), "mentions", "platforms", rounded("mood").alias("mood"), "trend")


@query("attention_history", f"with {POSTS}, c as (select symbol, source, session, count(*) as n from posts group by all) select symbol, source, count(*) as sessions, string_agg(cast(session as varchar) || ':' || n, ',' order by session) as history from c group by symbol, source")
def attention_history(spark: SparkSession, sf: str) -> DataFrame:
    c = rich_posts(spark, sf).groupBy("symbol", "source", "session").agg(F.count("*").alias("n"))
    points = F.array_sort(F.collect_list(F.struct("session", "n")))
    return c.groupBy("symbol", "source").agg(F.count("*").alias("sessions"), F.array_join(F.transform(points, lambda s: F.concat_ws(":", s["session"].cast("string"), s["n"].cast("string"))), ",").alias("history"))
