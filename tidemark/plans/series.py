"""The daily row of each symbol over all its posts, session by session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import _closed
from tidemark.functions.columns import rounded
from tidemark.operators import classifier, series
from tidemark.plans.assessments import _CRED
from tidemark.plans.classified import SCORES, composed
from tidemark.registry import query
from tidemark.sources.adapters import POSTS, RICH, rich_posts

_r = lambda x, n: f"round_even({x} + 3e-8, 6) + 0.0 as {n}"
COUNTS = ("post_count", "authors", "later")
NUMBERS = ("raw", "engagement_weighted", "credibility_weighted", "unique_author", "dispersion", "acceleration", "mention_growth", "bull_bear", "age_hours", "total_engagement", "author_concentration", *series.MEANS)


def scored_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with account facts, the classifier's labels on their texts, and the polarity that these give."""
    p = classifier.classify(rich_posts(spark, sf).withColumn("text", composed()))
    return p.withColumn("polarity", F.col("bullish") - F.col("bearish"))


_HOLIDAYS = ", ".join(f"date '{d}'" for d in _closed("2023-12-01", "2024-12-31"))
_open = lambda a, b: f"(select count(*) from open_days o where o.session > s.session - {a} and o.session <= s.session - {b})"
_mean = lambda v: f"case when sum(d) > 1e-12 then sum(d * {v}) / sum(d) else avg({v}) end"
#: Each session joined with all posts up to its close, by the plain rule.
_SERIES = f"""with {SCORES}, {RICH}, {_CRED},
px as (select r.post_id, r.symbol, r.created_at, r.author, r.kind, r.engagement, r.c, sc.bullish - sc.bearish as p, sc.bullish, sc.bearish, {', '.join(f'sc.{k}' for k in series.LABELS)}, greatest({', '.join(f'sc.{k}' for k in series.CATALYSTS)}) as catalyst_quality from cred r join sc using (post_id)),
bounds as (select cast(min(created_at) - interval 20 hours as date) - 12 as lo, cast(max(created_at) - interval 20 hours - interval 1 microsecond as date) + 1 as hi from px),
open_days as (select cast(x as date) as session from (select unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day)) as x from bounds) where isodow(x) < 6 and cast(x as date) not in ({_HOLIDAYS})),
s as (select session, session::timestamp + interval 20 hours as close from open_days),
opened as (select session, {_open(2, 0)} as open_recent, {_open(10, 2)} as open_base from s),
el as (select s.session, s.close, px.*, (epoch_us(close) - epoch_us(created_at)) / 3.6e9 as age from s join px on px.created_at <= s.close),
w as (select *, pow(0.5, age / 18.0) as d, pow(0.5, age / 18.0) * case when kind = 'news' then 1.0 else ln(1 + engagement) end as e, pow(0.5, age / 18.0) * c as cw from el),
by_author as (select symbol, session, author, count(*) as k, {_mean('p')} as m from w group by all),
ba as (select symbol, session, count(*) as authors, avg(m) as unique_author, sum(k * k) as squares from by_author group by all),
totals as (select symbol, count(*) as everything from px group by symbol),
ag as (select symbol, session, count(*) as post_count, {_mean('p')} as raw, case when sum(e) > 1e-12 then sum(e * p) / sum(e) else avg(p) end as engagement_weighted, case when sum(cw) > 1e-12 then sum(cw * p) / sum(cw) else avg(p) end as credibility_weighted,
  case when count(*) < 2 or sum(d) <= 1e-12 then 0.0 else sqrt(greatest(0.0, sum(d * p * p) / sum(d) - pow(sum(d * p) / sum(d), 2))) end as dispersion,
  coalesce(sum(d * p) filter (age < 48) / sum(d) filter (age < 48), 0.0) - coalesce(sum(d * p) filter (age < 240) / sum(d) filter (age < 240), 0.0) as acceleration,
  count(*) filter (age < 48) as recent, count(*) filter (age >= 48 and age < 240) as base, case when sum(d * bearish) > 1e-9 then sum(d * bullish) / sum(d * bearish) when sum(d * bullish) <= 1e-9 then 1.0 else 10.0 end as bull_bear,
  {_mean('age')} as age_hours, sum(engagement) as total_engagement, {', '.join(f'{_mean(k)} as {k}' for k in series.MEANS)} from w group by symbol, session),
series as (select ag.*, ba.authors, ba.unique_author, squares / (post_count * post_count) as author_concentration, everything - post_count as later,
  case when recent + base < 5 then 0.0 else least(10.0, greatest(-10.0, (recent / greatest(1, open_recent) + 0.5) / (base / greatest(1, open_base) + 0.5) - 1)) end as mention_growth
  from ag join ba using (symbol, session) join totals using (symbol) join opened using (session))"""


@query("sentiment_series", f"{_SERIES} select symbol, cast(session as varchar) as session, {', '.join(COUNTS)}, {', '.join(_r(c, c) for c in NUMBERS)} from series")
def sentiment_series(spark: SparkSession, sf: str) -> DataFrame:
    s = series.daily_series(scored_posts(spark, sf))
    return s.select("symbol", F.col("session").cast("string").alias("session"), *COUNTS, *(rounded(c).alias(c) for c in NUMBERS))
