"""Batch forms of the keyed streams: posting rates with late posts, and sticky collection coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.sources.adapters import ARRIVALS, OUTCOMES, POSTS, arrivals, outcomes
from tidemark.streaming import state


@query("late_posts", f"with {POSTS}, {ARRIVALS}, n as (select *, max(created_at) over (partition by author order by arrival, post_id rows between unbounded preceding and 1 preceding) as newest from arrivals) select author, cast(session as varchar) as session, count(*) filter (not coalesce(created_at < newest - interval 6 hour, false)) as posts, count(*) filter (coalesce(created_at < newest - interval 6 hour, false)) as late from n group by author, session")
def late_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of an author's day, and how many of them came too late to count."""
    return state.rates_of(arrivals(spark, sf)).select("author", F.col("session").cast("string").alias("session"), "posts", "late")


@query("coverage_status", f"with {POSTS}, {OUTCOMES} select cast(session as varchar) as session, source, case when bool_or(ok) then 'ok' else 'failed' end as status, (max({{'a': arrival, 'e': error}})).e as error, max(coalesce(posts, 0)) as posts, strftime(min(seen_at), '%Y-%m-%d %H:%M:%S') as first_at from outcomes group by session, source")
def coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    """A session that a source covered once stays covered, whatever failed later."""
    c = state.coverage_of(outcomes(spark, sf))
    return c.select(F.col("session").cast("string").alias("session"), "source", "status", "error", "posts", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"))
