"""Aggregations over posts(post_id, source, created_at, session, author, symbol, engagement, polarity).

All are one or two grouped aggregations with map-side partial sums; a symbol or author that holds a third of all posts
is summed on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE_HOURS = 18.0
CLOSE_SECONDS = 72_000  # 20:00 UTC


def decay() -> Column:
    """0.5 ** (age at the session's close / half-life); a post after the close counts in full."""
    close = F.unix_timestamp(F.col("session").cast("timestamp")) + CLOSE_SECONDS
    age = (close - F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6) / 3600.0
    return F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / HALF_LIFE_HOURS)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.when(F.sum(weight) > 1e-12, F.sum(value * weight) / F.sum(weight)).otherwise(F.avg(value))


def daily_sentiment(posts: DataFrame) -> DataFrame:
    w = posts.withColumn("decay", decay()).withColumn("weight", F.col("decay") * F.log1p("engagement"))
    return w.groupBy("symbol", "session").agg(F.count("*").alias("post_count"), weighted_mean(F.col("polarity"), F.col("decay")).alias("raw"), weighted_mean(F.col("polarity"), F.col("weight")).alias("engagement_weighted"))


def unique_author_sentiment(posts: DataFrame) -> DataFrame:
    per_author = posts.withColumn("decay", decay()).groupBy("symbol", "session", "author").agg(weighted_mean(F.col("polarity"), F.col("decay")).alias("m"), F.count("*").alias("n"))
    return per_author.groupBy("symbol", "session").agg(F.count("*").alias("authors"), F.sum("n").alias("post_count"), F.avg("m").alias("unique_author_sentiment"))


def _last_session(posts: DataFrame) -> DataFrame:
    return posts.crossJoin(F.broadcast(posts.agg(F.max("session").alias("top"))))  # one row


def mention_growth(posts: DataFrame, recent: int = 2, base: int = 10, prior: float = 0.5, least: int = 5) -> DataFrame:
    age = F.datediff("top", "session")
    c = _last_session(posts).groupBy("symbol").agg(F.count_if(age < recent).alias("recent"), F.count_if((age >= recent) & (age < recent + base)).alias("base"))
    growth = (F.col("recent") / recent + prior) / (F.col("base") / base + prior) - 1
    return c.withColumn("growth", F.when(F.col("recent") + F.col("base") < least, 0.0).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(-10.0), growth))))


def burst(posts: DataFrame, micros: int = 900_000_000) -> DataFrame:
    """Share of posts with at least 4 posts of the symbol within 15 minutes to either side. Posts are copied into the 15-minute slots
    beside their own, so that windows are partitioned by symbol and slot."""
    w = Window.partitionBy("symbol", "slot").orderBy("us").rangeBetween(-micros, micros)
    p = posts.withColumn("us", F.unix_micros(F.col("created_at").cast("timestamp"))).withColumn("home", F.floor(F.col("us") / micros))
    near = p.withColumn("slot", F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1))).withColumn("near", F.count("*").over(w)).where("slot = home")
    return near.groupBy("symbol", "session").agg(F.count("*").alias("post_count"), F.avg((F.col("near") >= 4).cast("int")).alias("burst"))


def concentration(posts: DataFrame, by: str) -> DataFrame:
    c = posts.groupBy("symbol", by).agg(F.count("*").alias("n"))
    c = c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol")))
    return c.groupBy("symbol").agg(F.count("*").alias(f"{by}s"), F.sum(F.col("share") * F.col("share")).alias("hhi"))


def dispersion(posts: DataFrame) -> DataFrame:
    """Weighted standard deviation from sums of w, w x and w x x (values lie in [-1, 1]), and the ratio of bullish to bearish posts."""
    x, d = F.col("polarity"), F.col("decay")
    mean = F.sum(d * x) / F.sum(d)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.sum(d * x * x) / F.sum(d) - mean * mean))
    bulls, bears = F.count_if(x > 0.2), F.count_if(x < -0.2)
    return posts.withColumn("decay", decay()).groupBy("symbol", "session").agg(F.when(F.count("*") < 2, 0.0).otherwise(sd).alias("dispersion"), (bulls / F.greatest(F.lit(1), bears)).alias("bull_bear"))


def coordination(posts: DataFrame, seconds: int) -> DataFrame:
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    g = posts.groupBy("symbol", "key").agg(F.countDistinct("author").alias("authors"), F.count("*").alias("n"), (F.max(us) - F.min(us)).alias("span"))
    return g.select("symbol", "key", "authors", "n", ((F.col("authors") >= 2) & (F.col("span") <= seconds * 1_000_000)).alias("coordinated"))


def calendar(posts: DataFrame) -> DataFrame:
    """All days from the first to the last session: one row a day."""
    return posts.agg(F.min("session").alias("lo"), F.max("session").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("session"))


def gap_filled(posts: DataFrame) -> DataFrame:
    """Every symbol on every day, zeros where nothing was posted. The days are expanded inside each symbol's row."""
    span = posts.agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    grid = posts.select("symbol").distinct().crossJoin(F.broadcast(span)).select("symbol", F.explode(F.sequence("lo", "hi")).alias("session"))
    daily = posts.groupBy("symbol", "session").agg(F.count("*").alias("mentions"), F.sum("engagement").alias("engagement"))
    return grid.join(daily, ["symbol", "session"], "left").withColumn("mentions", F.coalesce("mentions", F.lit(0))).withColumn("engagement", F.coalesce("engagement", F.lit(0.0)))


def coverage(posts: DataFrame) -> DataFrame:
    """First, last and number of collected sessions of each source, and its longest run of missing days."""
    span = posts.agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    have = posts.select("source", "session").distinct()
    with_gaps = have.crossJoin(F.broadcast(span)).withColumn("next", F.lead("session").over(Window.partitionBy("source").orderBy("session")))
    first = F.row_number().over(Window.partitionBy("source").orderBy("session")) == 1
    gap = F.datediff(F.coalesce("next", F.date_add("hi", 1)), "session") - 1
    with_gaps = with_gaps.withColumn("gap", F.greatest(gap, F.when(first, F.datediff("session", "lo")).otherwise(0)))
    out = with_gaps.groupBy("source").agg(F.min("session").cast("string").alias("first_session"), F.max("session").cast("string").alias("last_session"), F.max("gap").cast("long").alias("longest_gap"), F.count("*").alias("sessions"))
    return out


def rising(posts: DataFrame, recent: int = 3, base: int = 14, least: int = 5) -> DataFrame:
    age = F.datediff("top", "session")
    c = _last_session(posts).groupBy("symbol").agg(F.count_if(age < recent).alias("recent"), F.count_if((age >= recent) & (age < recent + base)).alias("base")).where(F.col("recent") >= least)
    rise = F.when(F.col("base") == 0, 10.0).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(-10.0), F.try_divide(F.col("recent") / recent, F.col("base") / base) - 1)))
    return c.withColumn("rise", F.bround(rise + 3e-8, 6))


def trending(posts: DataFrame, days: int = 7) -> DataFrame:
    near = _last_session(posts).where(F.datediff("top", "session") < days)
    return near.groupBy("symbol").agg(F.count("*").alias("mentions"), F.avg("polarity").alias("mood"), F.max("session").alias("last"))


def sittings(posts: DataFrame, gap: str) -> DataFrame:
    """Runs of an author's posts with less than `gap` between neighbours."""
    s = posts.groupBy("author", F.session_window("created_at", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("author").agg(F.count("*").alias("sittings"), F.max("n").alias("longest"))
