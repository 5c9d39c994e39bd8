"""Authenticity of posts: credibility, bot risk, promotion language, coordination, duplicates and their blend; the daily row.

Input is posts with author_age_days, author_karma, author_followers (null: unknown), kind, community and text. Everything is grouped by
symbol and session with map-side partial sums; shares by author or text are grouped by that key first, so one symbol with a
third of all posts is spread over its authors, texts and 15-minute slots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp
from tidemark.operators.social import decay, weighted_mean

DAY = ("symbol", "session")
#: Fixed values of the rules.
NEW_ACCOUNT_DAYS, LOW_KARMA, LOW_FOLLOWERS, POSTS_PER_HOUR = 30.0, 20.0, 10.0, 4.0
BURST_POSTS, BURST_MICROS, COORDINATION_MICROS = 4, 900_000_000, 1_800_000_000
BASELINE = {"news": 0.6}
WEIGHTS = {"duplicate_ratio": 0.30, "source_concentration": 0.20, "bot_risk": 0.20, "coordination": 0.20, "pump": 0.10}
MIN_POSTS, MIN_AUTHORS, HALF_LIFE_HOURS = 8, 5, 18.0
PROMOTION = ("to the moon", "the squeeze", "guaranteed gains", "get in early")
SIMILAR = 0.75


def capped_log(x: str, top: float) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col(x), F.lit(0.0)))) / F.log1p(F.lit(top)))


def credibility() -> Column:
    """Mean of capped age, karma and followers; a baseline by kind only where none of them is known."""
    age = F.least(F.lit(1.0), F.coalesce("author_age_days", F.lit(0.0)) / 365.0)
    known = clamp((age + capped_log("author_karma", 1e4) + capped_log("author_followers", 1e5)) / 3.0, 0.0, 1.0)
    none = F.col("author_age_days").isNull() & F.col("author_karma").isNull() & F.col("author_followers").isNull()
    base = reduce(lambda c, kv: F.when(F.col("kind") == kv[0], kv[1]).otherwise(c), BASELINE.items(), F.lit(0.0))
    return F.when(none, base).otherwise(known)


def credibility_mean(posts: DataFrame) -> DataFrame:
    w = posts.withColumn("c", credibility())
    return w.groupBy(*DAY).agg(F.count("*").alias("post_count"), F.avg("c").alias("credibility"), weighted_mean(F.col("polarity"), F.col("c")).alias("credibility_weighted"))


def us() -> Column:
    return F.unix_micros(F.col("created_at").cast("timestamp"))


def burst_flags(posts: DataFrame) -> DataFrame:
    """Posts with `bursting`: BURST_POSTS posts of the symbol and session lie within 15 minutes to either side, itself included.

    A post is copied into the 15-minute slots beside its own, so that windows are partitioned by slot, not by symbol alone."""
    slot = posts.withColumn("us", us()).withColumn("home", F.floor(F.col("us") / BURST_MICROS))
    near = slot.withColumn("slot", F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1)))
    w = Window.partitionBy(*DAY, "slot").orderBy("us").rangeBetween(-BURST_MICROS, BURST_MICROS)
    return near.withColumn("near", F.count("*").over(w)).where("slot = home").withColumn("bursting", (F.col("near") >= BURST_POSTS).cast("int")).drop("slot", "home", "near")


def burst_share(posts: DataFrame) -> DataFrame:
    return burst_flags(posts).groupBy(*DAY).agg(F.avg("bursting").alias("burst"))


def share_below(x: str, limit: float) -> Column:
    """Share of known values below a limit, 0 where none is known."""
    return F.coalesce(F.try_divide(F.count_if(F.col(x) < limit), F.count(x)), F.lit(0.0))


def bot_risk(posts: DataFrame) -> DataFrame:
    accounts = posts.groupBy(*DAY).agg(F.count("*").alias("post_count"), share_below("author_age_days", NEW_ACCOUNT_DAYS).alias("new_accounts"), F.greatest(share_below("author_karma", LOW_KARMA), share_below("author_followers", LOW_FOLLOWERS)).alias("low_credibility"))
    by_author = posts.groupBy(*DAY, "author").agg(F.count("*").alias("n"), ((F.max(us()) - F.min(us())) / 3.6e9).alias("hours"))
    rate = F.when(F.col("n") >= 2, F.col("n") / F.greatest(F.lit(1e-6), F.col("hours")) / POSTS_PER_HOUR).otherwise(0.0)
    rates = by_author.groupBy(*DAY).agg(F.least(F.lit(1.0), F.max(rate)).alias("posting_rate"))
    out = accounts.join(rates, list(DAY)).join(burst_share(posts), list(DAY))
    return out.withColumn("bot_risk", clamp(0.30 * F.col("new_accounts") + 0.25 * F.col("low_credibility") + 0.25 * F.col("posting_rate") + 0.20 * F.col("burst"), 0.0, 1.0))


def promoted() -> Column:
    return F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).rlike(" (" + "|".join(PROMOTION) + ") ")


def pump_pattern(posts: DataFrame, illiquid: Column) -> DataFrame:
    d = posts.groupBy(*DAY).agg(F.avg(promoted().cast("int")).alias("density")).join(burst_share(posts), list(DAY))
    score = F.col("density") * F.when(F.col("burst") > 0.4, 1.3).otherwise(1.0) * F.when(illiquid, 1.2).otherwise(1.0)
    return d.withColumn("pump", F.least(F.lit(1.0), score))


def herfindahl(posts: DataFrame, by: str) -> DataFrame:
    c = posts.groupBy(*DAY, by).agg(F.count("*").alias("n"))
    return c.groupBy(*DAY).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias(f"{by}_hhi"))


def text_groups(posts: DataFrame) -> DataFrame:
    """Posts with equal normalised texts: their share, and the share of posts in groups by two or more authors within 30 minutes."""
    key = F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256)
    g = posts.groupBy(*DAY, key.alias("key")).agg(F.count("*").alias("n"), F.countDistinct("author").alias("authors"), (F.max(us()) - F.min(us())).alias("span"))
    together = (F.col("n") > 1) & (F.col("authors") >= 2) & (F.col("span") <= COORDINATION_MICROS)
    total = F.sum("n")
    return g.groupBy(*DAY).agg(total.alias("post_count"), (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / total).alias("duplicate_ratio"), (F.sum(F.when(together, F.col("n")).otherwise(0)) / total).alias("coordination"))


def assess(posts: DataFrame) -> DataFrame:
    """All parts and their blend; symbols and sessions with fewer than two posts get zeros."""
    parts = text_groups(posts)
    for x in (herfindahl(posts, "author"), herfindahl(posts, "community"), bot_risk(posts).select(*DAY, "bot_risk"), pump_pattern(posts, F.lit(False)).select(*DAY, "pump")):
        parts = parts.join(x, list(DAY))
    parts = parts.withColumn("source_concentration", F.greatest("author_hhi", "community_hhi"))
    parts = parts.withColumns({c: F.when(F.col("post_count") < 2, 0.0).otherwise(F.col(c)) for c in WEIGHTS})
    return parts.withColumn("manipulation_risk", clamp(sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)), 0.0, 1.0))


def aggregate_confidence(daily: DataFrame) -> DataFrame:
    """A factor for each cause: sample size, duplicates, manipulation, disagreement, age."""
    sample = F.least(F.lit(1.0), F.col("post_count") / MIN_POSTS) * F.least(F.lit(1.0), F.col("authors") / MIN_AUTHORS)
    spread = 1.0 - 0.7 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dispersion")) - 0.3)
    fresh = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.col("age_hours")) / (2 * HALF_LIFE_HOURS))
    return daily.withColumn("confidence", clamp(sample * F.greatest(F.lit(0.0), 1.0 - F.col("duplicate_ratio")) * (1.0 - F.col("manipulation_risk")) * spread * fresh, 0.0, 1.0))


def sentiment_daily(posts: DataFrame) -> DataFrame:
    """The full daily row of each symbol and session."""
    w = posts.withColumn("decay", decay()).withColumn("c", credibility())
    w = w.withColumn("e", F.col("decay") * F.when(F.col("kind") == "news", 1.0).otherwise(F.log1p("engagement"))).withColumn("age", F.log2("decay") * -HALF_LIFE_HOURS)
    p, d = F.col("polarity"), F.col("decay")
    mean = F.sum(p * d) / F.sum(d)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(d * p * p) / F.sum(d) - mean * mean))
    day = w.groupBy(*DAY).agg(
        F.count("*").alias("post_count"),
        weighted_mean(p, d).alias("raw"),
        weighted_mean(p, F.col("e")).alias("engagement_weighted"),
        weighted_mean(p, d * F.col("c")).alias("credibility_weighted"),
        F.when(F.count("*") < 2, 0.0).otherwise(spread).alias("dispersion"),
        (F.count_if(p > 0.2) / F.greatest(F.lit(1), F.count_if(p < -0.2))).alias("bull_bear"),
        F.sum("engagement").alias("total_engagement"),
        (F.sum(F.col("age") * d) / F.sum(d)).alias("age_hours"),
    )
    per_author = w.groupBy(*DAY, "author").agg((F.sum(p * d) / F.sum(d)).alias("m")).groupBy(*DAY).agg(F.count("*").alias("authors"), F.avg("m").alias("unique_author"))
    risk = assess(posts).select(*DAY, "duplicate_ratio", "source_concentration", "bot_risk", "manipulation_risk")
    return aggregate_confidence(day.join(per_author, list(DAY)).join(risk, list(DAY)))


def near_duplicates(posts: DataFrame) -> DataFrame:
    """Pairs of texts of a symbol whose sets of words have a Jaccard similarity of SIMILAR or more, each distinct text once.

    Two such sets share a word among the first n - ceil(SIMILAR n) + 1 of each in one fixed order, so only those are joined."""
    texts = posts.select("symbol", F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9']+)"), 1))).alias("words"), "post_id")
    texts = texts.groupBy("symbol", "words").agg(F.min("post_id").alias("post_id")).where(F.size("words") > 0)
    ordered = F.transform(F.array_sort(F.transform("words", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), lambda s: s["x"])
    prefix = texts.withColumn("word", F.explode(F.slice(ordered, 1, F.size("words") - F.ceil(F.size("words") * SIMILAR).cast("int") + 1)))
    a, b = (prefix.select("symbol", "word", F.col("words").alias(f"w{k}"), F.col("post_id").alias(f"id{k}")) for k in "ab")
    pairs = a.join(b, ["symbol", "word"]).where("ida < idb").dropDuplicates(["symbol", "ida", "idb"])
    score = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    return pairs.select("symbol", F.col("ida").alias("first_post"), F.col("idb").alias("second_post"), score.alias("similarity")).where(F.col("similarity") >= SIMILAR)
