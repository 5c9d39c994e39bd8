"""Two axes of what a crowd says: polarity, from each source's own evidence, and attention, which has no sign.

`readings` sums posts up by author first and makes the rows of every source and of all together from that one aggregate. A source
counts for polarity where its own sample is large enough; sources that only tally mentions never do. A slot whose source did
not report has no weight; where no slot's source did, all posts together stand in for half of the weights. Attention blends the
growth of one's own mentions with each tally's rank within its own past, so the sizes of two corpora never meet.

Defined results: a symbol and session without posts has no row; null sources are a source of that name; sessions that are no
trading days count like the others, but rates are per trading day (one at least).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.assessment import credibility
from tidemark.operators.moving import Rank, ranked
from tidemark.operators.scoring import scale
from tidemark.operators.social import decay

BLEND = {"raw": 0.20, "engagement_weighted": 0.25, "credibility_weighted": 0.25, "unique_author": 0.30}
ALL = "all"


@dataclass(frozen=True)
class Axes:
    """Which source fills which slot with what weight, which sources only tally, and how large a sample must be."""

    slots: dict[str, float] = field(default_factory=dict)
    tallies: tuple[str, ...] = ()
    attention_weight: float = 0.10
    tally_share: float = 0.45
    least_posts: int = 8
    least_authors: int = 5
    least_history: int = 10
    history: int = 1 << 40  # rows of a tally's own past: all of it
    fast: int = 2
    slow: int = 10
    prior: float = 0.5
    least_growth: int = 5


def readings(posts: DataFrame) -> DataFrame:
    """symbol, session, source (`all` for all together), post_count, authors and the four polarity means."""
    w = posts.withColumn("d", decay()).withColumn("c", credibility())
    w = w.withColumn("e", F.col("d") * F.when(F.col("kind") == "news", 1.0).otherwise(F.log1p("engagement")))
    p = F.col("polarity")
    parts = {"n": F.count("*"), "p": F.sum(p), "d": F.sum("d"), "pd": F.sum(p * F.col("d")), "e": F.sum("e"), "pe": F.sum(p * F.col("e")), "c": F.sum(F.col("d") * F.col("c")), "pc": F.sum(p * F.col("d") * F.col("c"))}
    by_author = w.groupBy("symbol", "session", "source", "author").agg(*(x.alias(k) for k, x in parts.items()))
    both = by_author.withColumn("source", F.explode(F.array("source", F.lit(ALL))))
    author = both.groupBy("symbol", "session", "source", "author").agg(*(F.sum(k).alias(k) for k in parts))
    s = {k: F.sum(k) for k in parts}
    mean = lambda a, b: F.when(b > 1e-12, a / b).otherwise(s["p"] / s["n"])
    return author.groupBy("symbol", "session", "source").agg(
        s["n"].alias("post_count"), F.count("*").alias("authors"), (s["pd"] / s["d"]).alias("raw"), mean(s["pe"], s["e"]).alias("engagement_weighted"),
        mean(s["pc"], s["c"]).alias("credibility_weighted"), F.avg(F.col("pd") / F.col("d")).alias("unique_author"),
    )


def trading_days(sessions: DataFrame, fast: int, slow: int) -> DataFrame:
    """For each calendar day the trading days, one at least, of the last `fast` days and of the days before them back to `slow`."""
    w = Window.partitionBy(F.lit(0)).orderBy("n")  # one row a calendar day
    days = sessions.agg(F.explode(F.sequence(F.min("session"), F.max("session"))).alias("session")).join(sessions.select("session", F.lit(1).alias("open")), "session", "left")
    days = days.withColumn("n", F.datediff("session", F.lit("1970-01-01").cast("date")))
    count = lambda a, b: F.greatest(F.lit(1), F.coalesce(F.sum("open").over(w.rangeBetween(a, b)), F.lit(0)))
    return days.select("session", count(1 - fast, 0).alias("fast_days"), count(1 - slow, -fast).alias("slow_days"))


def with_growth(read: DataFrame, sessions: DataFrame, plan: Axes) -> DataFrame:
    """readings with `growth`: mentions per trading day of the last days against the days before, smoothed, 0 for a small sample."""
    w = Window.partitionBy("symbol", "source").orderBy(F.datediff("session", F.lit("1970-01-01").cast("date")))
    count = lambda a, b: F.coalesce(F.sum("post_count").over(w.rangeBetween(a, b)), F.lit(0))
    r = read.withColumns({"fast_n": count(1 - plan.fast, 0), "slow_n": count(1 - plan.slow, -plan.fast)}).join(F.broadcast(trading_days(sessions, plan.fast, plan.slow)), "session", "left")  # a row a day
    rate = lambda n, d: F.col(n) / F.coalesce(F.col(d), F.lit(1)) + plan.prior
    growth = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), rate("fast_n", "fast_days") / rate("slow_n", "slow_days") - 1.0))
    return r.withColumn("growth", F.when(F.col("fast_n") + F.col("slow_n") < plan.least_growth, 0.0).otherwise(growth)).drop("fast_n", "slow_n", "fast_days", "slow_days")


def tally_ranks(read: DataFrame, plan: Axes) -> DataFrame:
    """Each tally's growth by rank in its own past, null without enough of it."""
    only = read.where(F.col("source").isin(*plan.tallies)).select("symbol", "source", "session", "growth")
    return ranked(only, ["symbol", "source"], "session", {"rank": Rank("growth", plan.history, plan.least_history, even=True)}).select("symbol", "source", "session", "rank")


def _polarity(x: Column, sign: Column) -> Column:
    return scale(sign * sum((x[k] * w for k, w in BLEND.items()), F.lit(0.0)), -0.6, 0.6)


def score(read: DataFrame, plan: Axes) -> DataFrame:
    """symbol, session, direction with both axes, from readings with growth: a row for long and one for short."""
    fields = ("post_count", "authors", "growth", *BLEND)
    usable = (F.col("post_count") >= plan.least_posts) & (F.col("authors") >= plan.least_authors) & ~F.col("source").isin(*plan.tallies)
    ranks = tally_ranks(read, plan)
    sources = read.groupBy("symbol", "session").agg(
        *(F.max(F.when(usable & (F.col("source") == s), F.struct(*fields))).alias(f"slot_{k}") for k, s in enumerate(plan.slots)),
        F.max(F.when(usable & (F.col("source") == ALL), F.struct(*fields))).alias("together"), F.max(F.when(F.col("source") == ALL, F.col("growth"))).alias("local"),
    )
    tallied = ranks.groupBy("symbol", "session").agg(F.avg("rank").alias("tally"), F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.col("source")))).alias("tallies"))  # one a tally
    c = sources.join(tallied, ["symbol", "session"], "left").withColumn("direction", F.explode(F.array(F.lit("long"), F.lit("short"))))
    sign = F.when(F.col("direction") == "short", -1.0).otherwise(1.0)
    slots = [F.col(f"slot_{k}") for k in range(len(plan.slots))]
    any_slot = F.coalesce(*(s["raw"] for s in slots)).isNotNull() if slots else F.lit(False)
    stand_in = ~any_slot & F.col("together").isNotNull()
    axes: dict[str, Column] = {}
    for s, (name, weight) in zip(slots, plan.slots.items(), strict=True):
        axes[f"{name}_score"] = F.when(s.isNotNull(), _polarity(s, sign)).when(stand_in, _polarity(F.col("together"), sign)).otherwise(50.0)
        axes[f"{name}_weight"] = F.when(s.isNotNull(), weight).when(stand_in, weight / 2).otherwise(0.0)
    axes["measured"] = F.when(stand_in, ALL).otherwise(F.concat_ws(",", *(F.when(s.isNotNull(), n) for s, n in zip(slots, plan.slots, strict=True))))
    local = F.when(F.col("local").isNotNull(), scale(F.col("local"), -0.3, 1.0))
    tally = F.col("tally") * 100.0
    blend = (1 - plan.tally_share) * local + plan.tally_share * tally
    axes["attention_score"] = F.coalesce(blend, local, tally, F.lit(50.0))
    axes["attention_weight"] = F.when(local.isNull() & tally.isNull(), 0.0).otherwise(plan.attention_weight)
    axes["tallies"] = F.array_join(F.coalesce("tallies", F.array().cast("array<string>")), ",")
    return c.select("symbol", "session", "direction", *(x.alias(k) for k, x in axes.items()))
