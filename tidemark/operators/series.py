"""The daily row of each symbol over all its posts up to each session's close.

A row of a session sees every earlier post, so a join of sessions and posts would grow with their product. Instead posts are summed up once
by (symbol, author, day), and state is carried from day to day: a decayed sum halves by a known factor, so all of them are running sums in
one window by symbol. An author's own decayed mean does not change while the author is silent; only its changes are sent on, and their
running sum is the sum of all authors' means. A symbol with a third of all posts is summed up in each task, then by its authors.

A day is the 24 hours up to a close (`close_seconds` after midnight, UTC); its posts count from that close on. Windows of d days hold posts
that are less than d days old at the close.

Defined results: rows run from a symbol's first day to the last day of all posts, trading sessions only; sessions before a symbol's first
post have none. A post without author is an author of its own for the mean and none in `authors`. A post without time, symbol or session
is dropped, null polarity and labels count as 0. Equal posts each count. No posts give no rows.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import sessions
from tidemark.operators.assessment import credibility
from tidemark.operators.social import CLOSE_SECONDS, HALF_LIFE_HOURS

#: Labels whose decayed means are shown; catalyst_quality is the greatest of the three catalysts.
CATALYSTS = ("earnings_speculation", "product_catalyst", "regulatory_catalyst")
LABELS = ("hype", "fear", "capitulation", "uncertainty", "sarcasm", "fomo", "rumour", "short_squeeze", "pump_and_dump", "position_disclosure", "options_call", "options_put", *CATALYSTS)
MEANS = (*LABELS, "catalyst_quality")
FAST_DAYS, SLOW_DAYS, PRIOR, LEAST_MENTIONS = 2, 10, 0.5, 5
NO_WEIGHT = 1e-12  # a mean whose weights sum up to no more is a plain one
HALVINGS = 24.0 / HALF_LIFE_HOURS  # a day
SPAN = 256  # days of a block: 2 ** (SPAN * HALVINGS) is a double, and what lies two blocks back is below the last bit
DAY_MICROS = 86_400_000_000
EPOCH = date(1970, 1, 1)


def decayed(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """columns summed over all rows of a key up to `day`, each halved HALVINGS times a day; one row a key and day.

    Inside a block a running sum of values scaled up by their day is scaled down again; the block before adds its sum."""
    day, block = F.col("day"), F.col("_block")
    start = block * SPAN
    r = rows.withColumn("_block", F.floor(day / SPAN)).withColumn("_up", F.pow(F.lit(2.0), (day - start) * HALVINGS)).withColumn("_back", F.pow(F.lit(2.0), (day - start - (SPAN - 1)) * HALVINGS))
    own = Window.partitionBy(*keys, "_block").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1)
    carried = {c: F.coalesce(F.sum(F.col(c) * F.col("_back")).over(before), F.lit(0.0)).alias(f"_prev_{c}") for c in columns}
    r = r.select("*", *carried.values(), *(F.sum(F.col(c) * F.col("_up")).over(own).alias(f"_own_{c}") for c in columns))
    far = F.pow(F.lit(2.0), -(day - start + 1) * HALVINGS)
    out = r.withColumns({c: F.col(f"_own_{c}") / F.col("_up") + F.col(f"_prev_{c}") * far for c in columns})
    return out.drop("_block", "_up", "_back", *(f"_prev_{c}" for c in columns), *(f"_own_{c}" for c in columns))


def _weighed(posts: DataFrame, close_seconds: int) -> DataFrame:
    """Posts with their day and, as arrays of named parts, what is summed."""
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    p = posts.where("symbol is not null and created_at is not null").withColumn("_us", us - close_seconds * 1_000_000)
    p = p.withColumn("day", F.expr(f"cast(floor((_us - 1) / {DAY_MICROS}D) + 1 as int)"))
    age = (F.col("day").cast("long") * DAY_MICROS - F.col("_us")) / 3.6e9
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    anonymous = F.concat(F.lit("post "), F.coalesce(F.col("post_id").cast("string"), F.lit("")))
    return p.select(
        "symbol", "day", F.col("author").isNotNull().alias("known"), F.coalesce(F.col("author").cast("string"), anonymous).alias("author"), age.alias("age"),
        F.pow(F.lit(0.5), age / HALF_LIFE_HOURS).alias("d"), zero("polarity").alias("p"), F.greatest(zero("engagement"), F.lit(0.0)).alias("engagement"),
        F.when(F.col("kind") == "news", 1.0).otherwise(F.log1p(F.greatest(zero("engagement"), F.lit(0.0)))).alias("reach"), credibility().alias("cred"),
        zero("bullish").alias("bullish"), zero("bearish").alias("bearish"), *(zero(c).alias(c) for c in LABELS), F.greatest(*(zero(c) for c in CATALYSTS)).alias("catalyst_quality"),
    )


def _parts() -> tuple[dict[str, Column], dict[str, Column]]:
    """Sums that decay (each over d) and sums that don't. Ages are kept as hours since the epoch, which do not change with the close."""
    d, p = F.col("d"), F.col("p")
    born = F.col("day") * 24.0 - F.col("age")
    fading = {"d": d, "dp": d * p, "dpp": d * p * p, "db": d * born, "e": d * F.col("reach"), "ep": d * F.col("reach") * p, "c": d * F.col("cred"), "cp": d * F.col("cred") * p}
    fading |= {"up": d * F.col("bullish"), "down": d * F.col("bearish")} | {f"d_{k}": d * F.col(k) for k in MEANS}
    lasting = {"n": F.lit(1.0), "p": p, "b": born, "engagement": F.col("engagement")} | {f"n_{k}": F.col(k) for k in MEANS}
    return fading, lasting


def _author_changes(days: DataFrame) -> DataFrame:
    """Rows by (symbol, day) with what an author's day adds to the sum of means, the counts and the squared counts.

    Once an author's weights have faded to NO_WEIGHT, the plain mean takes the place of the decayed one; that day has a row of its own."""
    keys = ["symbol", "author"]
    w = Window.partitionBy(*keys).orderBy("day")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    a = decayed(days.withColumns({"ad": F.col("d"), "adp": F.col("dp")}), keys, ["ad", "adp"])
    a = a.withColumns({"an": F.sum("n").over(so_far), "ap": F.sum("p").over(so_far), "next": F.lead("day").over(w)})
    plain = F.col("ap") / F.col("an")
    faded = F.greatest(F.lit(0), F.ceil(F.log2(F.col("ad") / NO_WEIGHT) / HALVINGS)).cast("int")
    a = a.withColumn("plain", plain).withColumn("fades", F.col("day") + faded).withColumn("mean", F.when(F.col("fades") == F.col("day"), plain).otherwise(F.col("adp") / F.col("ad")))
    a = a.withColumn("turns", (F.col("fades") > F.col("day")) & (F.col("next").isNull() | (F.col("fades") < F.col("next"))))
    before = F.lag(F.when(F.col("turns"), F.col("plain")).otherwise(F.col("mean"))).over(w)
    first = (F.row_number().over(w) == 1).cast("double")
    a = a.withColumns({"voices": first, "authors": first * F.col("known").cast("double"), "shift": F.col("mean") - F.coalesce(before, F.lit(0.0)), "squares": F.col("an") * F.col("an") - F.coalesce(F.pow(F.lag("an").over(w), 2), F.lit(0.0))})
    fading, lasting = _parts()
    summed = [*fading, *lasting]
    now = F.struct("day", "voices", "authors", "shift", "squares", *summed)
    later = F.struct(F.col("fades").alias("day"), *(F.lit(0.0).alias(c) for c in ("voices", "authors")), (F.col("plain") - F.col("mean")).alias("shift"), F.lit(0.0).alias("squares"), *(F.lit(0.0).alias(c) for c in summed))
    return a.select("symbol", F.explode(F.when(F.col("turns"), F.array(now, later)).otherwise(F.array(now))).alias("x")).select("symbol", "x.*")


def trading_days(spark: SparkSession, first: date, last: date) -> DataFrame:
    """day (days since 1970), session (null on other days), ordinal: trading sessions up to and with the day."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"))).alias("date"))
    open_days = sessions(spark, str(first), str(last)).select(F.col("session").alias("date"), F.col("session"))
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one small calendar
    c = days.join(F.broadcast(open_days), "date", "left").withColumn("ordinal", F.count("session").over(w))
    return c.select(F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), "session", "ordinal")


def daily_series(posts: DataFrame, close_seconds: int = CLOSE_SECONDS) -> DataFrame:
    """A row for each symbol and session of posts(post_id, symbol, created_at, author, kind, engagement, author_age_days, author_karma,
    author_followers, polarity, bullish, bearish, LABELS). Other columns are ignored."""
    us = F.unix_micros(F.col("created_at").cast("timestamp")) - close_seconds * 1_000_000
    span = posts.where("symbol is not null").agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()  # two numbers
    lo, hi = ((None, None) if span["lo"] is None else (-(-span[k] // DAY_MICROS) for k in ("lo", "hi")))
    if lo is None:
        lo = hi = 0
    fading, lasting = _parts()
    per_author = _weighed(posts, close_seconds).groupBy("symbol", "author", "known", "day").agg(*(F.sum(c).alias(k) for k, c in (fading | lasting).items()))
    changes = _author_changes(per_author).where(F.col("day") <= hi)
    counts = ["voices", "authors", "shift", "squares"]
    daily = changes.groupBy("symbol", "day").agg(*(F.sum(c).alias(c) for c in (*counts, *fading, *lasting)))
    # each day stands for itself and the empty days up to the next one
    until = F.coalesce(F.lead("day").over(Window.partitionBy("symbol").orderBy("day")) - 1, F.lit(hi))
    grid = daily.withColumn("until", until).select("*", F.posexplode(F.sequence("day", "until")).alias("at", "to")).drop("until")
    grid = grid.select("symbol", F.col("to").alias("day"), *(F.when(F.col("at") == 0, F.col(c)).otherwise(0.0).alias(c) for c in (*counts, *fading, *lasting)))

    w = Window.partitionBy("symbol").orderBy("day")
    so_far, recent, base = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1 - FAST_DAYS, 0), w.rowsBetween(1 - SLOW_DAYS, -FAST_DAYS)
    near = {f"{x}_{name}": sum((F.coalesce(F.lag(x, k).over(w), F.lit(0.0)) * 2.0 ** (-k * HALVINGS) for k in range(1, days)), F.col(x)) for name, days in (("fast", FAST_DAYS), ("slow", SLOW_DAYS)) for x in ("d", "dp")}
    grid = grid.withColumns(near | {"recent": F.sum("n").over(recent), "base": F.coalesce(F.sum("n").over(base), F.lit(0.0)), "all": F.sum("n").over(Window.partitionBy("symbol"))} | {c: F.sum(c).over(so_far) for c in (*counts, *lasting)})
    s = decayed(grid, ["symbol"], list(fading))

    calendar = trading_days(posts.sparkSession, EPOCH + timedelta(int(lo) - SLOW_DAYS), EPOCH + timedelta(int(hi)))
    cal_w = Window.partitionBy(F.lit(0)).orderBy("day")
    calendar = calendar.withColumns({"open_recent": F.col("ordinal") - F.lag("ordinal", FAST_DAYS).over(cal_w), "open_base": F.lag("ordinal", FAST_DAYS).over(cal_w) - F.lag("ordinal", SLOW_DAYS).over(cal_w)})
    s = s.join(F.broadcast(calendar.where("session is not null")), "day")  # 250 rows a year

    n, d = F.col("n"), F.col("d")
    mean = lambda value, weight, plain: F.when(F.col(weight) > NO_WEIGHT, F.col(value) / F.col(weight)).otherwise(F.col(plain) / n)
    raw, ratio = mean("dp", "d", "p"), F.try_divide("up", "down")
    rate = lambda count, days: F.col(count) / F.greatest(F.lit(1), F.col(days))
    growth = (rate("recent", "open_recent") + PRIOR) / (rate("base", "open_base") + PRIOR) - 1
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("dpp") / d - F.pow(F.col("dp") / d, 2)))
    part = lambda name: F.when(F.col(f"d_{name}") > 0, F.col(f"dp_{name}") / F.col(f"d_{name}")).otherwise(0.0)
    return s.select(
        "symbol", "session", n.cast("long").alias("post_count"), F.col("authors").cast("long").alias("authors"), (F.col("all") - n).cast("long").alias("later"), raw.alias("raw"), mean("ep", "e", "p").alias("engagement_weighted"), mean("cp", "c", "p").alias("credibility_weighted"),
        (F.col("shift") / F.col("voices")).alias("unique_author"), F.when((n < 2) | (d <= NO_WEIGHT), 0.0).otherwise(spread).alias("dispersion"), (part("fast") - part("slow")).alias("acceleration"),
        F.when(F.col("recent") + F.col("base") < LEAST_MENTIONS, 0.0).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(-10.0), growth))).alias("mention_growth"), F.when(F.col("down") > 1e-9, ratio).when(F.col("up") <= 1e-9, 1.0).otherwise(10.0).alias("bull_bear"),
        (F.col("day") * 24.0 - mean("db", "d", "b")).alias("age_hours"), F.col("engagement").alias("total_engagement"), (F.col("squares") / (n * n)).alias("author_concentration"), *(mean(f"d_{k}", "d", f"n_{k}").alias(k) for k in MEANS),
    )
