"""The signal ledger and keyed merges: idempotent appends, revisions, integrity, expiry, pages; upserts of listings, earnings and current bars.

Each is an equality join or one aggregation by the row's key; results are the rows to write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("won", "lost", "expired", "cancelled")


def signal_id(*parts: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def payload_hash(numbers: dict[str, int], texts: tuple[str, ...]) -> Column:
    """A digest over texts and numbers at fixed places."""
    return F.sha2(F.concat_ws("|", *texts, *((F.bround(F.col(c) * 10**d + 3e-4, 0).cast("long").cast("string")) for c, d in numbers.items())), 256)


def append(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh(id, hash) against the ledger: new rows to append, equal ones that change nothing, conflicts that are errors."""
    j = fresh.join(stored.select("id", F.col("hash").alias("stored_hash")), "id", "left")
    return j.withColumn("action", F.when(F.col("stored_hash").isNull(), "append").when(F.col("stored_hash") == F.col("hash"), "same").otherwise("conflict")).drop("stored_hash")


def revise(revisions: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(id, status) as rows with the next revision number of their id."""
    last = revisions.groupBy("id").agg(F.max("revision").alias("last"))
    return changes.join(last, "id", "left").withColumn("revision", F.coalesce("last", F.lit(0)) + 1).drop("last")


def current(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("id").agg(F.max("revision").alias("revision"), F.max_by("status", "revision").alias("status"))


def expired(signals: DataFrame, revisions: DataFrame, at: Column) -> DataFrame:
    """Revision rows that expire signals(id, expires_after) which are not terminal."""
    due = signals.where(F.col("expires_after") < at).select("id")
    open_ = due.join(current(revisions), "id").where(~F.col("status").isin(*TERMINAL))
    return open_.select("id", (F.col("revision") + 1).alias("revision"), F.lit("expired").alias("status"))


def research(prior: DataFrame, fresh: DataFrame, bound: float = 20.0) -> DataFrame:
    """The next research revision: deltas clamped, fields that are left out carried forward."""
    p = prior.select("id", *(F.col(c).alias(f"old_{c}") for c in ("revision", "delta", "note")))
    j = fresh.join(p, "id", "left")
    delta = F.greatest(F.lit(-bound), F.least(F.lit(bound), F.coalesce("delta", "old_delta", F.lit(0.0))))
    return j.select("id", (F.coalesce("old_revision", F.lit(0)) + 1).alias("revision"), delta.alias("delta"), F.coalesce("note", "old_note").alias("note"))


def merge_current_bar(stored: DataFrame, quote: DataFrame) -> DataFrame:
    """stored with the quotes of sessions that it lacks; a bar that is there is never overwritten. Of several quotes of a session the
    one with the greatest close counts (they differ only if a source repeats itself)."""
    columns = ("open", "high", "low", "close", "volume")
    one = quote.groupBy("symbol", "session").agg(F.max_by(F.struct(*columns), "close").alias("x")).select("symbol", "session", "x.*")
    fresh = one.join(stored.select("symbol", "session"), ["symbol", "session"], "left_anti")
    kept = stored.select("symbol", "session", *columns, F.lit(False).alias("inserted"))
    return kept.unionByName(fresh.withColumn("inserted", F.lit(True)))


def upsert_securities(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Listings by symbol: fresh values win where given, known ones stay; a changed name is kept as an alias."""
    s = stored.select("symbol", *(F.col(c).alias(f"s_{c}") for c in ("name", "sector", "market_cap_usd")))
    j = fresh.join(s, "symbol", "full")
    alias = F.when(F.col("name").isNotNull() & F.col("s_name").isNotNull() & (F.lower("name") != F.lower("s_name")), F.col("s_name"))
    action = F.when(F.col("s_name").isNull(), "insert").when(F.col("name").isNull(), "keep").otherwise("update")
    return j.select("symbol", F.coalesce("name", "s_name").alias("name"), F.coalesce("sector", "s_sector").alias("sector"), F.coalesce("market_cap_usd", "s_market_cap_usd").alias("market_cap_usd"), alias.alias("alias"), action.alias("action"))


def upsert_earnings(events: DataFrame) -> DataFrame:
    """One row a symbol and report date: the newest knowledge, confirmed once any row is."""
    return events.groupBy("symbol", "report_date").agg(F.max("as_of").alias("as_of"), F.bool_or("confirmed").alias("confirmed"), F.max_by("surprise_pct", F.struct("as_of", "event_id")).alias("surprise_pct"))


def page(rows: DataFrame, least: float, size: int) -> DataFrame:
    """The first page by score, newest first among equals, with the number of all that qualify."""
    q = rows.where(F.col("score") >= least)
    top = q.orderBy(F.desc("score"), F.desc("created"), "id").limit(size)
    return top.crossJoin(F.broadcast(q.agg(F.count("*").alias("total"))))  # one row
