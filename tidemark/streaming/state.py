"""Keyed state over streams: posting rates with late posts counted, and collection coverage that stays good.

Both give the same rows as their batch form however the stream is cut into batches and wherever it is stopped and started
again: what counts as late depends on a key's own earlier arrivals, not on a batch's clock.

* `rates`: a post is late when it is older than the newest earlier arrival of its author by more than `lateness`. It is dropped and
  counted. A day's row is written again whenever it changes; an event-time timer closes the day and frees its state once
  the watermark, `horizon` behind the newest post of all, has passed it. Spark itself drops (and counts, see `dropped`) what is older than that.
* `coverage`: a session and source that was collected once stays `ok`; the number of posts is the largest seen, never a sum.
  Stored coverage is the state to start from.

State lives in RocksDB on the executors and in the checkpoint folder, which all executors must share.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RATES = "author long, session date, posts long, late long, closed boolean, change long"
COVERAGE = "session date, source string, status string, error string, posts long, first_us long, change long"
OK, FAILED = "ok", "failed"


class Rates(StatefulProcessor):
    """One author: the newest arrival so far, and posts, late posts and changes of each open day."""

    def __init__(self, lateness_ms: int):
        self.lateness = lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ms long")
        self.days = handle.getMapState("days", "session date", "posts long, late long, change long, until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        seen: dict = {}
        for _, _, ms, session, until in sorted((r["arrival"], r["post_id"], r["ms"], r["session"], r["until"]) for r in rows):
            counts = seen.setdefault(session, [0, 0, until])
            counts[newest is not None and ms < newest - self.lateness] += 1
            newest = ms if newest is None else max(newest, ms)
        if newest is not None:
            self.newest.update((newest,))
        for session, (fresh, late, until) in seen.items():
            old = self.days.getValue((session,)) if self.days.containsKey((session,)) else None
            if old is None:
                self.handle.registerTimer(until)
            row = (fresh + (old[0] if old else 0), late + (old[1] if old else 0), 1 + (old[2] if old else 0), until)
            self.days.updateValue((session,), row)
            yield Row(author=key[0], session=session, posts=row[0], late=row[1], closed=False, change=row[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        for session, row in [(k[0], v) for k, v in self.days.iterator() if v[3] <= passed]:
            self.days.removeKey((session,))
            yield Row(author=key[0], session=session, posts=row[0], late=row[1], closed=True, change=row[2] + 1)

    def close(self) -> None:
        pass


class Coverage(StatefulProcessor):
    """One session and source: what is known about its collection."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "status string, error string, posts long, first_us long, change long")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.known.update((initialState["status"], initialState["error"], initialState["posts"], initialState["first_us"], initialState["change"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self.known.get() if self.known.exists() else None
        for r in sorted(rows, key=lambda r: r["arrival"]):
            kept = r["ok"] or (now is not None and now[0] == OK)
            now = (OK if kept else FAILED, r["error"], max(r["posts"] or 0, now[2] if now else 0), min(r["us"], now[3]) if now else r["us"], (now[4] if now else 0) + 1)
        if now is not None:
            self.known.update(tuple(now))
            yield Row(session=key[0], source=key[1], status=now[0], error=now[1], posts=now[2], first_us=now[3], change=now[4])

    def close(self) -> None:
        pass


def _keyed(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def rates(posts: DataFrame, lateness: str = "6 hours", horizon: str = "72 hours") -> DataFrame:
    """Rows of RATES, one for each change of an author's day, for a stream of posts(post_id, author, created_at, session, arrival)."""
    _keyed(posts.sparkSession)
    spark = posts.sparkSession
    late = spark.range(1).select(F.expr(f"unix_millis(timestamp'1970-01-02 00:00:00' + interval {lateness}) - unix_millis(timestamp'1970-01-02 00:00:00')")).first()[0]
    until = F.unix_millis(F.date_add("session", 1).cast("timestamp"))
    rows = posts.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", horizon).select("author", "post_id", "arrival", "created_at", F.unix_millis("created_at").alias("ms"), "session", until.alias("until"))
    return rows.groupBy("author").transformWithState(Rates(late), RATES, "Update", "EventTime")


def coverage(outcomes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows of COVERAGE (its time as first_at), one for each change, for a stream of outcomes(session, source, arrival, at, ok, error, posts) on top of stored rows."""
    _keyed(outcomes.sparkSession)
    first = stored.withColumn("first_us", F.unix_micros("first_at")).drop("first_at").groupBy("session", "source") if stored is not None else None
    rows = outcomes.withColumn("us", F.unix_micros(F.col("at").cast("timestamp"))).drop("at")
    changes = rows.groupBy("session", "source").transformWithState(Coverage(), COVERAGE, "Update", "None", first)
    return changes.withColumn("first_at", F.timestamp_micros("first_us")).drop("first_us")


def rates_of(posts: DataFrame, lateness: str = "6 hours") -> DataFrame:
    """The batch form: author, session, posts and late posts."""
    w = Window.partitionBy("author").orderBy("arrival", "post_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = posts.withColumn("newest", F.max("created_at").over(w))
    late = F.coalesce(F.col("created_at") < F.col("newest") - F.expr(f"interval {lateness}"), F.lit(False))
    return seen.groupBy("author", "session").agg(F.count_if(~late).alias("posts"), F.count_if(late).alias("late"))


def coverage_of(outcomes: DataFrame) -> DataFrame:
    """The batch form, summed up in each task first."""
    return outcomes.groupBy("session", "source").agg(
        F.when(F.bool_or("ok"), OK).otherwise(FAILED).alias("status"), F.max_by("error", "arrival").alias("error"),
        F.max(F.coalesce("posts", F.lit(0))).alias("posts"), F.min(F.col("at").cast("timestamp")).alias("first_at"),
    )


def newest(rows: DataFrame, *key: str) -> DataFrame:
    """Of the rows that a stream wrote for a key the last one."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), "change").alias("x")).select(*key, "x.*")


def keep(changes: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Writes the changes of what has arrived, a folder a batch, so that a batch that runs again overwrites itself; then stops."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped(query: StreamingQuery) -> int:
    """Posts that Spark itself dropped in this run, being older than the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
