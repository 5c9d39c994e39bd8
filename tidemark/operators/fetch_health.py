"""Fetch health over a log of outcomes: runs of failures, quarantine that expires, and a report.

A symbol that fails `limit` refreshes in a row is left out for `days`; attempts logged in that time were not made and count for
nothing. Once it expires the next refresh tries again: success clears the symbol, failure quarantines it anew. An outage
of a whole source counts for nobody.

The order of a symbol's outcomes matters, so each symbol's log runs through one task in order, streamed and never held; a symbol
has a row a refresh. Defined results: null symbols form a symbol of their own; equal times go by refresh_id; an empty log has no symbols.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, DAYS = 3, 7
SCHEMA = "symbol string, attempts long, skipped long, failures long, last_failure_at timestamp, until timestamp"


def health(log: DataFrame, limit: int = LIMIT, days: int = DAYS) -> DataFrame:
    """One row a symbol of log(symbol, refresh_id, at, ok, outage): attempts made and skipped, failures in a row at the end, the last of
    them, and until when the symbol is quarantined (null: never, or cleared)."""
    span = dt.timedelta(days=days) // dt.timedelta(microseconds=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        done: list[list] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            stamp = lambda x: pa.array(x, pa.int64()).cast(pa.timestamp("us", "UTC"))
            return pa.record_batch([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:4]), stamp(columns[4]), stamp(columns[5])], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for symbol, at, ok, outage in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if now is None or now[0] != symbol:
                    if now is not None:
                        done.append(now)
                    now = [symbol, 0, 0, 0, None, None]
                if now[5] is not None and at < now[5]:
                    now[2] += 1
                    continue
                now[1] += 1
                if ok:
                    now[3:] = [0, None, None]
                elif not outage:
                    now[3], now[4] = now[3] + 1, at
                    if now[3] >= limit:
                        now[5] = at + span
            if len(done) > 5000:
                yield flush()
                done = []
        if now is not None:
            done.append(now)
        if done:
            yield flush()

    rows = log.select("symbol", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("outage", F.lit(False)).alias("outage"), "refresh_id")
    ordered = rows.repartition("symbol").sortWithinPartitions("symbol", "at", "refresh_id").select("symbol", "at", "ok", "outage")
    return ordered.mapInArrow(run, SCHEMA)


def quarantined(found: DataFrame, now: Column) -> DataFrame:
    return found.where(F.col("until") > now).select("symbol", "until")


def report(found: DataFrame, now: Column) -> DataFrame:
    """Symbols by state: `quarantined`, `failing`, `expired` (quarantine over, not tried since), `healthy`."""
    state = F.when(F.col("until") > now, "quarantined").when(F.col("until").isNotNull(), "expired").when(F.col("failures") > 0, "failing").otherwise("healthy")
    return found.groupBy(state.alias("state")).agg(F.count("*").alias("symbols"), F.sum("failures").alias("failures"), F.sum("skipped").alias("skipped"), F.max("last_failure_at").alias("last_failure_at"))
