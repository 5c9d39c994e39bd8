"""Keyed streams against their batch form, cut into batches and stopped in between."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.sources.adapters import arrivals, outcomes
from tidemark.streaming import state


def replay(spark, rows, make, tmp_path, parts):
    """rows written in parts in order of arrival; a run of the stream after each part, from the same checkpoint."""
    rows = rows.withColumn("part", F.ntile(parts).over(Window.orderBy("arrival"))).cache()
    runs = []
    for k in range(1, parts + 1):
        rows.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = state.keep(make(source), f"{tmp_path}/out", f"{tmp_path}/check")
        query.awaitTermination(180)
        runs.append(query)
    return runs, spark.read.parquet(f"{tmp_path}/out")


def test_rates_equal_batch_over_restarts(spark, sf, tmp_path):
    posts = arrivals(spark, sf).select("post_id", "author", "created_at", "session", "arrival")
    runs, out = replay(spark, posts, lambda s: state.rates(s, horizon="10 days"), tmp_path, 3)
    got = {(r["author"], r["session"]): (r["posts"], r["late"]) for r in state.newest(out, "author", "session").collect()}
    want = {(r["author"], r["session"]): (r["posts"], r["late"]) for r in state.rates_of(posts).collect()}
    assert sum(map(state.dropped, runs)) == 0
    assert got == want and sum(late for _, late in want.values()) > 5
    assert out.where("closed").count() > 0 and out.where("not closed").count() > len(want)


def test_closed_days_free_their_state(spark, tmp_path):
    """A day is closed once; what comes after its horizon is dropped and counted by Spark."""
    rows = [(1, 7, "2024-01-01 10:00:00", 1), (2, 7, "2024-01-01 12:00:00", 2), (3, 7, "2024-01-01 01:00:00", 3), (4, 7, "2024-01-20 10:00:00", 4), (5, 8, "2024-01-21 10:00:00", 5), (6, 7, "2024-01-01 13:00:00", 6)]
    d = spark.createDataFrame(rows, "post_id long, author long, created_at string, arrival long").withColumn("created_at", F.to_timestamp("created_at")).withColumn("session", F.to_date("created_at"))
    runs, out = replay(spark, d, lambda s: state.rates(s, horizon="48 hours"), tmp_path, 6)
    last = {(r["author"], str(r["session"])): (r["posts"], r["late"], r["closed"]) for r in state.newest(out, "author", "session").collect()}
    assert last[7, "2024-01-01"] == (2, 1, True) and last[7, "2024-01-20"] == (1, 0, False)
    assert out.where("closed").count() == 1 and sum(map(state.dropped, runs)) == 1


@pytest.mark.parametrize("kept", [False, True])
def test_coverage_equals_batch_over_restarts(spark, sf, tmp_path, kept):
    rows = outcomes(spark, sf)
    old, new = rows.where("arrival < 200"), rows.where("arrival >= 200")
    stored = state.coverage_of(old).withColumn("change", F.lit(0).cast("long"))if kept else None
    _, out = replay(spark, new if kept else rows, lambda s: state.coverage(s, stored), tmp_path, 3)
    columns = ["session", "source", "status", "error", "posts", "first_at"]
    touched = new.select("session", "source").distinct()
    want = state.coverage_of(rows)
    want = want.join(touched, ["session", "source"]) if kept else want
    got = sorted(tuple(r) for r in state.newest(out, "session", "source").select(columns).collect())
    assert [str(x) for x in got] == [str(x) for x in sorted(tuple(r) for r in want.select(columns).collect())]
    assert {r[2] for r in got} == {"ok", "failed"}
