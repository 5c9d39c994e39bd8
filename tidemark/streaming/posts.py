"""Micro-batch upkeep of daily sentiment: late posts rewrite only the keys that they touch.

Posts arrive in a landing folder. The stream keeps a watermark of 72 hours, drops repeated keys within it, and for each batch
recomputes the (symbol, session) rows that have a fresh post from all stored posts of those keys. Output folders belong
on storage that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import social

SCHEMA = "post_id long, source string, created_at timestamp, author long, symbol string, engagement double, polarity double"


def landing(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.readStream.schema(SCHEMA).parquet(folder)
    return raw.withWatermark("created_at", "72 hours").dropDuplicatesWithinWatermark(["source", "post_id"]).withColumn("session", F.to_date("created_at"))


def hourly_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy(F.window("created_at", "1 hour"), "symbol").agg(F.count("*").alias("n"), F.sum("engagement").alias("engagement"))


def touched(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """All posts of the keys that have a fresh one: those stored before, and the fresh ones, each once."""
    keys = fresh.select("symbol", "session").distinct()
    old = stored.join(keys, ["symbol", "session"], "left_semi").join(fresh.select("source", "post_id"), ["source", "post_id"], "left_anti")
    return old.unionByName(fresh)


def latest_version(rows: DataFrame) -> DataFrame:
    """The last written row of each key."""
    w = Window.partitionBy("symbol", "session").orderBy(F.desc("version"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def keep_sentiment(posts: DataFrame, store: str, output: str, checkpoint: str) -> StreamingQuery:
    """Runs over what has arrived, then stops. A batch that is run again writes the same version of the same keys."""

    def batch(fresh: DataFrame, version: int) -> None:
        spark = fresh.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        stored = spark.read.parquet(store).where(F.col("version") < version).drop("version") if there else fresh.limit(0)
        rows = social.daily_sentiment(touched(stored, fresh)).withColumn("version", F.lit(version))
        rows.write.mode("overwrite").parquet(f"{output}/version={version}")
        fresh.write.mode("overwrite").parquet(f"{store}/version={version}")

    return posts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
