"""A keyed store of model answers with expiry: content keys, look-ups and merges as joins, answers checked against a schema.

No model is called here: a look-up tells which requests need one. Two requests with the same content share one key, however
their payload's fields are ordered. Defined results: an answer that isn't an object of the schema's types within their ranges, or
names no label, is malformed and never served; null expiry never expires; of several stored rows of a key the newest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("bullish", "bearish", "neutral")
ANSWER = "struct<label:string,confidence:double,evidence:array<string>>"


def key(task: Column, version: Column, model: Column, payload: dict[str, Column]) -> Column:
    """SHA-256 over the request in one stable form: fields by name, each with its length, so that no two requests run together."""
    parts = [("task", task), ("prompt_version", version), ("model", model), *sorted(payload.items())]
    texts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for _, c in parts]
    return F.sha2(F.concat_ws("|", *(F.concat(F.lit(f"{name}="), t) for (name, _), t in zip(parts, texts, strict=True))), 256)


def checked(answer: Column) -> Column:
    """The answer as a struct, or null where it breaks the schema."""
    v = F.from_json(answer, ANSWER)
    good = v["label"].isin(*LABELS) & v["confidence"].between(0.0, 1.0)
    return F.when(F.coalesce(good, F.lit(False)), v)


def get(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """requests(key, ...) with status `hit`, `expired`, `malformed` or `miss`, and the answer of a hit."""
    newest = cache.groupBy("key").agg(F.max_by(F.struct("answer", "expires_at"), "created_at").alias("c"))
    j = requests.join(newest, "key", "left")
    value = checked(F.col("c.answer"))
    live = F.col("c.expires_at").isNull() | (F.col("c.expires_at") > now)
    status = F.when(F.col("c").isNull(), "miss").when(~live, "expired").when(value.isNull(), "malformed").otherwise("hit")
    return j.withColumn("status", status).withColumn("served", F.when(status == "hit", value)).drop("c")


def put(cache: DataFrame, answers: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The cache with the well-formed of answers(key, answer), which replace what their keys had; an answer of several of a key is the greatest text."""
    good = answers.where(checked(F.col("answer")).isNotNull()).groupBy("key").agg(F.max("answer").alias("answer"))
    fresh = good.select("key", "answer", now.alias("created_at"), (now + F.make_interval(hours=F.lit(hours))).alias("expires_at"), F.lit(0).cast("long").alias("hits"))
    return cache.join(fresh.select("key"), "key", "left_anti").select(*fresh.columns).unionByName(fresh)


def counted(cache: DataFrame, looked_up: DataFrame) -> DataFrame:
    """The cache with the hits of a look-up added; hits are summed up by key before they are sent."""
    hits = looked_up.where("status = 'hit'").groupBy("key").agg(F.count("*").alias("more"))
    return cache.join(hits, "key", "left").withColumn("hits", F.col("hits") + F.coalesce("more", F.lit(0))).drop("more")


def purge(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
