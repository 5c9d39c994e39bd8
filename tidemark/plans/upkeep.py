"""Upkeep of stored data: snapshots as payloads, tables in versions, fetch health, the cache of model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import fetch_health, institutional, model_cache
from tidemark.registry import query
from tidemark.sources.adapters import POSTS, posts, table
from tidemark.sources.store import fresh_dir
from tidemark.sources.versions import VersionedTable

NOW = "2024-02-01 00:00:00"


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, session, payload: a supplier's lines of a quarter as a snapshot, some elements and some payloads broken."""
    line = table(spark, sf, "lineitem")
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    month = F.when(k % 7 == 0, F.lit("soon")).otherwise(F.month("l_shipdate").cast("string"))
    element = F.when(k % 11 == 0, F.lit('"none"')).otherwise(F.concat(F.lit('{"month": '), F.when(k % 5 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), month, F.lit('"'))), F.lit(', "year": '), F.year("l_shipdate").cast("string"), F.lit(', "trans_buy_amount": '), F.floor("l_extendedprice").cast("string"), F.lit(', "insiders_buy_count": '), n.cast("string"), F.lit("}")))
    held = F.concat(F.lit('{"date": "'), F.when(k % 6 == 0, F.lit("2020-13-01")).otherwise(F.to_date("l_shipdate").cast("string")), F.lit('", "holding_amount": '), F.floor("l_quantity").cast("string"), F.when(k % 4 == 0, F.lit(', "is_complete": true}')).otherwise(F.lit("}")))
    group = line.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.last_day(F.to_date(F.trunc("l_shipdate", "quarter"))).alias("session"), F.struct("l_orderkey", "l_linenumber", "l_partkey", element.alias("e"), held.alias("h")).alias("x"))
    lists = group.groupBy("symbol", "session").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a supplier's lines of a quarter
    joined = lambda f: F.array_join(F.transform("x", lambda s: s[f]), ", ")
    whole = F.concat(F.lit('{"insider_monthly": ['), joined("e"), F.lit('], "hedge_fund_holdings_by_quarter": ['), joined("h"), F.lit('], "num_of_insiders": "'), F.size("x").cast("string"), F.lit('", "notable_holder_moves": 7, "market_cap_usd": 1e9}'))
    broken = F.crc32(F.concat("symbol", F.col("session").cast("string"))) % 9
    return lists.select("symbol", "session", F.when(broken == 0, F.lit("[1, 2]")).when(broken == 1, F.substring(whole, 1, 40)).otherwise(whole).alias("payload"))


@query("institutional_payloads")
def institutional_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """What can be read of each snapshot, and whether it survives being written and read again."""
    first = institutional.read(payloads(spark, sf))
    again = institutional.read(institutional.write(first)).select("symbol", "session", F.xxhash64(*institutional.LISTS, *institutional.NUMBERS).alias("again"))
    months, quarters = F.col("insider_monthly"), F.col("hedge_fund_holdings_by_quarter")
    total = lambda x, f: F.aggregate(x, F.lit(0.0), lambda a, e: a + F.coalesce(e[f], F.lit(0.0)))
    kept = first.select(
        "symbol", "session", "broken", "num_of_insiders", F.size(months).alias("months"), rounded(total(months, "trans_buy_amount")).alias("bought"), F.size(quarters).alias("quarters"),
        rounded(total(quarters, "holding_amount")).alias("held"), F.size(F.filter(quarters, lambda q: q["is_complete"])).alias("complete"), F.xxhash64(*institutional.LISTS, *institutional.NUMBERS).alias("hash"),
    )
    out = kept.join(again, ["symbol", "session"]).withColumn("same", F.col("hash") == F.col("again")).drop("hash", "again")
    return out.withColumn("session", F.col("session").cast("string"))


@query("versioned_rebuild", f"with {POSTS}, d as (select session, source, count(*) as n from posts group by all) select cast(session as varchar) as session, source, case when session < date '2024-01-11' then n * 2 else n end as n, case when session < date '2024-01-11' then 2 else 1 end as extraction from d")
def versioned_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts of which an older extraction wrote a part: only those days are written anew."""
    p = posts(spark, sf).groupBy("session", "source").agg(F.count("*").alias("n"))
    t = VersionedTable(spark, fresh_dir(spark, "daily"), "session")
    t.write(p.where("session >= date'2024-01-11'").withColumn("extraction", F.lit(1)), 2)
    t.write(p.where("session < date'2024-01-11'").withColumn("extraction", F.lit(1)), 1)
    double = lambda parts: p.join(parts, F.col("session").cast("string") == F.col("part"), "left_semi").select("session", "source", (F.col("n") * 2).alias("n"), F.lit(2).alias("extraction"))
    t.rebuild(2, double)
    return t.read().select(F.col("session").cast("string").alias("session"), "source", "n", "extraction")


def fetch_log(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, refresh_id, at, ok, outage: an attempt for each event, some sources down for all."""
    e = posts(spark, sf)
    k = F.col("post_id")
    return e.select("symbol", k.alias("refresh_id"), F.col("created_at").alias("at"), ((k * 17) % 10 < F.crc32("symbol") % 8).alias("ok"), (F.dayofmonth("created_at") % 10 == 3).alias("outage"))


@query("fetch_quarantine")
def fetch_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Each symbol's health at the end of the log."""
    h = fetch_health.health(fetch_log(spark, sf))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return h.select("symbol", "attempts", "skipped", "failures", stamp("last_failure_at"), stamp("until"))


@query("fetch_health_report")
def fetch_health_report(spark: SparkSession, sf: str) -> DataFrame:
    r = fetch_health.report(fetch_health.health(fetch_log(spark, sf)), F.lit(NOW).cast("timestamp"))
    return r.withColumn("last_failure_at", F.date_format("last_failure_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_KEY = "sha256(concat_ws('|', 'task=9:sentiment', 'prompt_version=2:v2', 'model=5:local', concat('source=', coalesce(concat(length(source), ':', source), '-')), concat('symbol=', coalesce(concat(length(symbol), ':', symbol), '-'))))"
_CACHE = f"""with {POSTS}, r as (select post_id, {_KEY} as key from posts),
c as (select key, min(post_id) as k from r group by key having min(post_id) % 5 <> 0),
a as (select key, k, case when k % 7 = 0 then 'no json' when k % 7 = 1 then 'label' when k % 7 = 2 then 'range' else 'good' end as kind, case when k % 3 = 0 then null else timestamp '2024-01-20' + interval 1 day * (k % 30) end as expires from c)
select post_id, case when a.key is null then 'miss' when expires is not null and expires <= timestamp '{NOW}' then 'expired' when kind <> 'good' then 'malformed' else 'hit' end as status,
case when a.key is not null and (expires is null or expires > timestamp '{NOW}') and kind = 'good' then ['bullish', 'bearish', 'neutral'][k % 3 + 1] end as label from r left join a using (key)"""


@query("model_cache", _CACHE)
def model_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Which requests a cache of answers serves. The answers stand in for a model's."""
    p = posts(spark, sf)
    lit = F.lit
    r = p.select("post_id", model_cache.key(lit("sentiment"), lit("v2"), lit("local"), {"symbol": F.col("symbol"), "source": F.col("source")}).alias("key"))
    k = F.col("k")
    label = F.element_at(F.array(*(lit(x) for x in model_cache.LABELS)), (k % 3 + 1).cast("int"))
    good = F.to_json(F.struct(F.when(k % 7 == 1, "sideways").otherwise(label).alias("label"), F.when(k % 7 == 2, 1.5).otherwise(0.5).alias("confidence")))
    expires = F.when(k % 3 != 0, F.lit("2024-01-20").cast("timestamp") + F.make_dt_interval(days=(k % 30).cast("int")))
    cache = r.groupBy("key").agg(F.min("post_id").alias("k")).where("k % 5 <> 0").select("key", F.when(k % 7 == 0, "no json").otherwise(good).alias("answer"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), expires.alias("expires_at"))
    return model_cache.get(r, cache, F.lit(NOW).cast("timestamp")).select("post_id", "status", F.col("served.label").alias("label"))
