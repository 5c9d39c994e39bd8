"""The scan: features, six strategies, funnel, ranked signals; snapshots of analysts and institutions; research overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import relations as rel
from tidemark.operators import snapshots as snap
from tidemark.operators import strategies as st
from tidemark.plans.market import _full
from tidemark.registry import query
from tidemark.sources.adapters import BARS, EARNINGS, POSTS, SHIFT, TRADES, bars, earnings, posts, table, trades


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    mood = posts(spark, sf).groupBy("symbol", F.date_sub("session", SHIFT).alias("session")).agg(F.avg("polarity").alias("mood"), F.count("*").alias("mentions"))
    e = earnings(spark, sf).where("confirmed").groupBy("symbol", F.col("report_date").alias("session")).agg(F.max("surprise_pct").alias("surprise"))
    known = rel.backward_asof(b.select("symbol", "session"), e, ["surprise"], keep_key="report")
    return st.features(b, mood, known.withColumn("days_since", F.datediff("session", "report")))


_WIN = "window s as (partition by symbol order by session), w20 as (partition by symbol order by session rows between 19 preceding and current row), w50 as (partition by symbol order by session rows between 49 preceding and current row), p20 as (partition by symbol order by session rows between 20 preceding and 1 preceding)"
_FEATURES = f"""with {BARS}, {POSTS}, {EARNINGS},
mood as (select symbol, session - {SHIFT} as session, avg(polarity) as mood, count(*) as mentions from posts group by all),
rep as (select symbol, report_date as report, max(surprise_pct) as surprise from earnings where confirmed group by all),
f0 as (select *, {_full('avg', 'close', 'w20', 20)} as ma20, {_full('avg', 'close', 'w50', 50)} as ma50, (close / nullif(lag(close, 20) over s, 0) - 1) * 100 as roc20,
  volume / nullif({_full('avg', 'volume', 'p20', 20)}, 0) as rel_volume, {_full('max', 'high', 'p20', 20)} as level, {_full('max', 'high', 'w20', 20)} as high20,
  lag(close) over s as prev_close, close / nullif(lag(close) over s, 0) as r from bars {_WIN}),
f1 as (select *, lag(level) over s as prev_level, {_full('stddev_samp', 'r', 'w20', 20)} as vol20 from f0 {_WIN}),
f2 as (select f1.*, mood, mentions from f1 left join mood m on m.symbol = f1.symbol and m.session = f1.session),
f as (select f2.*, surprise, report, f2.session - report as days_since from f2 asof left join rep on rep.symbol = f2.symbol and rep.report <= f2.session)"""
_EVAL = _FEATURES + ", ev as (" + " union all ".join(f"select symbol, session, close, '{n}' as strategy, '{s.direction}' as direction, {st.decline_sql(s)} as decline, {st.score_sql(s)} as score, {s.stop} as stop, {s.target} as target from f" for n, s in st.REGISTRY.items()) + ")"


@query("strategy_funnel", f"{_EVAL} select strategy, coalesce(decline, case when score < {st.THRESHOLD} then 'low_score' else 'proposed' end) as reason, count(*) as n from ev group by all")
def strategy_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """How many (symbol, session) pairs each strategy drops for each reason."""
    reason = F.coalesce("decline", F.when(F.col("score") < st.THRESHOLD, "low_score").otherwise("proposed"))
    return st.evaluate(feature_rows(spark, sf)).groupBy("strategy", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("strategy_signals", f"{_EVAL}, p as (select strategy, symbol, session, round_even(score + 3e-8, 4) as score from ev where decline is null and score >= {st.THRESHOLD}), r as (select *, row_number() over (partition by session order by score desc, strategy, symbol) as rank from p) select strategy, symbol, cast(session as varchar) as session, score, rank from r where rank <= 40")
def strategy_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of each session, best first, at most 40 (the scan's candidate limit)."""
    p = st.evaluate(feature_rows(spark, sf)).where(F.col("decline").isNull() & (F.col("score") >= st.THRESHOLD)).select("strategy", "symbol", "session", F.bround(F.col("score") + 3e-8, 4).alias("score"))
    r = p.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "strategy", "symbol"))).where("rank <= 40")
    return r.withColumn("session", F.col("session").cast("string"))


@query("proposal_validation", f"{_EVAL}, v as (select strategy, case when direction = 'long' and stop >= close then 'stop_above' when direction = 'long' and target <= close then 'target_below' when direction = 'short' and stop <= close then 'stop_below' when direction = 'short' and target >= close then 'target_above' end as fault from ev where decline is null) select strategy, coalesce(fault, 'valid') as fault, count(*) as n from v group by all")
def proposal_validation(spark: SparkSession, sf: str) -> DataFrame:
    v = st.evaluate(feature_rows(spark, sf)).where("decline is null").withColumn("fault", F.coalesce(st.valid_plan(), F.lit("valid")))
    return v.groupBy("strategy", "fault").agg(F.count("*").alias("n"))


_SNAP = """s as (select concat('S', l_suppkey) as symbol, date_trunc('quarter', l_shipdate)::date as quarter, sum(l_extendedprice * (case when l_returnflag = 'R' then -1 else 1 end)) as flow, avg(l_discount) * 10 as confidence,
  sum(l_quantity) as holding, sum(case when l_linestatus = 'O' then l_quantity else -l_quantity end) as change from lineitem group by all)"""


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly holdings of each supplier's symbol, standing in for institutional snapshots."""
    l = table(spark, sf, "lineitem")
    q = F.trunc(F.to_date("l_shipdate"), "quarter").alias("quarter")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return l.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), q).agg(F.sum(F.col("l_extendedprice") * sign).alias("flow"), (F.avg("l_discount") * 10).alias("confidence"), F.sum("l_quantity").alias("holding"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity"))).alias("change"))


@query("institutional_score", f"with {_SNAP}, a as (select symbol, quarter, greatest(-1.0, least(1.0, sign(flow) * ln(1 + abs(flow)) / ln(1 + 1e9))) as fl, greatest(-1.0, least(1.0, 2 * confidence - 1)) as co, greatest(-1.0, least(1.0, change / nullif(holding, 0) * 5)) as hf, date '2001-12-31' - quarter as age from s), b as (select *, 0.65 * greatest(0.0, 1 - age / 900.0) as wi, 0.35 * greatest(0.0, 1 - age / 1820.0) as wf, 0.6 * fl + 0.4 * co as ins from a) select symbol, cast(quarter as varchar) as quarter, round_even((ins * wi + hf * wf) / nullif(wi + wf, 0) + 3e-8, 6) + 0.0 as score from b")
def institutional_score(spark: SparkSession, sf: str) -> DataFrame:
    s = snap.institutional_score(_snapshots(spark, sf), F.lit("2001-12-31").cast("date"))
    return s.select("symbol", F.col("quarter").cast("string").alias("quarter"), rounded("score").alias("score"))


@query("snapshot_delta", f"with {_SNAP}, d as (select *, lag(holding) over (partition by symbol order by quarter) as before, row_number() over (partition by symbol order by quarter desc) as rn from s) select symbol, cast(quarter as varchar) as quarter, holding - before as diff, round_even((holding / nullif(before, 0) - 1) * 100 + 3e-8, 6) + 0.0 as diff_pct from d where rn = 1")
def snapshot_delta(spark: SparkSession, sf: str) -> DataFrame:
    d = snap.latest_delta(_snapshots(spark, sf), ["symbol"], "quarter", "holding")
    return d.select("symbol", F.col("quarter").cast("string").alias("quarter"), "diff", rounded("diff_pct").alias("diff_pct"))


@query("research_overlay", f"with {TRADES}, u as (select trade_id, min(return_pct) as return_pct, min(shares) as shares from trades group by trade_id), n as (select trade_id, least(100.0, greatest(0.0, 50 + return_pct)) as score, ((shares * 7)::bigint % 61) - 30.0 as delta, shares::bigint % 3 as revisions from u), o as (select trade_id, score, case when revisions > 0 then greatest(-20.0, least(20.0, delta)) end as delta from n) select trade_id, round_even(score + 3e-8, 6) as score, round_even(least(100.0, greatest(0.0, score + coalesce(delta, 0) * 0.5)) + 3e-8, 6) as effective from o")
def research_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with the latest research revision's bounded change laid over them."""
    t = trades(spark, sf).groupBy("trade_id").agg(F.min("return_pct").alias("return_pct"), F.min("shares").alias("shares"))
    base = t.select("trade_id", F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 + F.col("return_pct"))).alias("score"))
    count = F.col("shares").cast("long") % 3
    revisions = t.select("trade_id", F.explode(F.when(count > 0, F.sequence(F.lit(1).cast("long"), count))).alias("revision"), ((F.col("shares") * 7).cast("long") % 61 - 30.0).alias("delta"))
    o = snap.overlay(base, revisions, "trade_id", weight=0.5)
    return o.select("trade_id", F.bround(F.col("score") + 3e-8, 6).alias("score"), F.bround(F.col("effective") + 3e-8, 6).alias("effective"))
