"""Snapshots of analysts and institutions: payload parsing, deltas, staleness-weighted score, research overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANALYST = "struct<overview:struct<consensusOverTime:array<struct<date:string,buy:int,hold:int,sell:int,consensus:int,priceTarget:double>>,experts:array<struct<name:string,firm:string,ratings:array<struct<date:string,ratingId:int,priceTarget:string>>>>>>"


def parse_analyst(rows: DataFrame, payload: str) -> DataFrame:
    """Consensus series sorted by date, and rating actions newest first; numbers that don't parse are null."""
    p = rows.withColumn("p", F.from_json(payload, ANALYST))
    actions = F.flatten(F.transform("p.overview.experts", lambda e: F.transform(e["ratings"], lambda r: F.struct(F.try_to_date(r["date"]).alias("date"), e["firm"].alias("firm"), e["name"].alias("analyst"), r["ratingId"].alias("rating"), r["priceTarget"].try_cast("double").alias("price_target")))))
    return p.withColumn("consensus", F.array_sort("p.overview.consensusOverTime")).withColumn("actions", F.reverse(F.array_sort(F.filter(actions, lambda a: a["date"].isNotNull())))).drop("p")


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def institutional_score(snapshots: DataFrame, as_of: Column, cap: float = 1e9, gain: float = 5.0, insider: tuple[float, float] = (0.65, 900.0), fund: tuple[float, float] = (0.35, 1820.0)) -> DataFrame:
    """Blend of insider flow with confidence, and of fund flow; weights fade with age and missing parts give theirs away."""
    flow = _unit(F.signum("flow") * F.log1p(F.abs("flow")) / F.log1p(F.lit(cap)))
    own = flow * 0.6 + _unit(2 * F.col("confidence") - 1) * 0.4
    funds = _unit(F.try_divide("change", "holding") * gain)
    age = F.datediff(as_of, "quarter")

    def fresh(x: Column, rule: tuple[float, float]) -> Column:
        return F.when(x.isNotNull(), rule[0] * F.greatest(F.lit(0.0), 1 - age / rule[1])).otherwise(0.0)

    a, b = fresh(own, insider), fresh(funds, fund)
    return snapshots.withColumn("score", F.try_divide(F.coalesce(own, F.lit(0.0)) * a + F.coalesce(funds, F.lit(0.0)) * b, a + b))


def latest_delta(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The newest row of each key with its change against the one before."""
    w = Window.partitionBy(*key)
    before = F.lag(value).over(w.orderBy(order))
    d = rows.withColumn("diff", F.col(value) - before).withColumn("diff_pct", (F.try_divide(F.col(value), before) - 1) * 100)
    return d.withColumn("rn", F.row_number().over(w.orderBy(F.desc(order)))).where("rn = 1").drop("rn")


def overlay(scores: DataFrame, revisions: DataFrame, key: str, weight: float, bound: float = 20.0) -> DataFrame:
    last = revisions.groupBy(key).agg(F.max_by("delta", "revision").alias("delta"))
    shift = F.greatest(F.lit(-bound), F.least(F.lit(bound), F.coalesce("delta", F.lit(0.0)))) * weight
    return scores.join(last, key, "left").withColumn("effective", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("score") + shift)))
