"""Scans and sinks of outside files with fixed schemas: CSV bars and earnings, grouped-daily JSON, RSS, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import export_safe

#: Names under which files give the session date, and the date formats read.
DATE_NAMES = ("session", "date", "timestamp", "datetime", "time")
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "dd-MMM-yyyy")
SESSIONS = {"bmo": "bmo", "before": "bmo", "pre": "bmo", "amc": "amc", "after": "amc", "post": "amc", "during": "during"}


def csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of CSV files with headers in any case; without a symbol column the file's name is the symbol. Rows that don't
    parse, or with a price of 0 or less, are left out; prices are rounded to 4 places."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = {c.lower().strip(): c for c in raw.columns}
    day = next(names[n] for n in DATE_NAMES if n in names)
    symbol = F.upper(F.trim(F.col(names["symbol"]))) if "symbol" in names else F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))
    price = {c: F.bround(F.col(names[c]).try_cast("double"), 4).alias(c) for c in ("open", "high", "low", "close")}
    session = F.coalesce(*(F.try_to_date(F.trim(F.col(day)), f) for f in DATE_FORMATS)).alias("session")
    rows = raw.select(symbol.alias("symbol"), session, *price.values(), F.col(names["volume"]).try_cast("double").alias("volume"))
    return rows.where("session is not null and least(open, high, low, close) > 0 and volume >= 0")


def csv_earnings(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    kinds = F.create_map(*(F.lit(x) for kv in SESSIONS.items() for x in kv))
    kind = F.coalesce(F.try_element_at(kinds, F.lower(F.trim("session"))), F.lit("unknown"))
    return raw.select(F.upper(F.trim("symbol")).alias("symbol"), F.try_to_date("report_date").alias("report_date"), kind.alias("session")).where("report_date is not null")


def grouped_daily(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a day with all symbols; rows with a null price are left out, dots in symbols become dashes."""
    # T and t differ in case only, which structs don't tell apart: maps do
    d = spark.read.schema("results array<map<string,string>>").option("multiLine", True).json(path).select(F.explode("results").alias("r"))

    def number(key: str, kind: str = "double"):
        return F.try_element_at("r", F.lit(key)).try_cast(kind)

    rows = d.select(F.regexp_replace(F.try_element_at("r", F.lit("T")), r"\.", "-").alias("symbol"), F.to_date(F.timestamp_millis(number("t", "long"))).alias("session"), *(number(k).alias(n) for k, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))))
    return rows.where("open is not null and high is not null and low is not null and close is not null")


def history_json(spark: SparkSession, path: str) -> DataFrame:
    """Chart arrays (timestamps beside columns of prices) as rows."""
    schema = "symbol string, timestamp array<long>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    z = d.select("symbol", F.explode(F.arrays_zip("timestamp", "open", "high", "low", "close", "volume")).alias("x")).select("symbol", "x.*")
    return z.where("close is not null").select("symbol", F.to_date(F.timestamp_seconds("timestamp")).alias("session"), "open", "high", "low", "close", "volume")


def trending_json(spark: SparkSession, path: str) -> DataFrame:
    """Numbers may come as strings; what doesn't parse is null."""
    d = spark.read.schema("results array<struct<ticker:string,mentions:string,upvotes:string,rank:string>>").option("multiLine", True).json(path)
    return d.select(F.explode("results").alias("r")).select(F.upper("r.ticker").alias("symbol"), *(F.col(f"r.{c}").try_cast("long").alias(c) for c in ("rank", "mentions", "upvotes")))


def rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files, one for each link."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    return items.where("link is not null").dropDuplicates(["link"])


def write_export(rows: DataFrame, path: str) -> None:
    """CSV for spreadsheets: text cells can't act as formulas."""
    safe = [export_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*safe).write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def fallback(tiers: list[DataFrame], key: str = "symbol") -> DataFrame:
    """Rows of each source for the keys that no earlier source has."""
    out = tiers[0]
    for tier in tiers[1:]:
        out = out.unionByName(tier.join(out.select(key).distinct(), key, "left_anti"))
    return out
