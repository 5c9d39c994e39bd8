"""Queries over texts: hashes, sanitising, exports, names, lexicon, tickers, calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.calendar import SESSIONS_SQL, sessions
from tidemark.functions.columns import rounded
from tidemark.registry import query
from tidemark.sources.adapters import BARS, bars, table

_SQUEEZE = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query("text_hash_dupes", f"with h as (select doc_id, sha256(lower({_SQUEEZE})) as h from documents) select min(doc_id) as first_doc, count(*) as copies, h as text_hash from h group by h")
def text_hash_dupes(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("text_hash"))
    return h.groupBy("text_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("injection_risk", "with p as (select conv_id, turn, case when text is null then null else len(regexp_extract_all(text, '" + tx.INJECTION + "')) end as hits from conversations) select conv_id, turn, case when hits = 0 then 0.0 else least(1.0, 0.4 + 0.2 * hits) end as risk from p")
def injection_risk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.injection_risk(F.col("text")).alias("risk"))


@query("sanitize_regex", r"with s as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, 'https?://\S+', '[url]', 'g'), '[\w.+-]+@[\w-]+\.[\w.]+', '[email]', 'g'), '\+?\d[\d ()-]{7,}\d', '[phone]', 'g'), '@\w{2,}', '[user]', 'g') as clean from pages) select page_id, clean from s")
def sanitize_regex(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.placeholders(F.col("url")).alias("clean"))


@query("sanitize_text")
def sanitize_text(spark: SparkSession, sf: str) -> DataFrame:
    return tx.sanitise(table(spark, sf, "pages"), "html").select("page_id", "clean", tx.injection_risk(F.col("clean")).alias("risk"))


@query("export_safe", r"select doc_id, case when regexp_matches(text, '^[=+\-@\t\r]') then concat('''', text) else text end as cell, case when length(text) > 80 then concat(substr(text, 1, 77), '...') else text end as short from documents")
def export_safe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.export_safe(F.col("text")).alias("cell"), tx.truncate(F.col("text"), 80).alias("short"))


@query("pseudonyms", "select c_custkey, substr(sha256(concat('salt:', lower(trim(c_name)))), 1, 32) as pseudonym from customer")
def pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", tx.pseudonym(F.col("c_name"), "salt").alias("pseudonym"))


@query("company_names", "select s_suppkey, array_to_string(list_filter(string_split(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: not list_contains([" + ", ".join(f"'{w}'" for w in tx.LEGAL) + "], w)), ' ') as name from supplier")
def company_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", tx.company_name(F.col("s_name")).alias("name"))


_IN = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_VAL = f"case when list_contains({_IN(tx.POSITIVE)}, ws[i]) then 1.0 when list_contains({_IN(tx.NEGATIVE)}, ws[i]) then -1.0 else 0.0 end"


@query("lexicon_score", f"with w as (select conv_id, turn, string_split(lower(trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'))), ' ') as ws from conversations), v as (select conv_id, turn, list_transform(range(1, len(ws) + 1), lambda i: case when i > 1 and list_contains(['not', 'no', 'never'], ws[i - 1]) then -({_VAL}) else {_VAL} end) as vs from w) select conv_id, turn, case when list_sum(list_transform(vs, lambda v: abs(v))) > 0 then round_even(list_sum(vs) / list_sum(list_transform(vs, lambda v: abs(v))) + 3e-8, 6) + 0.0 else round_even(3e-8, 6) end as score from v")
def lexicon_score(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split(F.lower(F.trim(F.regexp_replace("text", "[^a-zA-Z]+", " "))), " ")
    w = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("words"))
    return w.select("conv_id", "turn", rounded(tx.lexicon_score(F.col("words"))).alias("score"))


@query("trading_calendar", f"with {SESSIONS_SQL} select cast(session as varchar) as session, ordinal, strftime(close_utc, '%Y-%m-%d %H:%M:%S') as close_utc from sessions")
def trading_calendar(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(spark, "1994-12-01", "2001-12-31")
    return s.select(F.col("session").cast("string").alias("session"), "ordinal", F.date_format("close_utc", "yyyy-MM-dd HH:mm:ss").alias("close_utc"))


@query("session_assignment", f"with {SESSIONS_SQL.replace('1994-12-01', '2023-12-01').replace('2001-12-31', '2024-12-31')} select event_id, cast(s.session as varchar) as session from events e asof join sessions s on s.close_utc >= e.ts")
def session_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Each event to the first session that closes at or after it: a session covers the span since the close before."""
    s = sessions(spark, "2023-12-01", "2024-12-31")
    e = table(spark, sf, "events").select("event_id", "ts")
    days = s.withColumn("day", F.explode(F.sequence(F.to_date("open_after"), F.to_date("close_utc"))))
    e = e.withColumn("day", F.to_date("ts"))
    # a calendar has some 250 rows a year: safe to broadcast
    joined = e.join(F.broadcast(days), "day").where((F.col("ts") > F.col("open_after")) & (F.col("ts") <= F.col("close_utc")))
    return joined.select("event_id", F.col("session").cast("string").alias("session"))


@query("missing_sessions", f"with {BARS}, {SESSIONS_SQL}, r as (select symbol, min(session) as lo, max(session) as hi, count(*) as have from bars group by symbol), x as (select r.symbol, count(*) as expected, count(*) filter (b.session is null) as missing from r join sessions s on s.session between lo and hi left join bars b on b.symbol = r.symbol and b.session = s.session group by r.symbol), o as (select b.symbol, count(*) as off_days from bars b anti join sessions s on s.session = b.session group by b.symbol) select x.symbol, expected, missing, coalesce(off_days, 0) as off_days, missing > greatest(3, 0.02 * expected) as error from x left join o on o.symbol = x.symbol")
def missing_sessions(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select("symbol", "session")
    s = F.broadcast(sessions(spark, "1994-12-01", "2001-12-31").select("session", "ordinal"))
    on = b.join(s, "session", "left")
    per = on.groupBy("symbol").agg(F.min("session").alias("lo"), F.max("session").alias("hi"), F.count("ordinal").alias("present"), F.count_if(F.col("ordinal").isNull()).alias("off_days"))
    # expected sessions by ordinals of the calendar at either end, without expanding days
    edges = sessions(spark, "1994-12-01", "2001-12-31")
    upto = edges.select(F.col("session").alias("at"), "ordinal", F.lead("session", 1, "2002-12-31").over(_cal()).alias("next"))
    hi = per.join(F.broadcast(upto), (F.col("hi") >= F.col("at")) & (F.col("hi") < F.col("next")), "left").select("symbol", "lo", "present", "off_days", F.col("ordinal").alias("to"))
    before = upto.select(F.col("at").alias("at2"), F.col("next").alias("next2"), F.col("ordinal").alias("o2"))
    both = hi.join(F.broadcast(before), (F.date_sub("lo", 1) >= F.col("at2")) & (F.date_sub("lo", 1) < F.col("next2")), "left")
    expected = F.col("to") - F.coalesce("o2", F.lit(0))
    return both.select("symbol", expected.alias("expected"), (expected - F.col("present")).alias("missing"), "off_days").withColumn("error", F.col("missing") > F.greatest(F.lit(3.0), 0.02 * F.col("expected")))


def _cal():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy("session")
