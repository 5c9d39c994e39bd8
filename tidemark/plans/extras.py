"""Small operators: text guards, relative strength, regime adjustments, quality gates, enrichment, backfill, charts, marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import SESSIONS_SQL, sessions
from tidemark.functions.columns import full, rounded
from tidemark.functions.text import INJECTION, truncate
from tidemark.operators import relations as rel
from tidemark.registry import query
from tidemark.sources.adapters import BARS, EARNINGS, SECURITIES, TRADES, bars, earnings, securities, table, trades

_r = lambda x, n: f"round_even({x} + 3e-8, 6) + 0.0 as {n}"
_S = "cast(session as varchar) as session"
_PATTERN = INJECTION.removeprefix("(?i)")
OPEN, CLOSE, LIMIT = "<<<untrusted", "untrusted>>>", 1200


@query("injection_markers", f"select doc_id, coalesce(regexp_matches(text, '{_PATTERN}', 'i'), false) as marked from documents")
def injection_markers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.col("text").rlike(INJECTION), F.lit(False)).alias("marked"))


@query("prepared_text", f"with p as (select doc_id, replace(replace(text, '{OPEN}', ''), '{CLOSE}', '') as t from documents) select doc_id, sha256(concat('{OPEN} ', case when length(t) > {LIMIT} then left(t, {LIMIT - 3}) || '...' else t end, ' {CLOSE}')) as digest, length(t) > {LIMIT} as cut from p where t is not null")
def prepared_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts fenced by markers that they can't hold themselves, cut to a length."""
    t = F.replace(F.replace("text", F.lit(OPEN), F.lit("")), F.lit(CLOSE), F.lit(""))
    p = table(spark, sf, "documents").select("doc_id", t.alias("t")).where("t is not null")
    return p.select("doc_id", F.sha2(F.concat(F.lit(OPEN + " "), truncate(F.col("t"), LIMIT), F.lit(" " + CLOSE)), 256).alias("digest"), (F.length("t") > LIMIT).alias("cut"))


_COMMON = ("AN", "IN", "IT", "ON", "ALL", "FOR", "ARE", "CAN", "SO", "BE")


@query("ambiguous_symbols", f"with s as (select distinct upper(left(n_name, k)) as ticker from nation, (select unnest([1, 2, 3]) as k)) select ticker, length(ticker) <= 1 or ticker in {_COMMON} as ambiguous from s")
def ambiguous_symbols(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "nation").select(F.explode(F.array(*(F.upper(F.substring("n_name", 1, k)) for k in (1, 2, 3)))).alias("ticker")).distinct()
    return s.select("ticker", ((F.length("ticker") <= 1) | F.col("ticker").isin(*_COMMON)).alias("ambiguous"))


#: Market states: size, bias, and whether longs are allowed.
STATES = {"bull_quiet": (1.0, 0.5, True), "bull_volatile": (0.75, 0.25, True), "neutral": (0.75, 0.0, True), "bear_quiet": (0.5, -0.25, False), "bear_volatile": (0.25, -0.5, False)}
_TABLE = ", ".join(f"('{k}', {a}, {b}, {str(c).lower()})" for k, (a, b, c) in STATES.items())


def _regime_sql() -> str:
    from tidemark.registry import ORACLE_SQL

    return ORACLE_SQL["regime_series"]


def _register_regime() -> None:
    @query("regime_adjustments", f"with rs as ({_regime_sql()}), st(regime, size, bias, longs) as (values {_TABLE}) select session, regime, size::double as size, bias::double as bias, longs from rs join st using (regime)")
    def regime_adjustments(spark: SparkSession, sf: str) -> DataFrame:
        """How much of a position a market state allows, and which way it leans."""
        from tidemark.registry import QUERIES

        states = spark.createDataFrame([(k, *v) for k, v in STATES.items()], "regime string, size double, bias double, longs boolean")
        return QUERIES["regime_series"](spark, sf).join(F.broadcast(states), "regime").select("session", "regime", "size", "bias", "longs")


_ISSUES = f"{BARS}, l as (select *, lag(close) over (partition by symbol order by session) as pc from bars), i as (select symbol, session, unnest([case when volume = 0 then 'zero_volume' end, case when high < greatest(open, close) or low > least(open, close) then 'ohlc' end, case when abs(close / nullif(pc, 0) - 1) >= 0.5 then 'jump' end, case when isodow(session) >= 6 then 'weekend' end]) as kind from l)"


@query("open_issues", f"with {_ISSUES}, r as (select *, row_number() over (partition by symbol order by session desc, kind) as k from i where kind is not null) select symbol, {_S}, kind from r where k <= 5")
def open_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The five newest issues of each symbol (a top-k report)."""
    w = Window.partitionBy("symbol").orderBy(F.desc("session"), "kind")
    return rel.bar_issues(bars(spark, sf)).withColumn("k", F.row_number().over(w)).where("k <= 5").select("symbol", F.col("session").cast("string").alias("session"), "kind")


@query("blocked_symbols", f"with {_ISSUES}, {SECURITIES}, b as (select symbol, count(*) as errors from i where kind in ('ohlc', 'jump') group by symbol) select s.symbol, coalesce(errors, 0) as errors, coalesce(errors, 0) > 5 as blocked from securities s left join b using (symbol)")
def blocked_symbols(spark: SparkSession, sf: str) -> DataFrame:
    b = rel.bar_issues(bars(spark, sf)).where("kind in ('ohlc', 'jump')").groupBy("symbol").agg(F.count("*").alias("errors"))
    errors = F.coalesce("errors", F.lit(0))
    return securities(spark, sf).select("symbol").join(b, "symbol", "left").select("symbol", errors.alias("errors"), (errors > 5).alias("blocked"))


@query("cap_enrichment", f"with {BARS}, {SECURITIES}, p as (select symbol, arg_max(close, session) as last, sum(volume) as shares from bars group by symbol) select s.symbol, coalesce(s.market_cap_usd, case when shares > 400 then last * shares * 1000 end) as market_cap_usd, case when s.market_cap_usd is not null then 'listing' when shares > 400 then 'derived' else 'unresolved' end as origin from securities s left join p using (symbol)")
def cap_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Missing capitalisations from the next source that has one; what no source knows is flagged."""
    p = bars(spark, sf).groupBy("symbol").agg(F.max_by("close", "session").alias("last"), F.sum("volume").alias("shares"))
    derived = F.when(F.col("shares") > 400, F.col("last") * F.col("shares") * 1000)
    origin = F.when(F.col("market_cap_usd").isNotNull(), "listing").when(F.col("shares") > 400, "derived").otherwise("unresolved")
    return securities(spark, sf).join(p, "symbol", "left").select("symbol", F.coalesce("market_cap_usd", derived).alias("market_cap_usd"), origin.alias("origin"))


@query("backfill_dates", f"with {BARS}, {SESSIONS_SQL}, {SECURITIES}, h as (select session, count(*) as have from bars join securities using (symbol) group by session), u as (select count(*) as listed from securities) select cast(s.session as varchar) as session, coalesce(have, 0) as have, row_number() over (order by s.session desc) as turn from sessions s cross join u left join h on h.session = s.session where coalesce(have, 0) * 2 < listed")
def backfill_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions on which less than half of the listed symbols have a bar, newest first: some 250 rows a year. Bars are counted by session in
    each task before they are sent."""
    listed = securities(spark, sf).select("symbol")
    have = bars(spark, sf).select("symbol", "session").join(listed, "symbol", "left_semi").groupBy("session").agg(F.count("*").alias("have"))
    size = F.broadcast(listed.agg(F.count("*").alias("listed")))  # one row
    left = sessions(spark, "1994-12-01", "2001-12-31").select("session").join(have, "session", "left").crossJoin(size).withColumn("have", F.coalesce("have", F.lit(0)))
    left = left.where(F.col("have") * 2 < F.col("listed"))
    return left.select(F.col("session").cast("string").alias("session"), "have", F.row_number().over(Window.orderBy(F.desc("session"))).alias("turn"))


@query("chart_indicators", f"with {BARS}, c as (select * from bars where session >= date '1998-01-01'), w as (select *, count(close) over w20 as n, avg(close) over w20 as mid, stddev_pop(close) over w20 as sd from c window w20 as (partition by symbol order by session rows between 19 preceding and current row)) select symbol, {_S}, {_r('case when n >= 20 then mid end', 'sma20')}, {_r('case when n >= 20 then mid + 2 * sd end', 'upper')}, {_r('case when n >= 20 then mid - 2 * sd end', 'lower')} from w")
def chart_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators of the bars shown only: the filter comes before the window, so they warm up anew."""
    c = bars(spark, sf).where("session >= date'1998-01-01'")
    mid, sd = full(F.avg, "close", 20), full(F.stddev_pop, "close", 20)
    return c.select("symbol", F.col("session").cast("string").alias("session"), rounded(mid).alias("sma20"), rounded(mid + 2 * sd).alias("upper"), rounded(mid - 2 * sd).alias("lower"))


@query("exact_bar", f"with {BARS}, {EARNINGS} select e.event_id, b.symbol is not null as has_bar, {_r('b.close', 'close')} from earnings e left join bars b on b.symbol = e.symbol and b.session = e.report_date")
def exact_bar(spark: SparkSession, sf: str) -> DataFrame:
    """The bar exactly on a report's day, if there is one."""
    b = bars(spark, sf).select("symbol", F.col("session").alias("report_date"), "close", F.lit(True).alias("has"))
    return earnings(spark, sf).join(b, ["symbol", "report_date"], "left").select("event_id", F.coalesce("has", F.lit(False)).alias("has_bar"), rounded("close").alias("close"))


@query("open_marks", f"with {BARS}, {TRADES}, l as (select symbol, arg_max(close, session) as mark from bars where session < date '1998-06-30' group by symbol), o as (select * from trades where entry_session < date '1998-06-30' and exit_session >= date '1998-06-30') select o.strategy, count(*) as positions, {_r('sum((mark - entry_price) * shares)', 'unrealised')}, {_r('sum(mark * shares)', 'exposure')} from o join l using (symbol) group by o.strategy")
def open_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Positions open on a day, marked to the last close before it."""
    last = bars(spark, sf).where("session < date'1998-06-30'").groupBy("symbol").agg(F.max_by("close", "session").alias("mark"))
    o = trades(spark, sf).where("entry_session < date'1998-06-30' and exit_session >= date'1998-06-30'").join(last, "symbol")
    g = o.groupBy("strategy").agg(F.count("*").alias("positions"), F.sum((F.col("mark") - F.col("entry_price")) * F.col("shares")).alias("u"), F.sum(F.col("mark") * F.col("shares")).alias("x"))
    return g.select("strategy", "positions", rounded("u").alias("unrealised"), rounded("x").alias("exposure"))


@query("realised_since", f"with {TRADES} select strategy, {_r('sum(case when exit_session >= date $$1999-01-01$$ then net else 0.0 end)', 'this_year')}, {_r('sum(case when exit_session >= date $$1998-12-01$$ and exit_session < date $$1999-01-01$$ then net else 0.0 end)', 'last_month')}, count(*) filter (exit_session >= date '1999-01-01') as closed from trades where exit_session < date '2000-01-01' group by strategy")
def realised_since(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf).where("exit_session < date'2000-01-01'")
    year, month = F.expr("exit_session >= date'1999-01-01'"), F.expr("exit_session >= date'1998-12-01' and exit_session < date'1999-01-01'")
    g = t.groupBy("strategy").agg(F.sum(F.when(year, F.col("net")).otherwise(0.0)).alias("y"), F.sum(F.when(month, F.col("net")).otherwise(0.0)).alias("m"), F.count_if(year).alias("closed"))
    return g.select("strategy", rounded("y").alias("this_year"), rounded("m").alias("last_month"), "closed")


_register_regime()
