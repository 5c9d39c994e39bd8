"""Polarity and attention axes of each symbol and session, and the self-history percentiles of five indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import SESSIONS_SQL, sessions
from tidemark.functions.columns import rounded
from tidemark.operators import axes, indicators as ind
from tidemark.operators.moving import Rank, ranked
from tidemark.plans.assessments import _CRED
from tidemark.plans.market import _EMA, _full
from tidemark.registry import query
from tidemark.sources.adapters import BARS, POSTS, RICH, bars, rich_posts

PLAN = axes.Axes({"click": 0.12, "view": 0.08}, ("error", "signup"), least_posts=2, least_authors=2, least_history=4)
_r = lambda x, n: f"round_even({x} + 3e-8, 6) + 0.0 as {n}"
_BLEND = "(0.20 * raw + 0.25 * ew + 0.25 * cw + 0.30 * ua)"
_SCALE = lambda x, lo, hi: f"least(100.0, greatest(0.0, ({x} - ({lo})) / ({hi} - ({lo})) * 100.0))"
READINGS = f"""{POSTS}, {RICH}, {_CRED}, {SESSIONS_SQL.replace("date '1994-12-01', date '2001-12-31'", "date '2023-12-01', date '2025-01-31'")},
wt as (select *, pow(0.5, greatest((epoch(session) + 72000 - epoch(created_at)) / 3600.0, 0.0) / 18.0) as d from cred),
we as (select *, d * case when kind = 'news' then 1.0 else ln(1 + engagement) end as e from wt),
both2 as (select * from we union all select * replace ('all' as source) from we),
au as (select symbol, session, source, author, sum(polarity * d) / sum(d) as m from both2 group by all),
ua as (select symbol, session, source, count(*) as authors, avg(m) as ua from au group by all),
rd as (select symbol, session, source, count(*) as n, sum(polarity * d) / sum(d) as raw, case when sum(e) > 1e-12 then sum(polarity * e) / sum(e) else avg(polarity) end as ew, case when sum(d * c) > 1e-12 then sum(polarity * d * c) / sum(d * c) else avg(polarity) end as cw from both2 group by all),
r0 as (select rd.*, authors, ua, (select greatest(1, count(*)) from sessions s where s.session > rd.session - 2 and s.session <= rd.session) as fd, (select greatest(1, count(*)) from sessions s where s.session > rd.session - 10 and s.session <= rd.session - 2) as sd from rd join ua using (symbol, session, source)),
r1 as (select *, coalesce(sum(n) over (partition by symbol, source order by session range between interval 1 day preceding and current row), 0) as fn, coalesce(sum(n) over (partition by symbol, source order by session range between interval 9 day preceding and interval 2 day preceding), 0) as sn from r0),
r2 as (select *, case when fn + sn < 5 then 0.0 else greatest(-10.0, least(10.0, (fn / fd + 0.5) / (sn / sd + 0.5) - 1.0)) end as growth from r1)"""
_AXES = f"""with {READINGS}, tl as (select *, list(growth) over (partition by symbol, source order by session rows unbounded preceding) as h from r2 where source in ('error', 'signup')),
tr as (select symbol, session, source, case when len(h) >= 4 then case when list_min(h) = list_max(h) then 0.5 else len(list_filter(h, lambda v: v <= growth)) / len(h) end end as rank from tl),
ta as (select symbol, session, avg(rank) as tally, string_agg(case when rank is not null then source end, ',' order by source) as tallies from tr group by all),
ok as (select *, {_BLEND} as b from r2 where n >= 2 and authors >= 2 and source not in ('error', 'signup')),
c as (select a.symbol, a.session, a.growth as local, x.b as click_b, v.b as view_b, t.b as all_b, tally, tallies, dir from (select * from r2 where source = 'all') a cross join (select unnest(['long', 'short']) as dir)
 left join ok x on x.symbol = a.symbol and x.session = a.session and x.source = 'click' left join ok v on v.symbol = a.symbol and v.session = a.session and v.source = 'view'
 left join ok t on t.symbol = a.symbol and t.session = a.session and t.source = 'all' left join ta on ta.symbol = a.symbol and ta.session = a.session),
g as (select *, case when dir = 'short' then -1.0 else 1.0 end as sg, click_b is null and view_b is null and all_b is not null as stand_in from c)
select symbol, cast(session as varchar) as session, dir as direction,
{_r(f"case when click_b is not null then {_SCALE('sg * click_b', -0.6, 0.6)} when stand_in then {_SCALE('sg * all_b', -0.6, 0.6)} else 50.0 end", 'click_score')}, case when click_b is not null then 0.12 when stand_in then 0.06 else 0.0 end::double as click_weight,
{_r(f"case when view_b is not null then {_SCALE('sg * view_b', -0.6, 0.6)} when stand_in then {_SCALE('sg * all_b', -0.6, 0.6)} else 50.0 end", 'view_score')}, case when view_b is not null then 0.08 when stand_in then 0.04 else 0.0 end::double as view_weight,
case when stand_in then 'all' else concat_ws(',', case when click_b is not null then 'click' end, case when view_b is not null then 'view' end) end as measured,
{_r(f"coalesce(0.55 * {_SCALE('local', -0.3, 1.0)} + 0.45 * tally * 100.0, {_SCALE('local', -0.3, 1.0)})", 'attention_score')}, 0.1::double as attention_weight, coalesce(tallies, '') as tallies from g"""


@query("crowd_axes", _AXES)
def crowd_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Polarity from two sources with slots of their own, attention from all posts and two tallies."""
    read = axes.with_growth(axes.readings(rich_posts(spark, sf)), sessions(spark, "2023-12-01", "2025-01-31"), PLAN)
    a = axes.score(read, PLAN)
    return a.select("symbol", F.col("session").cast("string").alias("session"), "direction", *(rounded(f"{s}_score").alias(f"{s}_score") for s in (*PLAN.slots, "attention")), *(f"{s}_weight" for s in (*PLAN.slots, "attention")), "measured", "tallies")


SELF = ("rel_volume", "roc20", "rsi14", "adx14", "dist50")


def self_history(spark: SparkSession, sf: str) -> DataFrame:
    """Each indicator by rank in its own last 120 rows."""
    b = bars(spark, sf)
    dist = (F.col("close") / ind.sma("close", 50) - 1) * 100
    f = b.select("symbol", "session", ind.relative_volume().alias("rel_volume"), ind.roc("close", 20).alias("roc20"), dist.alias("dist50"))
    f = f.join(ind.smoothed(b, ("rsi14", "adx14")), ["symbol", "session"])
    return ranked(f.withColumns({c: rounded(c) for c in SELF}), ["symbol"], "session", {f"{c}_pctl": Rank(c, 120) for c in SELF})


_FIRST = [c for c in SELF if c != "adx14"]


@query("self_percentiles", f"with {BARS}{_EMA.replace('#WINDOWS', 'window s as (partition by symbol order by session), a as (partition by symbol order by session rows unbounded preceding)')}, v as (select symbol, session, round_even(volume / nullif({_full('avg', 'volume', 'p20', 20)}, 0) + 3e-8, 6) + 0.0 as rel_volume, round_even((close / nullif(lag(close, 20) over s, 0) - 1) * 100 + 3e-8, 6) + 0.0 as roc20, round_even((close / ({_full('avg', 'close', 'w50', 50)}) - 1) * 100 + 3e-8, 6) + 0.0 as dist50, round_even(case when g is null then null when g = 0 and ls = 0 then 50.0 when ls = 0 then 100.0 else 100 - 100 / (1 + g / ls) end + 3e-8, 6) + 0.0 as rsi14 from e window s as (partition by symbol order by session), p20 as (partition by symbol order by session rows between 20 preceding and 1 preceding), w50 as (partition by symbol order by session rows between 49 preceding and current row)), h as (select symbol, session, {', '.join(f'{c}, list_filter(list({c}) over w, lambda x: x is not null) as {c}_l' for c in _FIRST)} from v window w as (partition by symbol order by session rows between 119 preceding and current row)) select symbol, cast(session as varchar) as session, {', '.join(_r(f'case when {c} is not null and len({c}_l) >= 120 then len(list_filter({c}_l, lambda x: x <= {c})) / len({c}_l) end', f'{c}_pctl') for c in _FIRST)} from h")
def self_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of four indicators; adx14's has no SQL and is tested against a loop."""
    h = self_history(spark, sf)
    return h.select("symbol", F.col("session").cast("string").alias("session"), *(rounded(f"{c}_pctl").alias(f"{c}_pctl") for c in _FIRST))
