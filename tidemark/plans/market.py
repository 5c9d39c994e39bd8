"""Queries over bars: indicators, patterns, cross-series measures and market state."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import full, ratio, rolling_percentile, rounded
from tidemark.operators import cross, indicators as ind, patterns as pat
from tidemark.registry import query
from tidemark.sources.adapters import BARS, SECURITIES, bars, securities

R = "round_even({} + 3e-8, 6) + 0.0 as {}"


def _out(df: DataFrame, *names: str) -> DataFrame:
    """Key columns, then numbers half-even at 6 places and flags as they are."""
    kinds = dict(df.dtypes)
    return df.select("symbol", F.col("session").cast("string").alias("session"), *((rounded(n) if kinds[n] == "double" else F.col(n)).alias(n) for n in names))


def _sql(columns: dict[str, str], steps: str = "", source: str = "bars", plain: tuple = ()) -> str:
    """SQL over bars with windows w{n} (last n rows), p{n} (prior n rows), s (in order) and a (all rows so far)."""
    listed = ", ".join(f"{e} as {n}" if n in plain else R.format(e, n) for n, e in columns.items())
    frames = ", ".join([f"w{n} as (partition by symbol order by session rows between {n - 1} preceding and current row)" for n in (3, 5, 10, 14, 20, 50, 60, 120, 126, 200, 252)] + [f"p{n} as (partition by symbol order by session rows between {n} preceding and 1 preceding)" for n in (10, 20)] + ["s as (partition by symbol order by session)", "a as (partition by symbol order by session rows unbounded preceding)"])
    windows = "" if source != "bars" and not steps else f" window {frames}"
    return f"with {BARS}{steps.replace('#WINDOWS', f'window {frames}')} select symbol, cast(session as varchar) as session, {listed} from {source}" + (f" window {frames}" if windows else "")


def _full(f: str, x: str, w: str, n: int) -> str:
    return f"case when count({x}) over {w} >= {n} then {f}({x}) over {w} end"


@query("ohlcv_rollup", _sql({c: c for c in ("open", "high", "low", "close", "volume")}))
def ohlcv_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bars(spark, sf), "open", "high", "low", "close", "volume")


@query("sma", _sql({f"sma{n}": _full("avg", "close", f"w{n}", n) for n in (20, 50, 200)}))
def sma(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bars(spark, sf).select("*", *(ind.sma("close", n).alias(f"sma{n}") for n in (20, 50, 200))), "sma20", "sma50", "sma200")


@query("roc_slope", _sql({"roc20": "(close / nullif(lag(close, 20) over s, 0) - 1) * 100", "slope20": "(close - lag(close, 20) over s) / 20"}))
def roc_slope(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bars(spark, sf).select("*", ind.roc("close", 20).alias("roc20"), ind.slope("close", 20).alias("slope20")), "roc20", "slope20")


@query("true_range", _sql({"true_range": "case when lag(close) over s is not null then greatest(high - low, abs(high - lag(close) over s), abs(low - lag(close) over s)) end"}))
def true_range(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bars(spark, sf).withColumn("true_range", ind.true_range()), "true_range")


_BB = f"(select *, {_full('avg', 'close', 'w20', 20)} as bb_mid, {_full('stddev_pop', 'close', 'w20', 20)} as sd from bars #WINDOWS)"


@query("bollinger", _sql({"bb_mid": "bb_mid", "bb_up": "bb_mid + 2 * sd", "bb_down": "bb_mid - 2 * sd", "pct_b": "(close - (bb_mid - 2 * sd)) / nullif((bb_mid + 2 * sd) - (bb_mid - 2 * sd), 0)", "bandwidth": "((bb_mid + 2 * sd) - (bb_mid - 2 * sd)) / nullif(bb_mid, 0) * 100"}, f", bb as {_BB}", "bb"))
def bollinger(spark: SparkSession, sf: str) -> DataFrame:
    cols = ind.bollinger()
    return _out(bars(spark, sf).withColumns(cols), *cols)


@query("donchian", _sql({"don_high": _full("max", "high", "w20", 20), "don_low": _full("min", "low", "w20", 20)}))
def donchian(spark: SparkSession, sf: str) -> DataFrame:
    cols = ind.donchian()
    return _out(bars(spark, sf).withColumns(cols), *cols)


@query("hist_vol", _sql({"hist_vol": f"{_full('stddev_samp', 'lr', 'w20', 20)} * sqrt(252)"}, ", r as (select *, ln(close / nullif(lag(close) over s, 0)) as lr from bars #WINDOWS)", "r"))
def hist_vol(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ind.historical_volatility(bars(spark, sf)), "hist_vol")


@query("rel_volume", _sql({"rel_volume": f"volume / nullif({_full('avg', 'volume', 'p20', 20)}, 0)"}))
def rel_volume(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bars(spark, sf).withColumn("rel_volume", ind.relative_volume()), "rel_volume")


@query("obv", _sql({"obv": "sum(step) over a"}, ", d as (select *, coalesce(sign(close - lag(close) over s) * volume, 0.0) as step from bars #WINDOWS)", "d"))
def obv(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ind.on_balance_volume(bars(spark, sf)), "obv")


@query("ad_line", _sql({"ad_line": "sum((case when high <> low then ((close - low) - (high - close)) / (high - low) else 0.0 end) * volume) over a"}))
def ad_line(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ind.accumulation_distribution(bars(spark, sf)), "ad_line")


@query("vwap", _sql({"vwap": f"({_full('sum', '(high + low + close) / 3 * volume', 'w20', 20)}) / nullif({_full('sum', 'volume', 'w20', 20)}, 0)"}))
def vwap(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bars(spark, sf).withColumn("vwap", ind.vwap()), "vwap")


_MFI = ", t as (select *, (high + low + close) / 3 as tp from bars), c as (select *, tp - lag(tp) over s as ch from t #WINDOWS), m as (select *, " + _full("sum", "case when ch > 0 then tp * volume else 0.0 end", "w14", 14) + " as up_sum, " + _full("sum", "case when ch < 0 then tp * volume else 0.0 end", "w14", 14) + " as down_sum from c #WINDOWS)"


@query("mfi", _sql({"mfi": "case when up_sum is null then null when up_sum = 0 and down_sum = 0 then 50.0 when down_sum = 0 then 100.0 else 100 - 100 / (1 + up_sum / down_sum) end"}, _MFI, "m"))
def mfi(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ind.money_flow_index(bars(spark, sf)), "mfi")


_STREAK = ", d as (select *, close - lag(close) over s as d from bars #WINDOWS), g as (select *, sum(case when coalesce(d > 0, false) then 0 else 1 end) over a as ug, sum(case when coalesce(d < 0, false) then 0 else 1 end) over a as dg from d #WINDOWS)"


@query("streaks", f"with {BARS}{_STREAK.replace('#WINDOWS', 'window s as (partition by symbol order by session), a as (partition by symbol order by session rows unbounded preceding)')} select symbol, cast(session as varchar) as session, case when d is not null then sum(case when d > 0 then 1 else 0 end) over (partition by symbol, ug order by session rows unbounded preceding) end as rise_streak, case when d is not null then sum(case when d < 0 then 1 else 0 end) over (partition by symbol, dg order by session rows unbounded preceding) end as fall_streak from g")
def streaks(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ind.streaks(bars(spark, sf)), "rise_streak", "fall_streak")


@query("rolling_percentile", _sql({"pctl": "case when len(l) >= 120 then len(list_filter(l, lambda v: v <= rv)) / len(l) end"}, f", v as (select *, volume / nullif({_full('avg', 'volume', 'p20', 20)}, 0) as rv from bars #WINDOWS), q as (select *, list_filter(list(rv) over w120, lambda v: v is not null) as l from v #WINDOWS)", "q"))
def rolling_pct(spark: SparkSession, sf: str) -> DataFrame:
    v = bars(spark, sf).withColumn("rv", ind.relative_volume())
    return _out(rolling_percentile(v, "rv", 120, "pctl"), "pctl")


@query("gap_pct", _sql({"gap_pct": "(open - lag(close) over s) / nullif(lag(close) over s, 0) * 100"}))
def gap_pct(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bars(spark, sf).withColumn("gap_pct", ind.gap_pct()), "gap_pct")


@query("days_since_high", _sql({"since_high": "case when count(high) over w252 >= 252 then rn - arg_max(rn, (high, -rn)) over w252 end"}, ", n as (select *, row_number() over s as rn from bars #WINDOWS)", "n", plain=("since_high",)))
def days_since_high(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ind.rows_since_high(bars(spark, sf)), "since_high")


@query("levels_52w", _sql({"high52": _full("max", "high", "w252", 252), "low52": _full("min", "low", "w252", 252), "from_high_pct": f"(close - ({_full('max', 'high', 'w252', 252)})) / ({_full('max', 'high', 'w252', 252)}) * 100", "dollar_volume20": _full("avg", "close * volume", "w20", 20)}))
def levels_52w(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("high52", full(F.max, "high", 252)).withColumn("low52", full(F.min, "low", 252)).withColumn("dollar_volume20", full(F.avg, F.col("close") * F.col("volume"), 20))
    return _out(b.withColumn("from_high_pct", ratio(F.col("close") - F.col("high52"), F.col("high52")) * 100), "high52", "low52", "from_high_pct", "dollar_volume20")


_L = "list(close) over a"


def _fold(values: str, k: str) -> str:
    return f"list_reduce({values}, lambda x, y: x + {k} * (y - x))"


_EMA = f", l as (select *, {_L} as cl, list(close - pc) over a as dl, list(case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end) over a as trl, count(pc) over a as nd from (select *, lag(close) over s as pc from bars #WINDOWS) #WINDOWS), k as (select *, list_filter(dl, lambda v: v is not null) as ds, list_filter(trl, lambda v: v is not null) as trs from l), e as (select *, {_fold('cl', '2.0 / 13')} as e12, {_fold('cl', '2.0 / 27')} as e26, case when nd >= 14 then {_fold('list_transform(ds, lambda v: greatest(v, 0.0))', '1.0 / 14')} end as g, case when nd >= 14 then {_fold('list_transform(ds, lambda v: greatest(-v, 0.0))', '1.0 / 14')} end as ls, case when nd >= 14 then {_fold('trs', '1.0 / 14')} end as atr from k)"


@query("ema_rsi_atr", _sql({"ema12": "case when len(cl) >= 12 then e12 end", "ema26": "case when len(cl) >= 26 then e26 end", "macd": "case when len(cl) >= 26 then e12 - e26 end", "rsi14": "case when g is null then null when g = 0 and ls = 0 then 50.0 when ls = 0 then 100.0 else 100 - 100 / (1 + g / ls) end", "atr14": "atr"}, _EMA, "e"))
def ema_rsi_atr(spark: SparkSession, sf: str) -> DataFrame:
    names = ("ema12", "ema26", "macd", "rsi14", "atr14")
    return _out(ind.smoothed(bars(spark, sf), names), *names)


@query("macd_adx_keltner")
def macd_adx_keltner(spark: SparkSession, sf: str) -> DataFrame:
    names = ("macd_signal", "macd_hist", "adx14", "keltner_up", "keltner_down")
    return _out(ind.smoothed(bars(spark, sf), names), *names)


@query("volatility_contraction", _sql({"contraction": "(1 - case when bw is not null and len(l) >= 126 then len(list_filter(l, lambda v: v <= bw)) / len(l) end) * 100"}, f", bb as {_BB}, x as (select *, ((bb_mid + 2 * sd) - (bb_mid - 2 * sd)) / nullif(bb_mid, 0) * 100 as bw from bb), q as (select *, list_filter(list(bw) over w126, lambda v: v is not null) as l from x #WINDOWS)", "q"))
def volatility_contraction(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ind.volatility_contraction(bars(spark, sf)), "contraction")


# patterns

_SW = """, sw0 as (select *, lag(high, 3) over s as h3, lag(low, 3) over s as l3,
  max(high) over (partition by symbol order by session rows between 6 preceding and 4 preceding) as hb, max(high) over w3 as ha,
  min(low) over (partition by symbol order by session rows between 6 preceding and 4 preceding) as lb, min(low) over w3 as la,
  count(*) over (partition by symbol order by session rows between 6 preceding and current row) as n7 from bars #WINDOWS),
sw1 as (select *, coalesce(n7 >= 7 and h3 > hb and h3 > ha, false) as swing_high, coalesce(n7 >= 7 and l3 < lb and l3 < la, false) as swing_low from sw0),
sw as (select *, last_value(case when swing_high then high end ignore nulls) over a as recent_high, last_value(case when swing_low then low end ignore nulls) over a as recent_low from sw1 #WINDOWS)"""


@query("swing_points", _sql({"swing_high": "swing_high", "swing_low": "swing_low", "recent_high": "recent_high", "recent_low": "recent_low"}, _SW, "sw", plain=("swing_high", "swing_low")))
def swing_points(spark: SparkSession, sf: str) -> DataFrame:
    return _out(pat.swings(bars(spark, sf)), "swing_high", "swing_low", "recent_high", "recent_low")


_HH = _SW + """, hh0 as (select *, list_filter(list(case when swing_high then high end) over w60, lambda v: v is not null) as hs0, list_filter(list(case when swing_low then low end) over w60, lambda v: v is not null) as ls0 from sw #WINDOWS),
hh as (select *, hs0[greatest(1, len(hs0) - 2):] as hs, ls0[greatest(1, len(ls0) - 2):] as ls from hh0)"""
_SIGNS = "list_transform(range(2, len({0}) + 1), lambda i: case when {0}[i] > {0}[i - 1] then 1.0 else -1.0 end)"


@query("structure_score", _sql({"structure": f"case when len(hs) >= 2 and len(ls) >= 2 then list_sum(list_concat({_SIGNS.format('hs')}, {_SIGNS.format('ls')})) / (len(hs) + len(ls) - 2) end"}, _HH, "hh"))
def structure_score(spark: SparkSession, sf: str) -> DataFrame:
    return _out(pat.structure_score(bars(spark, sf)), "structure")


_BO = f", bo as (select *, {_full('max', 'high', 'p20', 20)} as level, {_full('avg', 'volume', 'p20', 20)} as uv, row_number() over s as rn, lag(close) over s as pc from bars #WINDOWS), bo2 as (select *, coalesce(close > level and volume > 1.5 * uv, false) as breakout from bo)"


def _flag_steps(name: str, ahead: tuple[int, int], holds: str, event: str, level: str, source: str = "bo2", tag: str = "") -> str:
    """Steps up to fl{tag}, with a flag on the first row of some rows ahead of an event where a condition on {r} (the row, by its
    lag) and {l} (the event's level) holds."""
    used = [c for c in ("open", "high", "low", "close", "pc") if "{r}" + c in holds]
    low, high = ahead
    lags = ", ".join(f"lag({c}, {k}) over s as {c}_{k}" for k in range(high + 1) for c in (*used, f"ev{tag}", f"lv{tag}"))

    def held(j: int, k: int) -> str:
        return "coalesce(" + re.sub(r"\{r\}(\w+)", rf"\1_{j}", holds).replace("{l}", f"lv{tag}_{k}") + ", false)"

    flag = " or ".join("(" + " and not ".join([f"coalesce(ev{tag}_{k}, false) and {held(0, k)}", *(held(j, k) for j in range(1, k - low + 1))]) + ")" for k in range(low, high + 1))
    kept = "symbol, session, open, high, low, close, pc, level"
    return f", e0{tag} as (select *, {event} as ev{tag}, {level} as lv{tag} from {source}), e1{tag} as (select *, {lags} from e0{tag} #WINDOWS), fl{tag} as (select {kept}, {flag} as {name} from e1{tag})"


def _event_sql(name: str, *rule, before: str = "", **more) -> str:
    return _sql({name: name}, _BO + before + _flag_steps(name, *rule, **more), "fl", plain=(name,))


@query("breakout", _sql({"breakout": "breakout", "level": "level"}, _BO, "bo2", plain=("breakout",)))
def breakout(spark: SparkSession, sf: str) -> DataFrame:
    return _out(pat.breakout(bars(spark, sf)), "breakout", "level")


_FAILED = ("failed_breakout", (1, 5), "{r}close < {l}", "breakout", "level")


@query("failed_breakout", _event_sql(*_FAILED))
def failed_breakout(spark: SparkSession, sf: str) -> DataFrame:
    return _out(pat.failed_breakout(bars(spark, sf)), "failed_breakout")


@query("gap_fill", _event_sql("gap_filled", (0, 10), "{r}low <= {l} and {l} <= {r}high", "pc is not null and (open - pc) / nullif(pc, 0) * 100 <> 0", "pc"))
def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    return _out(pat.gap_fill(bars(spark, sf)), "gap_filled")


@query("gap_continuation", _event_sql("gap_continuation", (1, 3), "{r}open > {l} and {r}open > {r}pc", "breakout", "level"))
def gap_continuation(spark: SparkSession, sf: str) -> DataFrame:
    return _out(pat.gap_continuation(bars(spark, sf)), "gap_continuation")


@query("gap_continuation_down", _event_sql("gap_continuation", (1, 3), "{r}open < {l} and {r}open < {r}pc", "failed_breakout", "level", before=_flag_steps(*_FAILED, tag="f"), source="flf"))
def gap_continuation_down(spark: SparkSession, sf: str) -> DataFrame:
    return _out(pat.gap_continuation(bars(spark, sf), up=False), "gap_continuation")


_PV = "(lag(high) over s + lag(low) over s + lag(close) over s) / 3"


@query("pivot_points", _sql({"pivot": _PV, "r1": f"2 * {_PV} - lag(low) over s", "s1": f"2 * {_PV} - lag(high) over s", "r2": f"{_PV} + (lag(high) over s - lag(low) over s)", "s2": f"{_PV} - (lag(high) over s - lag(low) over s)"}))
def pivot_points(spark: SparkSession, sf: str) -> DataFrame:
    cols = pat.pivot_points()
    return _out(bars(spark, sf).withColumns(cols), *cols)


@query("fibonacci", _sql({k: f"recent_low + {r} * (recent_high - recent_low)" for k, r in pat.RATIOS.items()}, _SW, "sw"))
def fibonacci(spark: SparkSession, sf: str) -> DataFrame:
    cols = pat.fibonacci()
    return _out(pat.swings(bars(spark, sf)).withColumns(cols), *cols)


_RN = "round_even(close / (case when close < 20 then 1.0 when close < 100 then 5.0 else 10.0 end), 0) * (case when close < 20 then 1.0 when close < 100 then 5.0 else 10.0 end)"


@query("round_number", _sql({"round_level": _RN}))
def round_number(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bars(spark, sf).withColumn("round_level", pat.round_number(F.col("close"))), "round_level")


def _near(levels: list[str]) -> str:
    return "cast(" + " or ".join(f"coalesce(abs(close - ({x})) / abs(close) * 100 <= 1.0, false)" for x in levels) + " as int)"


_CF = _SW + f", cf as (select *, {_PV} as pv, lag(high) over s as ph, lag(low) over s as pl, {_full('avg', 'close', 'w20', 20)} as ma20, {_full('avg', 'close', 'w50', 50)} as ma50 from sw #WINDOWS)"


@query("confluence", _sql({"confluence": " + ".join([_near(["recent_high", "recent_low"]), _near(["pv", "2 * pv - pl", "2 * pv - ph", "pv + (ph - pl)", "pv - (ph - pl)"]), _near([f"recent_low + {r} * (recent_high - recent_low)" for r in pat.RATIOS.values()]), _near([_RN]), _near(["ma20", "ma50"])])}, _CF, "cf", plain=("confluence",)))
def confluence(spark: SparkSession, sf: str) -> DataFrame:
    return _out(pat.confluence(bars(spark, sf)), "confluence")


@query("volume_divergence", _sql({"divergence": f"coalesce(volume / nullif({_full('avg', 'volume', 'p20', 20)}, 0) >= 1.5 and abs((close / nullif(lag(close) over s, 0) - 1) * 100) < 1, false)"}, plain=("divergence",)))
def volume_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bars(spark, sf).withColumn("divergence", pat.volume_divergence()), "divergence")


_HL10 = (_full("max", "high", "w10", 10), _full("min", "low", "w10", 10))


@query("consolidation", _sql({"range_pct": f"(({_HL10[0]}) - ({_HL10[1]})) / nullif({_HL10[1]}, 0) * 100", "tight": f"coalesce((({_HL10[0]}) - ({_HL10[1]})) / nullif({_HL10[1]}, 0) * 100 <= 5, false)"}, plain=("tight",)))
def consolidation(spark: SparkSession, sf: str) -> DataFrame:
    return _out(pat.consolidation(bars(spark, sf)), "range_pct", "tight")


@query("reclaim", _sql({"reclaim": "coalesce(close > ma and max(b) over p10 = 1, false)"}, f", m as (select *, {_full('avg', 'close', 'w20', 20)} as ma from bars #WINDOWS), mb as (select *, cast(close < ma as int) as b from m)", "mb", plain=("reclaim",)))
def reclaim(spark: SparkSession, sf: str) -> DataFrame:
    return _out(pat.reclaim(bars(spark, sf)), "reclaim")


@query("pullback", _sql({"pullback": "coalesce(close > trend and trend > lag(trend, 10) over s and abs(close - ma) / ma * 100 <= 3 and avg(q) over w5 <= avg(q) over (partition by symbol order by session rows between 9 preceding and 5 preceding), false)"}, f", m as (select *, {_full('avg', 'close', 'w20', 20)} as ma, {_full('avg', 'close', 'w50', 50)} as trend, case when close < lag(close) over s then volume end as q from bars #WINDOWS)", "m", plain=("pullback",)))
def pullback(spark: SparkSession, sf: str) -> DataFrame:
    return _out(pat.pullback(bars(spark, sf)), "pullback")


@query("support_resistance")
def support_resistance(spark: SparkSession, sf: str) -> DataFrame:
    names = (f"{side}{x}" for side in ("resistance", "support") for x in ("", "_touches", "_recency"))
    return _out(cross.clustered_levels(pat.swings(bars(spark, sf))), *names)


# cross-series

_BM = ", bench as (select session, avg(close) as bclose from bars group by session), j as (select b.*, bclose from bars b join bench using (session)), r as (select *, close / nullif(lag(close) over s, 0) - 1 as ret, bclose / nullif(lag(bclose) over s, 0) - 1 as bret from j #WINDOWS)"


@query("beta_corr", _sql({"beta": "case when count(case when bret is not null then ret end) over w60 >= 2 and row_number() over s >= 60 and var_samp(case when ret is not null then bret end) over w60 > 0 then covar_samp(ret, bret) over w60 / var_samp(case when ret is not null then bret end) over w60 end"}, _BM, "r"))
def beta_corr(spark: SparkSession, sf: str) -> DataFrame:
    return _out(cross.beta(bars(spark, sf)), "beta")


_CORR = "case when row_number() over s >= 60 and count(case when bret is not null then ret end) over w60 >= 2 and stddev_samp(case when bret is not null then ret end) over w60 > 0 and stddev_samp(case when ret is not null then bret end) over w60 > 0 then covar_samp(ret, bret) over w60 / (stddev_samp(case when bret is not null then ret end) over w60 * stddev_samp(case when ret is not null then bret end) over w60) end"


@query("correlation", _sql({"corr": _CORR}, _BM, "r"))
def correlation(spark: SparkSession, sf: str) -> DataFrame:
    return _out(cross.correlation(bars(spark, sf)), "corr")


_RS = _BM + ", rl as (select *, (1 + ret) / nullif(1 + bret, 0) as rs_line from r), rw as (select *, (rs_line - lag(rs_line, 20) over s) / 20 as rs_slope, list_filter(list(rs_line) over w20, lambda v: v is not null) as l from rl #WINDOWS)"
_RSP = "case when len(l) >= 20 then len(list_filter(l, lambda v: v <= rs_line)) / len(l) end"


@query("relative_strength", _sql({"rs_line": "rs_line", "rs_slope": "rs_slope", "rs_percentile": _RSP}, _RS, "rw"))
def relative_strength(spark: SparkSession, sf: str) -> DataFrame:
    return _out(cross.strength(bars(spark, sf)), "rs_line", "rs_slope", "rs_percentile")


@query("relative_strength_score", _sql({"rs_score": f"({_RSP}) * 100"}, _RS, "rw"))
def relative_strength_score(spark: SparkSession, sf: str) -> DataFrame:
    return _out(cross.strength(bars(spark, sf)), "rs_score")


@query("sector_strength", f"with {BARS}, {SECURITIES}, sc as (select sector, session, avg(close) as close from bars join securities using (symbol) group by all), cal as (select session, row_number() over (order by session) as day from (select distinct session from sc)), dense as (select x.sector, cal.session, day, sc.close from (select distinct sector from sc) x cross join cal left join sc on sc.sector = x.sector and sc.session = cal.session), ln as (select *, close / nullif(lag(close) over (partition by sector order by day), 0) as line from dense), wn as (select *, list_filter(list(line) over (partition by sector order by day rows between 19 preceding and current row), lambda v: v is not null) as l from ln) select sector, cast(session as varchar) as session, round_even(case when line is not null then len(list_filter(l, lambda v: v <= line)) / len(l) end + 3e-8, 6) + 0.0 as strength from wn where close is not null")
def sector_strength(spark: SparkSession, sf: str) -> DataFrame:
    """A day's move of each sector by rank in its own last 20 calendar days."""
    s = cross.sector_strength(bars(spark, sf), securities(spark, sf))
    return s.select("sector", F.col("session").cast("string").alias("session"), rounded("strength").alias("strength"))


_BR = f", m as (select *, {_full('avg', 'close', 'w50', 50)} as ma from bars #WINDOWS)"
_WB = "window w50 as (partition by symbol order by session rows between 49 preceding and current row)"


@query("breadth", f"with {BARS}{_BR.replace('#WINDOWS', _WB)} select cast(session as varchar) as session, count(ma) as members, round_even(coalesce(avg(case when ma is not null then cast(close > ma as int) end), 0.5) + 3e-8, 6) as breadth from m group by session")
def breadth(spark: SparkSession, sf: str) -> DataFrame:
    return cross.breadth(bars(spark, sf)).select(F.col("session").cast("string").alias("session"), "members", rounded("breadth").alias("breadth"))


_RG = f"""with {BARS}{_BR.replace('#WINDOWS', _WB)}, br as (select session, coalesce(avg(case when ma is not null then cast(close > ma as int) end), 0.5) as breadth, avg(close) as bclose from m group by session),
r as (select *, ln(bclose / lag(bclose) over (order by session)) as lr, avg(bclose) over (order by session rows between 19 preceding and current row) as m20, avg(bclose) over (order by session rows between 49 preceding and current row) as m50, avg(bclose) over (order by session rows between 199 preceding and current row) as m200 from br),
v as (select *, case when count(lr) over w >= 20 then stddev_samp(lr) over w end as vol from r window w as (order by session rows between 19 preceding and current row)),
p as (select *, list_filter(list(vol) over (order by session rows between 251 preceding and current row), lambda x: x is not null) as vols from v),
q as (select *, case when vol is not null then len(list_filter(vols, lambda x: x <= vol)) / len(vols) end as vp, 0.2 * (sign(bclose - m20) + sign(bclose - m50) + sign(bclose - m200)) as trend from p)
select cast(session as varchar) as session, round_even(trend + 3e-8, 6) as trend, round_even(breadth + 3e-8, 6) as breadth, round_even(vp + 3e-8, 6) as vol_percentile,
case when trend > 0.2 and breadth >= 0.55 then case when coalesce(vp < 0.8, false) then 'bull_quiet' else 'bull_volatile' end
     when trend < -0.2 and breadth <= 0.4 then case when coalesce(vp < 0.8, false) then 'bear_quiet' else 'bear_volatile' end else 'neutral' end as regime from q"""


@query("regime_series", _RG)
def regime_series(spark: SparkSession, sf: str) -> DataFrame:
    r = cross.regime(bars(spark, sf))
    return r.select(F.col("session").cast("string").alias("session"), rounded("trend").alias("trend"), rounded("breadth").alias("breadth"), rounded("vol_percentile").alias("vol_percentile"), "regime")


@query("breakout_scan", f"with {BARS}{_BO.replace('#WINDOWS', 'window s as (partition by symbol order by session), p20 as (partition by symbol order by session rows between 20 preceding and 1 preceding)')}, sc as (select symbol, cast(session as varchar) as session, round_even(100 * (close / level - 1) + volume / uv + 3e-8, 6) as score from bo2 where breakout), rk as (select *, row_number() over (partition by session order by score desc, symbol) as rank from sc) select symbol, session, score, rank from rk where rank <= 40")
def breakout_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Breakouts of each session, best first, at most 40 (the scan's candidate limit)."""
    b = pat.breakout(bars(spark, sf)).where("breakout")
    scored = b.select("symbol", F.col("session").cast("string").alias("session"), rounded(100 * (F.col("close") / F.col("level") - 1) + F.col("volume") / F.col("usual_volume")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "symbol"))).where("rank <= 40")

