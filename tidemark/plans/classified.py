"""Queries of the rule classifier: labels, tag, ensemble; SQL says the same by exploding words and joining the lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import classifier as cl
from tidemark.registry import query
from tidemark.sources.adapters import POSTS, posts

_r = lambda x, n: f"round_even({x} + 3e-8, 6) + 0.0 as {n}"
OPENERS = ("I bought calls", "Not very bullish here", "really strong quarter", "SELL SELL this", "maybe a breakout", "lmao crash soon?", "Giving up on it", "rumour of approval", "never been more bearish", "squeeze incoming")
MIDDLES = ("after the guidance beat", "slightly lower tomorrow", "to the MOON!!!", "yeah right", "with no downside", "short interest is huge", "")
ENDERS = ("and added more", "but the chart is weak?", "extremely bullish", "sold everything!", "not sure", "don't panic", "guaranteed upside!", "puts look better", "before the launch", "patent lawsuit rumour", "hold")


def composed() -> Column:
    """The text of a post: an opener, a middle and an ender, by its number."""
    pick = lambda xs, n: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("post_id") % n + 1).cast("int"))
    return F.concat_ws(" ", pick(OPENERS, 10), pick(MIDDLES, 7), pick(ENDERS, 11))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.when(F.col("post_id") % 4 == 0, "bullish").when(F.col("post_id") % 4 == 1, "bearish")
    return posts(spark, sf).select("post_id", "symbol", "session", composed().alias("text"), tag.alias("tag"))


_LEX = ", ".join(f"('{p}', '{k}', {w})" for k, phrases in cl.LEXICON.items() for p, w in phrases.items())
_MODS = "map {" + ", ".join(f"'{k}': {v}" for k, v in cl.MODIFIERS.items()) + "}"
_NEG = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in cl.NEGATORS) + "]"
_LABELS = tuple(k for k in cl.LEXICON if k not in ("bullish", "bearish"))
_RAW = {k: f"coalesce(sum(w * case when negated then 0.3 else 1.0 end) filter (label = '{k}'), 0.0)" for k in _LABELS}
_RAW["hype"] += " + any_value(least(1.0, caps / greatest(n, 1) * 2.0) + least(0.6, marks / greatest(length(text), 1) * 40.0))"
_RAW["uncertainty"] += " + any_value(least(1.0, 0.35 * asked))"
_RAW["pump_and_dump"] += f" + 0.3 * {_RAW['short_squeeze']}"
_SUM = lambda label, neg: f"coalesce(sum(w) filter (label = '{label}' and {'' if neg else 'not '}negated), 0.0)"
_list = lambda xs: str([x for x in xs])
SCORES = f"""{POSTS}, tx as (select post_id, symbol, session, concat_ws(' ', {_list(OPENERS)}[post_id % 10 + 1], {_list(MIDDLES)}[post_id % 7 + 1], {_list(ENDERS).replace('"', "'").replace("don't", "don''t")}[post_id % 11 + 1]) as text,
  case post_id % 4 when 0 then 'bullish' when 1 then 'bearish' end as tag from posts),
lexicon(phrase, label, weight) as (values {_LEX}),
tk as (select *, regexp_extract_all(lower(text), '[a-z0-9'']+') as t, length(text) - length(replace(text, '!', '')) as marks, length(text) - length(replace(text, '?', '')) as asked, len(regexp_extract_all(text, '\\b[A-Z]{{3,}}\\b')) as caps from tx),
ps as (select *, len(t) as n, unnest(range(1, len(t) + 1)) as i from tk),
ph as (select post_id, i, t, t[i] as phrase from ps union all select post_id, i, t, t[i] || ' ' || t[i + 1] from ps where i < n),
ht as (select post_id, label, weight * coalesce({_MODS}[list_filter(t[greatest(i - 3, 1):i - 1], lambda x: x in ({', '.join(f"'{k}'" for k in cl.MODIFIERS)}))[-1]], 1.0) as w, len(list_intersect(t[greatest(i - 3, 1):i - 1], {_NEG})) > 0 and i > 1 as negated from ph join lexicon using (phrase)),
sm as (select tk.post_id, any_value(tag) as tag, any_value(greatest(len(t), 1)) as n, greatest(0.0, {_SUM('bullish', False)} - 0.5 * {_SUM('bullish', True)} + 0.5 * {_SUM('bearish', True)}) as bullish, greatest(0.0, {_SUM('bearish', False)} - 0.5 * {_SUM('bearish', True)} + 0.5 * {_SUM('bullish', True)}) as bearish,
  {', '.join(f'{x} as {k}' for k, x in _RAW.items())}, count(*) filter (label in ({', '.join(f"'{k}'" for k in cl.EVIDENCE)})) as evidence from (select *, len(t) as n from tk) tk left join ht using (post_id) group by tk.post_id),
sq as (select post_id, tag, n, evidence, {', '.join(f'1.0 - exp(-{k} / 1.4) as {k}' for k in ('bullish', 'bearish', *_LABELS))}, 1.0 - exp(-(hype * 0.7) / 1.4) as fomo from sm),
sc as (select *, greatest(0.0, 1.0 - (bullish + bearish)) as neutral, least(0.97, greatest(0.05, least(1.0, greatest(0.25, 0.25 + 0.15 * (evidence + cast(bullish > 0 as int) + cast(bearish > 0 as int)))) * least(1.0, greatest(0.2, n / 6.0)) * greatest(0.25, 1.0 - 0.65 * sarcasm) * greatest(0.3, 1.0 - least(0.7, least(bullish, bearish) * 1.6)))) as confidence from sq)"""
_SHOWN = ("bullish", "bearish", "neutral", *_LABELS, "fomo", "confidence")


@query("classify_posts", f"with {SCORES} select post_id, {', '.join(_r(c, c) for c in _SHOWN)} from sc")
def classify_posts(spark: SparkSession, sf: str) -> DataFrame:
    return cl.classify(texts(spark, sf)).select("post_id", *(rounded(c).alias(c) for c in _SHOWN))


_TAGGED = f"""{SCORES}, ca as (select *, case when tag = 'bullish' then bullish else bearish end as agreeing, case when tag = 'bullish' then bearish else bullish end as opposing from sc),
cb as (select *, case when tag is null then 'none' when opposing > agreeing + 0.05 then 'conflict' when agreeing <= 0.05 and opposing <= 0.05 then 'silent' else 'agree' end as tag_case from ca),
cc as (select post_id, tag_case, case when tag_case = 'silent' then 0.45 when tag_case = 'agree' then least(1.0, agreeing + 0.1) else agreeing end as fresh, tag, bullish as b0, bearish as s0, neutral as n0,
  case tag_case when 'conflict' then confidence * 0.6 when 'silent' then greatest(confidence, 0.35) when 'agree' then least(0.97, confidence * 1.1) else confidence end as confidence, case when tag_case = 'conflict' then greatest(uncertainty, 0.5) else uncertainty end as uncertainty from cb),
tagged as (select post_id, tag_case, confidence, uncertainty, case when tag = 'bullish' then fresh else b0 end as bullish, case when tag = 'bearish' then fresh else s0 end as bearish, n0 from cc)"""


@query("author_tag", f"with {_TAGGED} select post_id, tag_case, {_r('bullish', 'bullish')}, {_r('bearish', 'bearish')}, {_r('''case when tag_case = 'none' then n0 else greatest(0.0, 1.0 - (bullish + bearish)) end''', 'neutral')}, {_r('uncertainty', 'uncertainty')}, {_r('confidence', 'confidence')} from tagged")
def author_tag(spark: SparkSession, sf: str) -> DataFrame:
    t = cl.with_tag(cl.classify(texts(spark, sf)))
    return t.select("post_id", "tag_case", *(rounded(c).alias(c) for c in ("bullish", "bearish", "neutral", "uncertainty", "confidence")))


@query("ensemble_blend", f"with {SCORES}, o as (select *, (post_id % 10) / 10.0 as other_bullish, (post_id % 8) / 10.0 as other_confidence, greatest(1e-6, confidence) as a from sc) select post_id, {_r('(bullish * a + other_bullish * other_confidence) / (a + other_confidence)', 'bullish')}, {_r('least(1.0, greatest(0.0, (a * a + other_confidence * other_confidence) / (a + other_confidence)))', 'confidence')} from o")
def ensemble_blend(spark: SparkSession, sf: str) -> DataFrame:
    o = cl.classify(texts(spark, sf)).withColumns({"other_bullish": (F.col("post_id") % 10) / 10.0, "other_confidence": (F.col("post_id") % 8) / 10.0})
    return o.select("post_id", rounded(cl.blend("bullish", "other_bullish", F.col("confidence"), F.col("other_confidence"))).alias("bullish"), rounded(cl.blended_confidence(F.col("confidence"), F.col("other_confidence"))).alias("confidence"))
