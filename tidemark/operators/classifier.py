"""Rule classifier of posts: lexicon hits with negation and modifiers, squashed labels, confidence; author's tag; ensemble blend.

Row-wise over the array of a text's words: no shuffle, no Python. A lexicon is a literal map of phrases of one or two words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp

#: Our own word lists: label, then phrase and weight.
LEXICON = {
    "bullish": {"bullish": 1.0, "buy": 0.6, "long": 0.5, "breakout": 0.7, "upside": 0.7, "strong": 0.5, "beat": 0.6, "upgrade": 0.8, "added more": 0.8, "higher": 0.4},
    "bearish": {"bearish": 1.0, "sell": 0.6, "short": 0.5, "breakdown": 0.7, "downside": 0.7, "weak": 0.5, "miss": 0.6, "downgrade": 0.8, "got out": 0.8, "lower": 0.4},
    "hype": {"moon": 1.0, "rocket": 0.9, "insane": 0.6, "huge": 0.5},
    "fear": {"crash": 0.9, "panic": 0.9, "scared": 0.7},
    "capitulation": {"giving up": 1.0, "sold everything": 1.0, "done with": 0.8},
    "uncertainty": {"maybe": 0.5, "not sure": 0.7, "might": 0.4, "possibly": 0.4},
    "sarcasm": {"yeah right": 1.0, "lmao": 0.6, "sure buddy": 0.9},
    "earnings_speculation": {"earnings": 0.6, "guidance": 0.6, "quarter": 0.4},
    "product_catalyst": {"launch": 0.6, "product": 0.4, "patent": 0.6},
    "regulatory_catalyst": {"approval": 0.8, "lawsuit": 0.7, "regulator": 0.6},
    "rumour": {"rumour": 0.9, "heard that": 0.7, "supposedly": 0.6},
    "short_squeeze": {"squeeze": 0.9, "short interest": 0.8},
    "pump_and_dump": {"get in": 0.6, "guaranteed": 1.0},
    "position_disclosure": {"i bought": 0.8, "my position": 0.8},
    "options_call": {"calls": 0.7},
    "options_put": {"puts": 0.7},
}
NEGATORS = ("not", "never", "no", "isn't", "don't", "without")
MODIFIERS = {"very": 1.5, "really": 1.4, "extremely": 1.8, "slightly": 0.5, "somewhat": 0.6}
SQUASH, LOOK_BACK = 1.4, 3
EVIDENCE = ("hype", "fear", "capitulation", "uncertainty", "sarcasm", "pump_and_dump")
#: Tag rules: silence below, weight and least confidence on silence, gain on agreement, loss on conflict.
SILENCE, TAG_WEIGHT, TAG_CONFIDENCE, AGREE_BUMP, AGREE_GAIN, CONFLICT_LOSS, CONFLICT_UNCERTAINTY = 0.05, 0.45, 0.35, 0.10, 1.10, 0.6, 0.5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), 1)


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def hits(tokens: Column) -> Column:
    """All lexicon phrases of a text: label, weight after its nearest modifier, whether negated within LOOK_BACK words."""
    label = _map({p: k for k, phrases in LEXICON.items() for p in phrases})
    weight = _map({p: w for phrases in LEXICON.values() for p, w in phrases.items()})
    modifier = _map(MODIFIERS)

    def at(i: Column, n: int) -> Column:
        phrase = F.array_join(F.slice(tokens, i, n), " ")
        before = F.slice(tokens, F.greatest(i - LOOK_BACK, F.lit(1)), F.least(i - 1, F.lit(LOOK_BACK)))
        near = F.get(F.reverse(F.filter(before, lambda t: t.isin(*MODIFIERS))), F.lit(0))
        ok = (F.size(tokens) >= i + n - 1) & F.map_contains_key(label, phrase)
        return F.when(ok, F.struct(F.try_element_at(label, phrase).alias("label"), (F.try_element_at(weight, phrase) * F.coalesce(F.try_element_at(modifier, near), F.lit(1.0))).alias("w"), F.exists(before, lambda t: t.isin(*NEGATORS)).alias("negated")))

    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.array().cast("array<int>"))
    found = F.concat(F.transform(places, lambda i: at(i, 1)), F.transform(places, lambda i: at(i, 2)))
    return F.filter(found, lambda h: h.isNotNull())


def squash(x: Column) -> Column:
    return 1.0 - F.exp(-x / SQUASH)


def classify(posts: DataFrame) -> DataFrame:
    """posts(text, ...) with a column for each label, neutral, fomo and confidence."""
    p = posts.withColumn("_words", words(F.col("text"))).withColumn("_hits", hits(F.col("_words")))

    def total(of: str, factor: float = 1.0, negated: bool | None = None, damp: float = 0.3) -> Column:
        chosen = F.filter("_hits", lambda h: (h["label"] == of) if negated is None else (h["label"] == of) & (h["negated"] == negated))
        return F.aggregate(chosen, F.lit(0.0), lambda a, h: a + h["w"] * (F.when(h["negated"], damp).otherwise(1.0) if negated is None else F.lit(factor)))

    up, up_not, down, down_not = total("bullish", negated=False), total("bullish", negated=True), total("bearish", negated=False), total("bearish", negated=True)
    bullish = F.greatest(F.lit(0.0), up - 0.5 * up_not + 0.5 * down_not)
    bearish = F.greatest(F.lit(0.0), down - 0.5 * down_not + 0.5 * up_not)
    marks, size = F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit(""))), F.greatest(F.length("text"), F.lit(1))
    asked = F.length("text") - F.length(F.replace("text", F.lit("?"), F.lit("")))
    count = F.greatest(F.size("_words"), F.lit(1))
    caps = F.regexp_count("text", F.lit(r"\b[A-Z]{3,}\b"))
    raw = {k: total(k) for k in LEXICON if k not in ("bullish", "bearish")}
    raw["hype"] = raw["hype"] + F.least(F.lit(1.0), caps / count * 2.0) + F.least(F.lit(0.6), marks / size * 40.0)
    raw["uncertainty"] = raw["uncertainty"] + F.least(F.lit(1.0), 0.35 * asked)
    raw["pump_and_dump"] = raw["pump_and_dump"] + 0.3 * raw["short_squeeze"]
    out = p.withColumns({"bullish": squash(bullish), "bearish": squash(bearish), **{k: squash(x) for k, x in raw.items()}, "fomo": squash(raw["hype"] * 0.7)})
    out = out.withColumn("neutral", F.greatest(F.lit(0.0), 1.0 - (F.col("bullish") + F.col("bearish"))))
    evidence = F.size(F.filter("_hits", lambda h: h["label"].isin(*EVIDENCE))) + (F.col("bullish") > 0).cast("int") + (F.col("bearish") > 0).cast("int")
    length = clamp(count / 6.0, 0.2, 1.0)
    conflict = F.greatest(F.lit(0.3), 1.0 - F.least(F.lit(0.7), F.least("bullish", "bearish") * 1.6))
    confidence = clamp(0.25 + 0.15 * evidence, 0.25, 1.0) * length * F.greatest(F.lit(0.25), 1.0 - 0.65 * F.col("sarcasm")) * conflict
    return out.withColumn("confidence", clamp(confidence, 0.05, 0.97)).drop("_words", "_hits")


def with_tag(scores: DataFrame, tag: str = "tag") -> DataFrame:
    """The author's own direction: it speaks where the text is silent, adds a little where they agree, and only lowers confidence
    where they differ."""
    up = F.col(tag) == "bullish"
    agreeing, opposing = F.when(up, F.col("bullish")).otherwise(F.col("bearish")), F.when(up, F.col("bearish")).otherwise(F.col("bullish"))
    case = F.when(F.col(tag).isNull() | ~F.col(tag).isin("bullish", "bearish"), "none").when(opposing > agreeing + SILENCE, "conflict").when((agreeing <= SILENCE) & (opposing <= SILENCE), "silent").otherwise("agree")
    s = scores.withColumn("_case", case).withColumn("_new", F.when(F.col("_case") == "silent", TAG_WEIGHT).when(F.col("_case") == "agree", F.least(F.lit(1.0), agreeing + AGREE_BUMP)).otherwise(agreeing))
    confidence = F.when(F.col("_case") == "conflict", F.col("confidence") * CONFLICT_LOSS).when(F.col("_case") == "silent", F.greatest("confidence", F.lit(TAG_CONFIDENCE))).when(F.col("_case") == "agree", F.least(F.lit(0.97), F.col("confidence") * AGREE_GAIN)).otherwise(F.col("confidence"))
    s = s.withColumns({"confidence": confidence, "uncertainty": F.when(F.col("_case") == "conflict", F.greatest("uncertainty", F.lit(CONFLICT_UNCERTAINTY))).otherwise(F.col("uncertainty")), "bullish": F.when((F.col("_case") != "none") & up, F.col("_new")).otherwise(F.col("bullish")), "bearish": F.when((F.col("_case") != "none") & ~up, F.col("_new")).otherwise(F.col("bearish"))})
    return s.withColumn("neutral", F.when(F.col("_case") == "none", F.col("neutral")).otherwise(F.greatest(F.lit(0.0), 1.0 - (F.col("bullish") + F.col("bearish"))))).withColumnRenamed("_case", "tag_case").drop("_new")


def blend(own: str, other: str, own_confidence: Column, other_confidence: Column) -> Column:
    """Mean of two readings, weighted by their confidence."""
    a, b = F.greatest(F.lit(1e-6), own_confidence), F.greatest(F.lit(0.0), other_confidence)
    return (F.col(own) * a + F.col(other) * b) / (a + b)


def blended_confidence(own: Column, other: Column) -> Column:
    a, b = F.greatest(F.lit(1e-6), own), F.greatest(F.lit(0.0), other)
    return clamp((a * a + b * b) / (a + b), 0.0, 1.0)
