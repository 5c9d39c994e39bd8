"""Text functions as JVM-side column expressions; only HTML entities and NFKC need an Arrow function."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that try to instruct a model.
INJECTION = r"(?i)(ignore (all |any )?(previous|prior) instructions|system prompt|you are now|disregard the above|act as an? )"
PLACEHOLDERS = ((r"https?://\S+", "[url]"), (r"[\w.+-]+@[\w-]+\.[\w.]+", "[email]"), (r"\+?\d[\d ()-]{7,}\d", "[phone]"), (r"@\w{2,}", "[user]"))
#: Words that say how a company is incorporated.
LEGAL = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "llc", "holdings", "group", "sa", "ag", "nv")
POSITIVE = ("good", "great", "strong", "gain", "bull", "up", "win", "beat", "rally")
NEGATIVE = ("bad", "weak", "loss", "bear", "down", "miss", "crash", "scam", "worthless", "idiot")


def strip_controls(x: Column) -> Column:
    return F.regexp_replace(x, r"[\p{Cf}\p{Cc}&&[^\n\t]]", "")


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "[ \\t\\n\\x0B\\f\\r]+", " "))


def placeholders(x: Column) -> Column:
    for pattern, name in PLACEHOLDERS:
        x = F.regexp_replace(x, pattern, name)
    return x


def injection_risk(x: Column) -> Column:
    hits = F.regexp_count(x, F.lit(INJECTION))
    return F.when(hits == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.4 + 0.2 * hits))


def text_hash(x: Column) -> Column:
    return F.sha2(F.lower(squeeze(x)), 256)


def pseudonym(x: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), F.lower(F.trim(x))), 256), 1, 32)


def export_safe(x: Column) -> Column:
    """Cells that a spreadsheet would take for a formula get a leading quote."""
    return F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def truncate(x: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - len(suffix)), F.lit(suffix))).otherwise(x)


def company_name(x: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*LEGAL)), " ")


def sanitise(rows: DataFrame, column: str, limit: int = 4000) -> DataFrame:
    """Entities, NFKC, controls, placeholders, instruction phrases, white space, length, in this order."""

    @F.pandas_udf("string")
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t)) if isinstance(t, str) else None)

    clean = placeholders(strip_controls(F.col("plain")))
    clean = F.regexp_replace(clean, INJECTION, "[filtered]")
    return rows.withColumn("plain", unescape(column)).withColumn("clean", truncate(squeeze(clean), limit)).drop("plain")


def lexicon_score(words: Column) -> Column:
    """(positive - negative) / (positive + negative) words; a negator right before a word turns it."""
    negators = F.array(*(F.lit(w) for w in ("not", "no", "never")))

    def value(w: Column, i: Column) -> Column:
        v = F.when(w.isin(*POSITIVE), 1.0).when(w.isin(*NEGATIVE), -1.0).otherwise(0.0)
        before = F.when(i > 0, F.element_at(words, F.greatest(i, F.lit(1)))).otherwise("")
        return F.when(F.array_contains(negators, before), -v).otherwise(v)

    values = F.transform(words, value)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    size = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v))
    return F.when(size > 0, total / size).otherwise(0.0)
