"""Ticker resolution against loops over every name of every text."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import resolver
from tidemark.plans import tickers

LISTED = [
    ("AAPL", "Apple Inc.", ["Cupertino giant"]), ("COST", "Costco Wholesale Corp", None), ("ARM", "Arm Holdings plc", []), ("IMO", "Imperial Oil Ltd", ["Imperial"]),
    ("ZZZT", "The Zest Company", ["zest foods", "AAPL"]), ("QQ", None, None), ("DD", "DuPont", ["Du Pont"]), ("X", "U.S. Steel Corp", None),
]
COMMON = ["cost", "arm", "imo", "apple", "target", "an", "dd"]
TEXTS = [
    None, "", "$AAPL to the moon", "$cost of living", "I sold $cost calls, shares and stock at the strike price", "cost an ARM and a leg",
    "ARM earnings beat, buying calls and shares here", "the apple fell", "Apple crushed earnings, bought calls on the stock today", "IMO this market is overheated",
    "ZZZT looks good. ZZZT again", "zzzt looks good", "Zest foods, and ZEST-FOODS again", "u.s. steel! X marks", "DD", "DuPont, du pont and DD stock",
    " ".join(f"{s} said" for s, _, _ in LISTED) + " " + " ".join(f"Q{c} QQ" for c in "ABCDEFG"), "don't X'S ARM's QQ's", "a\nCOST\nb. IMO? ok! COST shares", "cupertino giant $QQ $qq $ZZZTT",
]


def plain(listed, common, terms, text, most=12):
    """Best mention of each symbol, found by trying every name."""
    is_common = lambda s: len(s) <= 1 or s.lower() in common
    forms = {}
    for method in ("company_name", "alias"):
        for symbol, name, aliases in sorted(listed, key=lambda r: r[0]):
            given = [name] if method == "company_name" else [*(aliases or []), *([] if is_common(symbol) else [symbol])]
            for g in given:
                form = resolver.normal(g or "")
                if len(form) >= 2:
                    forms.setdefault(form, (symbol, method))
    symbols, best = {s for s, _, _ in listed}, {}

    def offer(symbol, confidence, method, at):
        key = (round(max(0.0, min(1.0, confidence)), 6), -at, method)
        best[symbol] = max(best.get(symbol, key), key)

    def near(a, b):
        return len({w.strip(".,;:!?()[]'\"").lower() for w in text[max(0, a - 60) : b + 60].split()} & set(terms))

    for m in re.finditer(r"\$([A-Za-z]{1,6})\b", text):
        s = m[1].upper()
        if s in symbols:
            offer(s, min(0.92, 0.55 + 0.12 * min(4, near(*m.span()))) if m[1] != s and is_common(s) else 0.92, "cashtag", m.start())
    for form, (s, method) in forms.items():
        if f" {form} " in f" {resolver.normal(text)} ":
            m = re.search(rf"\b{re.escape(form)}\b", text, re.I)
            if " " not in form and is_common(form):
                offer(s, 0.22 + (0.12 * min(4, near(*m.span())) if m else 0), method, m.start() if m else 0)
            else:
                offer(s, 0.85 if method == "company_name" else 0.8, method, m.start() if m else 0)
    tokens = list(re.finditer(r"[A-Za-z']+", text))
    for i, m in enumerate(tokens):
        if m[0] in symbols:
            others = [t[0] for k, t in enumerate(tokens) if k != i and abs(k - i) <= 6]
            run = [t[0].islower() for k, t in enumerate(tokens) if k != i and abs(k - i) <= 4]
            c = (0.12 if is_common(m[0]) else 0.55) + 0.12 * min(3, len({o.lower() for o in others} & set(terms)))
            c -= 0.12 * (i == 0 or any(abs(m.start() - e.end()) <= 1 for e in re.finditer(r"[.!?]\s+", text)))
            c -= 0.12 * bool(run and sum(run) / len(run) >= 0.7)
            offer(m[0], c, "symbol_context", m.start())
    cut = most / len(best) if len(best) > most else 1
    return {(s, method, round(c * (cut if method == "symbol_context" else 1), 6)) for s, (c, _, method) in best.items()}


def directory(spark):
    d = spark.createDataFrame(LISTED, "symbol string, name string, aliases array<string>")
    return resolver.Directory.of(d, spark.createDataFrame([(w,) for w in COMMON], "word string"))


@pytest.mark.parametrize("most", [12, 3])
def test_equals_loops(spark, most):
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)] + [(None, "$AAPL"), ("2", TEXTS[2])], "id string, text string")
    got = {}
    for r in resolver.resolve(texts, directory(spark), most=most).collect():
        got.setdefault(r["id"], set()).add((r["symbol"], r["method"], r["confidence"]))
    assert got.pop(None) == {("AAPL", "cashtag", 0.92)}
    want = {str(i): plain(LISTED, COMMON, resolver.TERMS, t or "", most) for i, t in enumerate(TEXTS)}
    assert got == {k: v for k, v in want.items() if v}
    assert got["2"] == {("AAPL", "cashtag", 0.92)} and not {m for m in got["5"] if m[2] >= 0.35} and max(m[2] for m in got["6"]) > 0.35


def test_contexts_hold_the_place(spark):
    text = "x" * 500 + " Apple shares " + "y" * 500
    r = resolver.resolve(spark.createDataFrame([("1", text)], "id string, text string"), directory(spark)).collect()
    assert [m["symbol"] for m in r] == ["AAPL"] and "Apple shares" in r[0]["context"] and len(r[0]["context"]) < 260


def test_large_directories_are_refused(spark):
    d = spark.range(11).select(F.concat(F.lit("A"), "id").alias("symbol"), F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("aliases"))
    with pytest.raises(ValueError, match="more than 10"):
        resolver.Directory.of(d, spark.createDataFrame([], "word string"), limit=10)
    empty = resolver.Directory.of(d.limit(0), spark.createDataFrame([], "word string"))
    assert resolver.resolve(spark.createDataFrame([("1", "A1 $A2 a3")], "id string, text string"), empty).count() == 0


def test_query_equals_loops(spark, sf):
    listed, common = (x.collect() for x in tickers.listings(spark, sf))
    texts = {r["id"]: r["text"] or "" for r in tickers.commentary(spark, sf).collect()}
    got = {}
    for r in tickers.ticker_mentions(spark, sf).collect():
        got.setdefault(r["id"], set()).add((r["symbol"], r["method"], r["confidence"]))
    terms = resolver.TERMS + ("tion", "ent", "ing", "der", "que", "los")
    few = dict(sorted(((k, t) for k, t in texts.items() if len(t) < 3000), key=lambda x: x[0])[:80])
    want = {k: {m for m in plain([tuple(r) for r in listed], {r[0] for r in common}, terms, t) if m[2] >= tickers.LEAST} for k, t in few.items()}
    assert {k: v for k, v in got.items() if k in few} == {k: v for k, v in want.items() if v}
    assert {m for v in got.values() for _, m, _ in v} == {"cashtag", "company_name", "alias", "symbol_context"}


def test_one_row_for_each_symbol_of_a_text(spark):
    text = "$AAPL up. " * 200 + "zest, foods " * 200 + "ARM said ZZZT " * 200
    rows = resolver.hits(spark.createDataFrame([("1", text)], "id string, text string"), directory(spark)).collect()
    assert sorted(r["symbol"] for r in rows) == ["AAPL", "ARM", "ZZZT"]
    whole = {r["symbol"]: r["context"] for r in resolver.resolve(spark.createDataFrame([("1", "zest, foods")], "id string, text string"), directory(spark), digest=True).collect()}
    assert whole == {"ZZZT": hashlib.sha256(b"zest, foods").hexdigest()}


def test_folding_is_that_of_a_search_without_case():
    cased = "".join(chr(k) for k in range(0x20000) if not 0xD800 <= k < 0xE000 and (chr(k).lower() != chr(k) or chr(k).upper() != chr(k)))
    same = {}
    for c in cased:
        same.setdefault(resolver.folded(c), set()).add(c)
    assert len(resolver.folded(cased)) == len(cased)
    assert all(set(re.findall(re.escape(one), cased, re.IGNORECASE)) == those for one, those in same.items() if one == one.casefold())
