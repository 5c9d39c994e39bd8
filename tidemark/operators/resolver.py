"""Tickers in running text: cash-tags, company names, aliases and bare symbols, each with a confidence earned from its surroundings.

One Arrow step does it all, each text by itself: an Aho-Corasick automaton over all names and aliases runs once over its normal form,
whatever their number; bare symbols and cash-tags are looked up in a set; a name's first place is read from an index of the text's
words, so that no text is searched once a name. It returns the best place of each symbol with its confidence. One shuffle by id then
joins repeated rows of an id and counts the symbols of a text for the penalty of texts that name many.

The directory is broadcast, and so its size is checked: more than `limit` names are an error, never dropped.

Defined results: null and empty texts have no mentions; repeated rows of an id count as one text; a null id is kept as its own
group; of equally confident places of a symbol the first one counts, then the method's name; an empty directory finds nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate, compress

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words that say how a company is incorporated.
LEGAL = ("incorporated", "corporation", "corp", "inc", "ltd", "limited", "plc", "co", "company", "holdings", "holding", "group", "the")
#: Confidences of the four kinds of evidence, steps for the words around, penalties and limits.
CASHTAG, NAME, ALIAS, BARE, BARE_COMMON, COMMON_NAME = 0.92, 0.85, 0.80, 0.55, 0.12, 0.22
STEP, BARE_STEPS, NAME_STEPS, PENALTY, RUN_SHARE, MOST = 0.12, 3, 4, 0.12, 0.7, 12
CONTEXT, NEAR, TOKENS, RUN = 120, 60, 6, 4  # characters and tokens to either side
#: Words of people who write about shares, own and short; another list is a parameter.
TERMS = (
    "stock", "stocks", "share", "shares", "ticker", "earnings", "guidance", "revenue", "eps", "dividend", "calls", "puts", "call", "put", "option",
    "options", "strike", "expiry", "bullish", "bearish", "long", "short", "shorts", "squeeze", "breakout", "support", "resistance", "chart", "price",
    "target", "upgrade", "downgrade", "analyst", "buy", "buying", "bought", "sell", "selling", "sold", "holding", "position", "portfolio", "market",
    "float", "volume", "rally", "dip", "quarter", "ipo", "buyback", "valuation", "trade", "trading", "trader", "investor", "invest",
)
SCHEMA = "id string, symbol string, method string, matched string, at int, context string, confidence double"
_WORDS, _CASH, _BARE = re.compile(r"\w+"), re.compile(r"\$([A-Za-z]{1,6})\b"), re.compile(r"[A-Z]{1,5}")
_LEGAL = frozenset(LEGAL)
_SENTENCE, _EDGE = re.compile(r"[.!?]\s+"), ".,;:!?()[]'\""


class Letters(dict):
    """A table for str.translate that makes blanks of all but some letters."""

    def __init__(self, keep):
        self.keep = keep

    def __missing__(self, code: int) -> int:
        self[code] = code if self.keep(chr(code)) else 32
        return self[code]


_ANY, _LATIN = Letters(lambda c: c.isalnum() or c == "_"), Letters(lambda c: c == "'" or (c.isascii() and c.isalpha()))


def _cut(text: str, letters: Letters) -> tuple[list[str], list[int]]:
    """Words and where they start."""
    pieces = text.translate(letters).split(" ")  # every other letter is one blank, so places follow from lengths
    starts = accumulate([len(x) + 1 for x in pieces], initial=0)
    return list(filter(None, pieces)), list(compress(starts, pieces))


def normal(text: str) -> str:
    """Without case, legal suffixes, marks and runs of white space."""
    plain = text.casefold()
    words = plain.translate(_ANY).split()
    return " ".join([w for w in words if w.replace("ı", "i") not in _LEGAL] if "ı" in plain else [w for w in words if w not in _LEGAL])


def _same(c: str) -> str:
    """One letter for all that a search without case takes for the same."""
    up = c.upper()
    return "i" if c == "İ" else up.lower() if len(up) == 1 else c.lower()


@cache
def _odd() -> tuple[re.Pattern, dict[int, str]]:
    """Letters whose lower case is not the one of _same(), and what they stand for; no letter beyond the first two planes has a case."""
    found = {k: _same(chr(k)) for k in range(0x20000) if chr(k).lower() != _same(chr(k)) or chr(k) == "Σ"}  # at the end of a word Σ has another lower case
    return re.compile(f"[{''.join(map(chr, found))}]"), found


def folded(text: str) -> str:
    """The text letter by letter without case, as a search without case sees it: of the same length."""
    if text.isascii():
        return text.lower()
    odd, found = _odd()
    return (text.translate(found) if odd.search(text) else text).lower()


@dataclass
class Directory:
    """What can be found: symbols, which of them (and of the one-word names) are common words, and names by their normal form."""

    symbols: set[str]
    common: set[str]
    names: dict[str, list[tuple[str, str]]]  # normal form: symbol and method

    @staticmethod
    def of(listings: DataFrame, common: DataFrame, limit: int = 200_000) -> Directory:
        """listings(symbol, name, aliases) and common(word): a form belongs to its first symbol in order, names before aliases."""
        listed = listings.select("symbol", "name", "aliases").orderBy("symbol").limit(limit + 1).collect()
        words = common.select(F.upper("word").alias("word")).where("word is not null").distinct().limit(limit + 1).collect()
        if max(len(listed), len(words)) > limit:
            raise ValueError(f"a directory of more than {limit} names or words can't be broadcast")
        out = Directory({r["symbol"] for r in listed}, {r["word"] for r in words}, {})
        for method in ("company_name", "alias"):
            for r in listed:
                given = [r["name"]] if method == "company_name" else [*(r["aliases"] or []), *([] if out.is_common(r["symbol"]) else [r["symbol"]])]
                for form in map(normal, filter(None, given)):
                    if len(form) >= 2 and form not in out.names:
                        out.names[form] = [(r["symbol"], method)]
        return out

    def is_common(self, word: str) -> bool:
        return len(word) <= 1 or word.upper() in self.common

    def doubtful(self) -> set[str]:
        """Forms of one word that is common."""
        return {form for form in self.names if " " not in form and self.is_common(form)}

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for form, owners in self.names.items():
            found.add_word(f" {form} ", form)
        found.make_automaton()
        return found


class Known(dict):
    """What a function says of each word, worked out once; emptied when it has grown large."""

    def __init__(self, say, most: int = 500_000):
        self.say, self.most = say, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = said = self.say(word)
        return said


class Finder:
    """What is worked out once for all texts of a task."""

    def __init__(self, directory: Directory, terms: tuple[str, ...]):
        self.known, self.found, known = directory, directory.automaton(), frozenset(terms)
        self.doubtful, self.folds = directory.doubtful(), {form: folded(form) for form in directory.names}
        self.bare = {s: not directory.is_common(s) for s in directory.symbols if s and _BARE.fullmatch(s)}

        def term(word: str) -> str | None:
            return word if word in known else None

        self.edged, self.cased, self.lower = Known(lambda w: term(w.strip(_EDGE).lower())), Known(lambda w: term(w.casefold())), Known(str.islower)

    def _near(self, text: str, start: int, end: int) -> int:
        """Different terms among the words within NEAR characters, without marks at their edges."""
        found = {self.edged[w] for w in text[max(0, start - NEAR) : end + NEAR].split()}
        return len(found) - (None in found)

    def places(self, text: str) -> Iterator[tuple]:
        """symbol, method, matched, start, end, confidence of each place; an end of -1 where a name stands in the normal form only."""
        for m in _CASH.finditer(text):
            symbol = m[1].upper()
            if symbol in self.known.symbols:
                doubtful = m[1] != symbol and self.known.is_common(symbol)
                yield symbol, "cashtag", m[0], *m.span(), min(CASHTAG, BARE + STEP * min(self._near(text, *m.span()), NAME_STEPS)) if doubtful else CASHTAG
        yield from self._names(text)
        yield from self._symbols(text)

    def _names(self, text: str) -> Iterator[tuple]:
        forms = dict.fromkeys(form for _, form in self.found.iter(f" {normal(text)} ")) if self.known.names else {}
        if not forms:
            return
        plain = folded(text)
        words, starts = _cut(plain, _ANY)
        first = dict(zip(reversed(words), reversed(starts), strict=True))
        for form in forms:
            sought = self.folds[form]
            start, end = 0, -1
            if " " in sought:
                at = plain.find(sought)
                while at >= 0 and ((at and _WORDS.match(plain, at - 1)) or _WORDS.match(plain, at + len(sought))):
                    at = plain.find(sought, at + 1)
                if at >= 0:
                    start, end = at, at + len(sought)
            elif sought in first:
                start = first[sought]
                end = start + len(sought)
            for symbol, method in self.known.names[form]:
                if form in self.doubtful:
                    yield symbol, method, form, start, end, COMMON_NAME + STEP * min(self._near(text, start, end) if end >= 0 else 0, NAME_STEPS)
                else:
                    yield symbol, method, form, start, end, NAME if method == "company_name" else ALIAS

    def _symbols(self, text: str) -> Iterator[tuple]:
        words, starts = _cut(text, _LATIN)
        at = [i for i, w in enumerate(words) if w in self.bare]
        if not at:
            return
        opening = {m.end() for m in _SENTENCE.finditer(text)}
        cased, n = [self.cased[w] for w in words], len(words)
        said, lower = [i for i, w in enumerate(cased) if w], [0, *accumulate([self.lower[w] for w in words])]
        for i in at:
            start = starts[i]
            near = said[bisect_left(said, i - TOKENS) : bisect_left(said, i + TOKENS + 1)]
            c = BARE if self.bare[words[i]] else BARE_COMMON
            c += STEP * min(len({cased[k] for k in near if k != i}), BARE_STEPS) if near else 0.0
            c -= PENALTY if i == 0 or start in opening or start - 1 in opening or start + 1 in opening else 0.0
            lo, hi = max(0, i - RUN), min(n, i + RUN + 1)
            c -= PENALTY if hi - lo > 1 and (lower[hi] - lower[i + 1] + lower[i] - lower[lo]) / (hi - lo - 1) >= RUN_SHARE else 0.0
            yield words[i], "symbol_context", words[i], start, start + len(words[i]), c

    def best(self, text: str, digest: bool = False) -> Iterator[tuple]:
        """symbol, method, matched, at, context, confidence of each symbol's best place."""
        best: dict[str, tuple] = {}
        for symbol, method, matched, start, end, c in self.places(text):
            old = best.get(symbol)
            if old is None or max(c, 0.0) > old[0][0] - 1e-6:  # else the rounded one can't be larger
                key = (max(0.0, min(1.0, round(c, 6))), -start, method)
                if old is None or key >= old[0]:
                    best[symbol] = key, matched, end
        whole = None
        for symbol, ((confidence, at, method), matched, end) in best.items():
            if end < 0:
                context = whole = whole or (_digest(text) if digest else text)
            else:
                context = text[max(0, -at - CONTEXT) : end + CONTEXT]
                context = _digest(context) if digest else context
            yield symbol, method, matched, -at, context, confidence


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def hits(texts: DataFrame, directory: Directory, terms: tuple[str, ...] = TERMS, digest: bool = False) -> DataFrame:
    """The best place of each symbol in each row of texts(id, text); with `digest` the SHA-256 of its context."""
    shared = texts.sparkSession.sparkContext.broadcast(directory)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value, terms)
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += ((key, *x) for x in finder.best(text or "", digest))
                if len(rows) > 2000:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return texts.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, SCHEMA)


def resolve(texts: DataFrame, directory: Directory, terms: tuple[str, ...] = TERMS, most: int = MOST, digest: bool = False) -> DataFrame:
    """id, symbol, method, matched, context, confidence: each text's best place of each symbol. Where a text names more than `most`
    symbols its bare ones count for less, in proportion. With `digest` a context is given by its SHA-256."""
    best = F.max_by(F.struct("method", "matched", "context"), F.struct("confidence", -F.col("at"), "method"))
    one = hits(texts, directory, terms, digest).repartition("id").groupBy("id", "symbol").agg(best.alias("x"), F.max("confidence").alias("confidence")).select("id", "symbol", "x.*", "confidence")
    named = F.count("*").over(Window.partitionBy("id"))
    bare = (F.col("method") == "symbol_context") & (F.col("named") > most)
    return one.withColumn("named", named).withColumn("confidence", F.when(bare, F.round(F.col("confidence") * most / F.col("named"), 6)).otherwise(F.col("confidence"))).drop("named")
