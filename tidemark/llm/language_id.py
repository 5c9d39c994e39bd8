"""Language ID by rank-order profiles of character n-grams.

A profile is the `top` most frequent grams of 1 to 3 letters, most frequent first, where a blank stands for
a word's edge. A text gets the language whose profile has the least out-of-place distance from its own:
the sum over the text's grams of the difference in rank, or `top` where the profile lacks the gram. The score
is 1 less that distance as a share of the greatest possible one.

The profiles are fitted on the labelled rows of the training folds, of which at most about `max_rows` are
taken, by a hash of doc_id (a documented bound for fitting a classifier). Every text is then judged whole.

Defined results: a null text or one without letters is `und` with score 0; ties go to the first language in
alphabetical order, equal counts to the smaller gram hash; a null doc_id stays null, is not used for training
and is not held out; without any training row every text is `und`; an empty table gives an empty result; only
the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._kernels import U64, mix, slices

TOP = 300
MAX_ROWS = 20_000
FOLDS = 5
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
LETTERS = 1 << 18  # code points counted at once
EDGE = 1  # a blank within a gram: no letter, and not 0, so that " e" is another gram than "e"
_alpha: np.ndarray | None = None


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _letter_table() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _alpha


def _grams(texts: list[str], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text << 44 | 44-bit gram hash) of some texts with their counts."""
    lowered = [x.lower() for x in texts]
    cp = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(doc, [len(x) + 1 for x in lowered])
    code = np.where(_letter_table()[cp], cp, 0).astype(U64)
    keep = np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))
    code, owner = code[keep], owner[keep]
    if code[0]:
        code, owner = np.concatenate((np.zeros(1, U64), code)), np.concatenate((owner[:1], owner))
    blank = code == 0
    code = np.where(blank, U64(EDGE), code)
    a, b, c = code[:-2], code[1:-1], code[2:]
    letter = ~blank
    tag = owner.astype(U64) << U64(44)
    parts = [(mix(code) >> U64(20) | tag)[letter]]
    two = ~(blank[:-1] & blank[1:])
    # a blank before a word belongs to the text before it: grams take the owner of their last letter
    own2 = np.where(blank[1:], tag[:-1], tag[1:])
    parts.append((mix(code[:-1] << U64(21) | code[1:]) >> U64(20) | own2)[two])
    if len(code) > 2:
        three = ~blank[1:-1]
        parts.append((mix(a << U64(42) | b << U64(21) | c) >> U64(20) | tag[1:-1])[three])
    key = np.sort(np.concatenate(parts))
    if not len(key):
        return key, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[at], np.diff(np.append(at, len(key)))


def gram_counts(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(lo, hi, text, gram, count) for runs of texts; a long text is counted piece by piece, cut at blanks."""
    lo, size = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (i > lo and size + len(texts[i]) > LETTERS):
            if i > lo:
                if i - lo == 1 and size > 2 * LETTERS:
                    yield lo, i, *_long(texts[lo])
                else:
                    key, n = _grams(texts[lo:i], np.arange(i - lo))
                    yield lo, i, (key >> U64(44)).astype(np.int64), key & U64((1 << 44) - 1), n
            lo, size = i, 0
        if i < len(texts):
            size += len(texts[i])


def _long(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gram, count, at = np.zeros(0, U64), np.zeros(0, np.int64), 0
    while at < len(text):
        end = at + LETTERS
        while end < len(text) and text[end].isalpha():
            end += 1
        key, n = _grams([text[at:end]], np.zeros(1, np.int64))
        gram, place = np.unique(np.concatenate((gram, key)), return_inverse=True)
        count = np.bincount(place, np.concatenate((count, n))).astype(np.int64)
        at = end
    return np.zeros(len(gram), np.int64), gram, count


def train(docs: DataFrame, top: int = TOP, max_rows: int = MAX_ROWS) -> dict[str, np.ndarray]:
    """For each language, its gram hashes by rank, from docs(doc_id, text, lang)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "lang", "text")
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}

        def rows_of(total: dict) -> pa.RecordBatch:
            parts = [(lang, *merged(x)) for lang, x in total.items()]
            return pa.record_batch(
                [pa.array(np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]).tolist(), pa.string()), pa.array(np.concatenate([p[1] for p in parts]).astype(np.int64)), pa.array(np.concatenate([p[2] for p in parts]))],
                names=["lang", "gram", "n"],
            )

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            gram, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return gram, np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)

        held = 0
        for batch in slices(batches):
            lang = np.array(batch.column(0).to_pylist(), object)
            for lo, _, doc, gram, n in gram_counts(batch.column(1).to_pylist()):
                owner = lang[lo + doc]
                for x in set(owner):
                    own = owner == x
                    total.setdefault(x, []).append((gram[own], n[own]))
                    held += int(own.sum())
                if held > 2_000_000:
                    total = {x: [merged(p)] for x, p in total.items()}
                    held = 0
                    if sum(len(p[0][0]) for p in total.values()) > 1_000_000:
                        yield rows_of(total)
                        total = {}
        if total:
            yield rows_of(total)

    summed = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    out: dict[str, np.ndarray] = {}
    for r in ranked.orderBy("lang", "rank").collect():  # languages times top rows
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(x, np.int64).astype(U64) for lang, x in sorted(out.items())}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], top: int):
        self.langs, self.top = sorted(profiles), top
        self.gram = np.unique(np.concatenate([*profiles.values(), np.zeros(1, U64)]))
        self.rank = np.full((len(self.langs), len(self.gram)), -1, np.int32)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.gram, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return lang, score
        for lo, hi, doc, gram, n in gram_counts([x or "" for x in texts]):
            order = np.lexsort((gram, -n, doc))
            doc, gram = doc[order], gram[order]
            first = np.searchsorted(doc, np.arange(hi - lo))
            rank = np.arange(len(doc)) - first[doc]
            near = rank < self.top
            doc, gram, rank = doc[near], gram[near], rank[near]
            size = np.bincount(doc, minlength=hi - lo)
            at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
            known = self.gram[at] == gram
            far = []
            for own in self.rank:
                r = np.where(known, own[at], -1)
                far.append(np.bincount(doc, np.where(r < 0, self.top, np.abs(r - rank)), minlength=hi - lo))
            far = np.array(far)
            best = far.argmin(0)
            for i in np.flatnonzero(size):
                lang[lo + i] = self.langs[best[i]]
                score[lo + i] = 1 - far[best[i], i] / (self.top * size[i])
        return lang, score


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, top)
        for batch in slices(batches):
            lang, score = model.predict(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text").mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, profiles: dict[str, np.ndarray], least_score: float, top: int = TOP) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language with at least that score."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, top)
        for batch in slices(batches):
            lang, score = model.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != "und" and s >= least_score for x, s in zip(lang, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
