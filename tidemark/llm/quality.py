"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed words and word pairs: one of trusted-target texts
(labels.quality = 1), one of the raw corpus. A text's score is the sum of log(target / raw) over its grams,
divided by their number. It is kept when it passes the base rules and its score reaches `threshold`; nothing
is drawn at random, so equal texts get equal verdicts.

Raw counts cover all documents. The target is fitted on at most `max_trusted` labelled rows, the first by a hash
of doc_id (a documented bound for fitting a classifier). Both sides live in `BUCKETS` counters, so the model
has a fixed size.

Defined results: a null or empty text has zero counts, fails the base rules (under 20 words) and is not kept;
its score is 0. Repeated rows each get a row; null ids stay null; an empty table gives an empty result; only
the named columns are read, so other columns can't clash. Lines are split at \\n; words are runs of bytes other
than 0x20 and 0x09 to 0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._kernels import SPACE, U64, Strings, as_bytes, chunks, grams, mix, words

BUCKETS = 1 << 16
MAX_TRUSTED = 20_000
THRESHOLD = -0.09
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def _repeated(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which of the values occur twice or more in their group."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    out = np.zeros(len(g), bool)
    out[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return out


def _totals(per_doc: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sums of flags over consecutive runs of the lengths in per_doc."""
    total = np.concatenate(([0], np.cumsum(flags)))
    end = np.cumsum(per_doc)
    return total[end] - total[end - per_doc]


class Text:
    """Words and grams of a chunk."""

    def __init__(self, chunk):
        self.chunk, buf = chunk, chunk.buf
        self.strings = Strings(buf)
        self.start, self.end = words(buf)
        self.n_words = chunk.per_doc(self.start)
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.hash = self.strings.hash(self.start, self.end)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """An exact number for each 8-word window of a text, and its first word: numbers of pairs are doubled thrice."""
        number, _ = self.strings.ids(self.start, self.end)
        for k in (1, 2, 4):
            number = np.unique(number[: max(len(number) - k, 0)].astype(np.int64) << 32 | number[k:], return_inverse=True)[1]
        at = np.flatnonzero(self.doc[: len(number)] == self.doc[7:]) if len(number) else np.zeros(0, np.int64)
        return number[at], at

    def base(self) -> dict[str, np.ndarray]:
        chunk, buf = self.chunk, self.chunk.buf
        solid = np.concatenate(([0], np.cumsum(~SPACE[buf] & ((buf & 0xC0) != 0x80))))
        symbol = np.concatenate(([0], np.cumsum(SYMBOL[buf])))
        line_end = np.flatnonzero(buf == 10)
        line_start = np.concatenate(([0], line_end[:-1] + 1))
        full = solid[line_end] > solid[line_start]
        s, e = line_start[full], line_end[full]
        line_doc = np.searchsorted(chunk.end, e)
        key, _ = self.strings.ids(s, e)
        order = np.lexsort((key, line_doc))
        d, k = line_doc[order], key[order]
        dup = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
        window, at = self.windows()
        cover = np.zeros(len(self.hash) + 8, np.int64)
        hit = at[_repeated(self.doc[at], window)] if len(at) else at
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 8, -1)
        return {
            "n_words": self.n_words,
            "word_chars": solid[chunk.end] - solid[chunk.start],
            "n_symbols": symbol[chunk.end] - symbol[chunk.start],
            "n_dup_lines": np.bincount(d[1:][dup], minlength=len(chunk.end)),
            "n_repeat_words": _totals(self.n_words, np.cumsum(cover)[: len(self.hash)] > 0),
        }

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and text of each word and each word pair."""
        pair, at = grams(self.hash, self.doc, 2)
        bucket = np.concatenate((mix(self.hash), pair)) & U64(BUCKETS - 1)
        return bucket.astype(np.int64), np.concatenate((self.doc, self.doc[at]))


def fit(docs: DataFrame, labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """log(target / raw) of each bucket, both with one added count."""
    trusted = labels.where(F.col("quality") == 1).where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    trusted = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted).withColumn("trusted", F.lit(True))
    rows = docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = np.array(batch.column(1).to_pylist(), bool)
            for chunk in chunks(as_bytes(batch.column(0))):
                bucket, doc = Text(chunk).features()
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[chunk.lo + doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    summed = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in summed.collect():  # BUCKETS rows at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, score and verdict of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(as_bytes(batch.column(1))):
                text = Text(chunk)
                base = text.base()
                bucket, doc = text.features()
                n = np.bincount(doc, minlength=len(chunk.end))
                score = np.bincount(doc, ratio[bucket], minlength=len(chunk.end)) / np.maximum(n, 1)
                failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
                columns = [*(pa.array(x.astype(np.int64)) for x in base.values()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
                yield pa.record_batch([batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo), *columns], names=["doc_id", *base, "base_failed", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
