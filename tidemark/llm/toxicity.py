"""Toxicity by two class-conditional Kneser-Ney word-pair models with shared backoff and a prior against chance.

For each class c the lower order is Kneser and Ney's: P(w) = max(k(w) - D, 0) / K + D * V / K * S(w), where k(w) is the number of
different words of the class before w, K their sum, V the number of words that have any, and S(w), which both classes share, the same share
over both. P(w | u) = max(n(uw) - D', 0) / n(u) + D' * kinds(u) / n(u) * P(w), where n counts the texts of the class that hold an
expression and kinds how many different ones follow u. D = n1 / (n1 + 2 n2), from the expressions of the class that occur once and twice.

Among many expressions some part the classes by chance. An expression's evidence G is the log-likelihood ratio of its counts (n0, n1)
between shares of its own and the classes' shares of all text; its weight 1 / (1 + exp(PRIOR - G)) is the probability that it differs at all,
if one in exp(PRIOR) does. Each class then uses weight * P + (1 - weight) * shared, the shared one being S(w) for a word and P(w) for a pair,
so rare and even expressions lean on the shared counts and striking ones on their own. No expression is cut off in its effect: words below a
weight of exp(LEAST - PRIOR), a thousandth, are left out of the table as they would count for nothing, pairs below one half have their word's
probability, which is what backing off means.

The score is a logistic function of the mean difference in log-likelihood a word; its two parameters are fitted on training fold 1, which the
counts leave out. Counts come from all other labelled training rows by a distributed aggregation over words and word pairs; a word is
known by a 32-bit hash. The model holds the words with some evidence. It is broadcast up to `limit` rows; a larger one is an error that
names the number, since no bound of its own keeps it small.

Defined results: null and texts without words score as a mean difference of 0; rows without a label,
with a null doc_id or null label don't train; without training rows every score is 0.5 and predicted 1 only
by the rule score >= 0.5; repeated rows each get a row; an empty table gives an empty result; only the named
columns are read. A-Z is lower-cased; ASCII punctuation parts words as white space does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._filter import bloom, thinned
from tidemark.llm._io import saved
from tidemark.llm._kernels import LOWER, U64, Strings, as_bytes, chunks, words

#: One expression in exp(PRIOR) is taken to differ between the classes; evidence from which a word is in the table.
PRIOR, LEAST = 8.0, 1.0
LIMIT = 20_000_000  # rows of a model, some 60 bytes each
FOLDS = 5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_START = U64(0x5BD1E995)


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def pairs(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of the one before it (a fixed value at a text's start), and the word's text."""
    buf = LOWER[chunk.buf]
    edge = _EDGE[buf]
    masked = np.where(edge, np.uint8(32), buf)
    start, end = words(masked)
    per_doc = chunk.per_doc(start)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    w = Strings(buf).hash(start, end)
    u = np.concatenate(([_START], w[:-1])) if len(w) else w
    if len(w):
        u[np.concatenate(([True], doc[1:] != doc[:-1]))] = _START
    return w, u, doc


def _word(h: np.ndarray) -> np.ndarray:
    return (h & U64(0xFFFFFFFF)).astype(np.int64)


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for a pair: 32 bits of each word's hash, those of the first not 0, which stands for a word alone."""
    u = u & U64(0xFFFFFFFF)
    return (np.maximum(u, U64(1)) << U64(32) | w & U64(0xFFFFFFFF)).view(np.int64)


def discount(once: float, twice: float) -> float:
    """Kneser and Ney's estimate from the numbers of expressions seen once and twice."""
    return once / (once + 2 * twice) if once else 0.5


class Values:
    """Values of sorted keys; other keys have the last row's."""

    def __init__(self, key: np.ndarray, columns: list[np.ndarray]):
        order = np.argsort(key)
        self.key = key[order]
        self.rows = np.vstack([np.stack(columns, 1)[order], np.zeros((1, len(columns)))])

    def of(self, key: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, key)
        if len(self.key):
            at[self.key[np.minimum(at, len(self.key) - 1)] != key] = len(self.key)
        else:
            at[:] = 0
        return self.rows[at]


def evidence(n0: np.ndarray, n1: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of counts with their own share of class 1 against a given share; 0 where that is 0 or 1."""
    n = np.maximum(n0 + n1, 1)
    if not 0 < share < 1:
        return np.zeros(len(n))
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(k > 0, k * np.log(k / (n * q)), 0.0) for k, q in ((n1, share), (n0, 1 - share))]
    return parts[0] + parts[1]


def weight(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(PRIOR - g, -50, 50)))


class Model:
    """log P(w | u, toxic) - log P(w | u, ordinary) of the words and pairs with evidence."""

    def __init__(self, words: dict[str, np.ndarray], pairs: dict[str, np.ndarray], contexts: dict[str, np.ndarray], total: dict[str, float], share: float):
        """words: at, n0, n1 (texts), k0, k1 (different words before); pairs: at, n0, n1; contexts: at, n0, n1 and kinds k0, k1 of
        pairs after a word; total: k0, k1 and v0, v1 over words, d0, d1 and p0, p1 (discounts of words and pairs)."""
        shared = np.maximum((words["k0"] + words["k1"]) / max(total["k0"] + total["k1"], 1), 1e-12)
        lean = weight(evidence(words["n0"], words["n1"], share))
        own = []
        for c in "01":
            k = max(total["k" + c], 1)
            p = np.maximum(words["k" + c] - total["d" + c], 0) / k + total["d" + c] * total["v" + c] / k * shared
            own.append(np.maximum(lean * p + (1 - lean) * shared, 1e-12))
        self.word = Values(words["at"], [np.log(own[1] / own[0])])
        lower, context = Values(words["at"], own), Values(contexts["at"], [contexts[x] for x in ("n0", "n1", "k0", "k1")])
        p, c = lower.of(pairs["at"] & 0xFFFFFFFF), context.of((pairs["at"] >> 32) & 0xFFFFFFFF)
        lean = weight(evidence(pairs["n0"], pairs["n1"], share))
        logs = []
        for k in (0, 1):
            n, d = np.maximum(c[:, k], 1), total[f"p{k}"]
            full = np.where(c[:, k] > 0, np.maximum(pairs[f"n{k}"] - d, 0) / n + np.minimum(d * c[:, 2 + k] / n, 1) * p[:, k], p[:, k])
            logs.append(np.log(np.maximum(lean * full + (1 - lean) * p[:, k], 1e-12)))
        self.pair = Values(pairs["at"], [logs[1] - logs[0], np.ones(len(logs[0]))])
        self.slope, self.offset = 1.0, 0.0

    def difference(self, w: np.ndarray, u: np.ndarray) -> np.ndarray:
        pair = self.pair.of(_pair(u, w))
        return np.where(pair[:, 1] > 0, pair[:, 0], self.word.of(_word(w))[:, 0])

    def mean(self, chunk) -> np.ndarray:
        w, u, doc = pairs(chunk)
        n = len(chunk.end)
        return np.bincount(doc, self.difference(w, u), minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)


def _tables(kept: pa.Table, sums: dict) -> tuple[dict, dict, dict, dict]:
    """What the model takes, from the rows of kinds 0 to 3 and the sums over words."""
    x = {c: kept[c].to_numpy() for c in ("kind", "at", "a", "b", "c", "d")}
    of = lambda kind, names: {name: x[c][x["kind"] == kind] for name, c in names.items()}
    counts = {"at": "at", "n0": "a", "n1": "b", "k0": "c", "k1": "d"}
    words, pairs, contexts = of(1, counts), of(0, {"at": "at", "n0": "a", "n1": "b"}), of(2, counts)
    often = of(3, {"at": "at", "n": "a"})
    seen = lambda c, k: float(often["n"][(often["at"] // 4 if c == 0 else often["at"] % 4) == k].sum())
    total = {k: float(sums[k] or 0) for k in ("k0", "k1", "v0", "v1")}
    total |= {"d0": discount(sums["x1"], sums["x2"]), "d1": discount(sums["y1"], sums["y2"]), **{f"p{c}": discount(seen(c, 1), seen(c, 2)) for c in (0, 1)}}
    return words, pairs, contexts, total


def _evidence(n0: F.Column, n1: F.Column, share: float) -> F.Column:
    if not 0 < share < 1:
        return F.lit(0.0)
    return sum((F.when(k > 0, k * F.ln(k / ((n0 + n1) * q))).otherwise(0.0) for k, q in ((n1, share), (n0, 1 - share))), F.lit(0.0))


def _known(labels: DataFrame) -> DataFrame:
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    return known.groupBy("doc_id").agg(F.max(F.least(F.col("toxic").cast("int"), F.lit(1))).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> Model:
    spark = docs.sparkSession
    known = _known(labels)
    texts = thinned(docs.where(fold(F.col("doc_id")) != 0).select("doc_id", "text"), "doc_id", bloom(known, "doc_id"))
    # a sort-merge join parts the two Python steps: one worker a task at a time
    rows = texts.join(known.hint("merge"), "doc_id").select("toxic", fold(F.col("doc_id")).cast("int").alias("fold"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(0).to_pylist(), np.int64)
            for chunk in chunks(as_bytes(batch.column(1))):
                w, u, doc = pairs(chunk)
                key, doc = np.concatenate((_pair(u, w), _word(w))), np.concatenate((doc, doc))
                order = np.lexsort((key, doc))
                new = np.ones(len(order), bool)
                new[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                once = order[new]  # a text counts an expression once, however often it repeats it
                cls = toxic[chunk.lo + doc[once]]
                key, back = np.unique(key[once], return_inverse=True)
                n0, n1 = (np.bincount(back[cls == c], minlength=len(key)) for c in (0, 1))
                yield pa.record_batch([pa.array(key), pa.array(n0), pa.array(n1)], names=["key", "n0", "n1"])

    counted = rows.where("fold != 1").select("toxic", "text").mapInArrow(count, "key long, n0 long, n1 long")
    exact = counted.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sizes = docs.where(fold(F.col("doc_id")) > 1).select("doc_id", F.length("text").alias("n")).join(known, "doc_id").groupBy("toxic").agg(F.sum("n").alias("n"))
    texts_of = {r["toxic"]: r["n"] for r in sizes.collect()}
    share = (texts_of.get(1) or 0) / max(sum(x or 0 for x in texts_of.values()), 1)
    low, zero = F.lit(0xFFFFFFFF).cast("long"), F.lit(0).cast("long")
    part = _evidence(F.col("n0"), F.col("n1"), share) >= PRIOR
    first, alone = F.shiftrightunsigned("key", 32), F.shiftrightunsigned("key", 32) == 0

    def row(kind: int, at, *values):
        return F.struct(F.lit(kind).alias("kind"), at.alias("at"), *(v.cast("long").alias(k) for k, v in zip("abcd", values, strict=True)))

    # kind 0: a pair with evidence; 1: a word, and how many precede it in each class; 2: a context; 3: how many pairs each class has so often
    often = F.least("n0", F.lit(3)) * 4 + F.least("n1", F.lit(3))
    one, has = F.lit(1), [(F.col(f"n{c}") > 0).cast("long") for c in (0, 1)]
    parts = F.when(alone, F.array(row(1, F.col("key"), F.col("n0"), F.col("n1"), zero, zero))).otherwise(
        F.array(row(1, F.col("key").bitwiseAND(low), zero, zero, *has), row(2, first, F.col("n0"), F.col("n1"), *has), row(3, often, one, zero, zero, zero), row(0, F.col("key"), F.col("n0"), F.col("n1"), part.cast("long"), zero))
    )
    listed = exact.select(F.explode(F.filter(parts, lambda x: (x["kind"] > 0) | (x["c"] > 0))).alias("x")).select("x.*")
    table = saved(listed.groupBy("kind", "at").agg(*(F.sum(c).alias(c) for c in "abcd")), "expressions")
    table = table.withColumn("evident", F.coalesce(_evidence(F.col("a"), F.col("b"), share) >= LEAST, F.lit(False)))
    pair_rows = table.where("kind = 0")
    asked = pair_rows.select(F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("at").bitwiseAND(low).alias("at")), F.struct(F.lit(2).alias("kind"), F.shiftrightunsigned("at", 32).alias("at")))).alias("x")).select("x.*").distinct()
    wanted = "(kind = 1 and evident) or kind in (0, 3)"
    kept = table.where(wanted).unionByName(table.where(f"not ({wanted})").join(asked, ["kind", "at"], "left_semi").select(table.columns)).select("kind", "at", *"abcd")
    kept = saved(kept, "model")
    rows_kept = kept.count()
    if rows_kept > limit:
        raise ValueError(f"a model of {rows_kept} expressions is too large to broadcast (limit {limit})")
    sums = table.where("kind = 1").agg(F.sum("c").alias("k0"), F.sum("d").alias("k1"), *(F.count_if(F.col(x) > 0).alias("v" + c) for x, c in (("c", "0"), ("d", "1"))), *(F.count_if(F.col(x) == i).alias(f"{c}{i}") for x, c in (("c", "x"), ("d", "y")) for i in (1, 2))).first().asDict()
    model = Model(*_tables(kept.toArrow(), sums), share)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(0).to_pylist(), np.int64)
            for chunk in chunks(as_bytes(batch.column(1))):
                x = np.rint(np.clip(shared.value.mean(chunk), -2, 2) * 1000).astype(np.int64)
                yield pa.record_batch([pa.array(x), pa.array(toxic[chunk.lo : chunk.hi])], names=["x", "toxic"])

    held = rows.where("fold = 1").select("toxic", "text").mapInArrow(measure, "x long, toxic long").groupBy("x", "toxic").count().collect()  # 8002 rows at most
    _calibrate(model, [(r["x"] / 1000, r["toxic"], r["count"]) for r in held])
    return model


def _calibrate(model: Model, rows: list[tuple[float, int, int]]) -> None:
    """Logistic regression of the label on the mean difference, by Newton's method with a weak prior."""
    if not rows:
        return
    x, y, n = (np.array(c, float) for c in zip(*rows, strict=True))
    y = np.minimum(y, 1)
    scale = 20.0
    theta = np.array([1.0, 0.0])
    design = np.stack([x * scale, np.ones(len(x))], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 1e-3 * theta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = float(theta[0]) * scale, float(theta[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for chunk in chunks(as_bytes(batch.column(2))):
                p = 1 / (1 + np.exp(-np.clip(m.slope * m.mean(chunk) + m.offset, -30, 30)))
                n = chunk.hi - chunk.lo
                yield pa.record_batch([batch.column(0).slice(chunk.lo, n), batch.column(1).slice(chunk.lo, n), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text").mapInArrow(run, SCHEMA)
