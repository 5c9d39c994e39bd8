"""Exact substring deduplication by fingerprints of sampled positions, in place of distributed prefix doubling.

Every byte covered by a string of LENGTH bytes that also starts elsewhere goes. Ranking every position at offsets of 8 to
400 bytes wrote 377 bytes of shuffle for each byte of text where it was measured (see the README), so no rank is
doubled: two fixed rounds of fingerprints, dealt by hash and grouped in numpy, start at sampled positions:
the least hash of K bytes in a window, which the bytes themselves decide, so that copies of a string have the same ones.

1. Starts are taken in runs with the same inner string, from the least place of a LENGTH-byte string's first part to that
   of its last. All (inner, outer) fingerprints, called ranks, are dealt by the inner and grouped, the outer string being the run's reach at a
   greater offset to either side. A run whose inner rank is unique has no repeat and drops out. One whose outer
   rank occurs again is past the threshold: all its starts repeat.
2. Only runs for which neither holds, at the edges of repeats, go on: each of their starts is ranked by its whole LENGTH
   bytes' hash, these are grouped in the same way, and starts with equal ranks repeat.

Ranks are fingerprints of the strings (equal strings, equal ranks; 60 and 64 bits for the pair, 64 for a start), so
no round looks ranks up by position. What is shuffled is a few numbers for each run, and the texts that have repeats.
Equal rows are ranked once a task, and ranks that a task holds often go on as one row, so a passage or text that a third
of all rows share fills no partition.

The same rounds take words in place of bytes (rule WORDS): a passage is then a string of PASSAGE words that also starts
elsewhere, whatever blanks part them. spans() goes by bytes alone, deduplicated() by both: what either rule finds goes.
repeats() gives what spans() gives and counts beside it what deduplicated() would remove.

Defined results: null and empty texts have 0 bytes, nothing removed and the digest of the empty string; texts below
LENGTH bytes are kept (by WORDS those below PASSAGE words); repeated rows are texts of their own, so copies of LENGTH bytes or more all lose all their bytes;
a null doc_id stays null; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._filter import bloom, passes
from tidemark.llm._io import saved, shuffle_partitions
from tidemark.llm._kernels import U64, Chunk, Strings, as_bytes, chunks, eights, mix, words

LENGTH = 400
K = 32  # bytes that a place's hash covers
NEAR = 16  # how far an outer string's ends may lie from the run's
PASSAGE = 51  # words: passages of over 50 words
PIECE = 96  # longer runs are cut
PARTS = 1024  # into which a task deals its rows, at least
HELD = 150_000  # entries that a task sorts before it sends them on
OFTEN = 32  # runs of one inner rank in a task from which it is dealt by the outer rank too
#: 96 bits of a text's digest.
DIGEST = np.dtype([("d", "<i8"), ("e", "<u4")])
#: c: inner rank, o: outer rank, d and e: digest of the text, s and n: first start and number of starts, f: flags.
ENTRY = np.dtype([("c", "<u8"), ("o", "<u8"), ("d", "<i8"), ("e", "<u4"), ("s", "<u4"), ("n", "u1"), ("f", "u1")])
MULTI, HOT, MARKER, DECIDED, BY_WORDS = 1, 2, 4, 8, 16
#: A decision on n starts from s: repeated, open (to be ranked one by one), or only a reference for open ones; BY_WORDS in k too.
VERDICT = np.dtype([("d", "<i8"), ("e", "<u4"), ("s", "<u4"), ("n", "u1"), ("k", "u1")])
REPEATED, OPEN, REFERENCE, KIND = 0, 1, 2, 3
#: h and g: ranks of the two halves of one start's string.
START = np.dtype([("h", "<u8"), ("g", "<u8"), ("d", "<i8"), ("e", "<u4"), ("s", "<u4"), ("f", "u1")])
DEALT = "part int, data binary"
_C = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Rule:
    """Which strings count: their length, what a place's hash covers and how far outer ends may lie, in bytes or in words."""

    length: int
    k: int
    near: int
    least: int  # bytes of the shortest text that holds such a string
    mark: int  # in flags and seeds: the rules' entries are dealt together, each with its own ranks

    @property
    def by_words(self) -> bool:
        return self.mark > 0

    @property
    def window(self) -> int:
        """The two parts of a string in which its least places lie."""
        return (self.length - self.k) // 2

    def places(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the k bytes or words from each place on, and the places at which the texts start and end."""
        if not self.by_words:
            return blocks(chunk.buf), chunk.start, chunk.end
        start, end = words(chunk.buf)
        n = chunk.per_doc(start)
        h, size = Strings(chunk.buf).hash(start, end), 1
        while size < self.k:
            h = mix(h[:-size] * _C[0] + h[size:])
            size *= 2
        return h, np.cumsum(n) - n, np.cumsum(n)


BYTES = Rule(LENGTH, K, NEAR, LENGTH, mark=0)
WORDS = Rule(PASSAGE, 8, 4, 2 * PASSAGE - 1, mark=BY_WORDS)


def blocks(buf: np.ndarray) -> np.ndarray:
    """A hash of the K = 32 bytes from each place on, doubled from 8 by way of 16."""
    n = len(buf)
    if n < K:
        return np.zeros(0, U64)
    eight = eights(buf)
    sixteen = mix(eight[: n - 15] * _C[0] + eight[8 : n - 7])
    return mix(sixteen[: n - 31] * _C[1] + sixteen[16:])


def fingerprint(block: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, size: int) -> np.ndarray:
    """A hash of the places [start, end), size at least: their blocks one after the other, the last one at the end."""
    n = end - start
    h = mix(n.astype(U64) ^ (U64(seed) * _C[2]))
    live, k = np.arange(len(n)), 0
    while len(live):
        h[live] = mix(h[live] * _C[0] + block[start[live] + k])
        k += size
        live = live[n[live] >= k + size]
    return mix(h * _C[1] + block[end - size])


def least_places(block: np.ndarray, window: int) -> np.ndarray:
    """For each place p: where in [p, p + window) the block's hash is least (the last of equals)."""
    n = len(block)
    if n < window:
        return np.zeros(0, np.int64)
    key = block >> U64(32) << U64(32) | (U64(0xFFFFFFFF) - np.arange(n).astype(U64))
    size = 1
    while 2 * size <= window:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < window:
        key = np.minimum(key[: len(key) - (window - size)], key[window - size :])
    return (U64(0xFFFFFFFF) - (key & U64(0xFFFFFFFF))).astype(np.int64)


def digests(chunk) -> tuple[list[bytes], np.ndarray]:
    """Digests of the texts, as bytes and as numbers."""
    raw = [hashlib.blake2b(x, digest_size=DIGEST.itemsize).digest() for x in chunk.texts]
    return raw, np.frombuffer(b"".join(raw), DIGEST)


def runs(chunk: Chunk, digest: np.ndarray, wanted: np.ndarray, rule: Rule) -> np.ndarray:
    """Entries of all starts in the wanted texts of a chunk."""
    block, text_start, text_end = rule.places(chunk)
    length, k = rule.length, rule.k
    size = np.where(wanted, np.maximum(text_end - text_start - length + 1, 0), 0)
    doc = np.flatnonzero(size)
    if not len(doc):
        return np.zeros(0, ENTRY)
    place, near = least_places(block, rule.window), least_places(block, rule.near)
    n = size[doc]
    ends = np.cumsum(n)
    p = np.arange(ends[-1]) + np.repeat(text_start[doc] - (ends - n), n)
    a, b = place[p], place[p + length - k - rule.window + 1]
    step = (a - p) // PIECE
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (p[1:] != p[:-1] + 1) | (step[1:] != step[:-1])
    at = np.flatnonzero(new)
    first, last = p[at], p[np.append(at[1:], len(p)) - 1]
    doc = np.repeat(doc, n)[at]
    start, end = text_start[doc], text_end[doc]
    left = np.where(first - rule.near >= start, near[np.maximum(first - rule.near, 0)], start)
    right = np.where(last + length + rule.near <= end, near[np.minimum(last + length - k + 1, len(near) - 1)] + k, end)
    out = np.zeros(len(at), ENTRY)
    out["c"] = mix(fingerprint(block, a[at], b[at] + k, 1 + rule.mark, k) + step[at].astype(U64))
    # where the run lies in its outer string belongs to the outer rank, and so does its length
    out["o"] = mix(mix(fingerprint(block, left, right, 2 + rule.mark, k) + (first - left).astype(U64)) + (last - first).astype(U64))
    out["d"], out["e"], out["s"], out["n"] = digest["d"][doc], digest["e"][doc], first - start, last - first + 1
    out["f"] = rule.mark
    return out


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row of sorted keys, and group sizes."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    return group, np.bincount(group) if len(group) else np.zeros(0, np.int64)


def _deal(rows: np.ndarray, key: np.ndarray, parts: int) -> pa.RecordBatch:
    part = (mix(key.astype(U64)) >> U64(32)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    cut = np.append(at, len(part)).tolist()
    raw, size = rows.tobytes(), rows.itemsize
    return pa.record_batch([pa.array(part[at].astype(np.int32)), pa.array([raw[size * x : size * y] for x, y in zip(cut, cut[1:])], pa.binary())], names=["part", "data"])


def _gathered(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for batch in batches for x in batch.column(1).to_pylist()), kind)


def thin_out(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a task sends on of its entries, with the key by which each is dealt.

    Runs with both ranks equal repeat: one goes on for all. Where an inner rank still has many runs, they are dealt by the
    outer rank, and one marker tells the inner rank's own partition of them.
    """
    e = entries[np.lexsort((entries["o"], entries["c"]))]
    group, size = _groups(e["c"], e["o"])
    lead = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
    twice = size[group] > 1
    done = e[twice & ~lead].copy()
    done["f"] |= DECIDED
    e = e[lead].copy()
    e["f"] |= np.where(twice[lead], MULTI, 0).astype(np.uint8)
    group, size = _groups(e["c"])
    hot = size[group] > OFTEN
    first = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
    marker = e[hot & first].copy()
    marker["f"] = MARKER | marker["f"] & BY_WORDS
    e["f"][hot] |= HOT
    rows = np.concatenate((e, marker, done))
    key = np.where(rows["f"] & HOT > 0, rows["o"], np.where(rows["f"] & DECIDED > 0, rows["d"].astype(U64), rows["c"]))
    return rows, key


def decide(entries: np.ndarray) -> np.ndarray:
    """Verdicts on the entries of a partition."""
    done = entries[entries["f"] & DECIDED > 0]
    e = entries[entries["f"] & DECIDED == 0]
    out = [_verdicts(done, REPEATED)]
    for hot in (False, True):
        x = e[(e["f"] & HOT > 0) == hot]
        x = x[np.lexsort((x["f"] & MARKER, x["o"], x["c"]))]
        if not len(x):
            continue
        inner, inner_size = _groups(x["c"])
        group, size = _groups(x["c"], x["o"], x["f"] & MARKER)
        mark = x["f"] & MARKER > 0
        certain = ((size[group] > 1) | (np.bincount(group, x["f"] & MULTI)[group] > 0)) & ~mark
        lone = ~certain & ~mark & (hot | (inner_size[inner] > 1))
        lead = np.concatenate(([True], group[1:] != group[:-1]))
        asked = hot | (np.bincount(inner, lone | mark)[inner] > 0)
        out += [_verdicts(x[certain], REPEATED), _verdicts(x[lone], OPEN), _verdicts(x[certain & lead & asked], REFERENCE)]
    return np.concatenate(out)


def _verdicts(entries: np.ndarray, kind: int) -> np.ndarray:
    out = np.zeros(len(entries), VERDICT)
    out["d"], out["e"], out["s"], out["n"], out["k"] = entries["d"], entries["e"], entries["s"], entries["n"], kind | entries["f"] & BY_WORDS
    return out


def _by_text(dealt: DataFrame) -> DataFrame:
    """Verdicts dealt by digest, as one row a text: repeated starts, and those to rank one by one."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _gathered(batches, VERDICT)
        v = v[np.lexsort((v["k"], v["s"], v["e"], v["d"]))]
        group, size = _groups(v["d"], v["e"])
        cut = np.concatenate(([0], np.cumsum(size)))
        for lo in range(0, len(size), 5000):
            rows = [v[cut[i] : cut[i + 1]] for i in range(lo, min(lo + 5000, len(size)))]
            sure = [x[x["k"] & KIND == REPEATED] for x in rows]
            todo = [x[x["k"] & KIND != REPEATED] for x in rows]
            yield pa.record_batch([pa.array([x[["d", "e"]][:1].astype(DIGEST).tobytes() for x in rows], pa.binary()), pa.array([x.tobytes() if len(x) else None for x in sure], pa.binary()), pa.array([x.tobytes() if len(x) else None for x in todo], pa.binary())], names=["digest", "sure", "todo"])

    return dealt.repartition(shuffle_partitions(dealt.sparkSession), "part").mapInArrow(gather, "digest binary, sure binary, todo binary")


def _ranked_runs(docs: DataFrame, rules: tuple[Rule, ...], parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, size = [], 0
        for batch in batches:
            for chunk in chunks(as_bytes(batch.column(0))):
                raw, digest = digests(chunk)
                fresh = _fresh(raw, seen)
                for rule in rules:
                    held.append(runs(chunk, digest, fresh, rule))
                    size += len(held[-1])
                if size > HELD:
                    yield _deal(*thin_out(np.concatenate(held)), parts)
                    held, size = [], 0
        if size:
            yield _deal(*thin_out(np.concatenate(held)), parts)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = decide(_gathered(batches, ENTRY))
        yield _deal(v, v["d"], parts)

    dealt = docs.select("text").where(F.octet_length("text") >= _least(rules)).mapInArrow(run, DEALT)
    return dealt.repartition(shuffle_partitions(docs.sparkSession), "part").mapInArrow(join, DEALT)


def _least(rules: tuple[Rule, ...]) -> int:
    return min(rule.least for rule in rules)


def _fresh(digest: list[bytes], seen: set[bytes], limit: int = 500_000) -> np.ndarray:
    """Texts that a task meets for the first time. It may forget some, which then rank as repeats, as they are."""
    if len(seen) > limit:
        seen.clear()
    out = np.zeros(len(digest), bool)
    for i, x in enumerate(digest):
        if x not in seen:
            seen.add(x)
            out[i] = True
    return out


def _texts(docs: DataFrame, wanted, least: int, once: bool) -> DataFrame:
    """Rows of docs(head, text) of least bytes whose digest is in the filter: head, digest, text; each text once a task if once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for chunk in chunks(as_bytes(batch.column(1))):
                raw, digest = digests(chunk)
                keep = passes(wanted.value, pa.array(digest["d"])) & (chunk.end - chunk.start >= least)
                if once:
                    keep &= _fresh(raw, seen)
                if keep.any():
                    rows = batch.slice(chunk.lo, chunk.hi - chunk.lo).filter(pa.array(keep))
                    yield pa.record_batch([rows.column(0), pa.array([raw[i] for i in np.flatnonzero(keep).tolist()], pa.binary()), rows.column(1)], names=["head", "digest", "text"])

    return docs.mapInArrow(run, f"head {docs.schema['head'].dataType.simpleString()}, digest binary, text string")


def _ranked_starts(docs: DataFrame, decided: DataFrame, rules: tuple[Rule, ...], parts: int) -> DataFrame:
    """Verdicts on single starts that were open."""
    todo = decided.where("todo is not null").select("digest", "todo")
    rows = _texts(docs, bloom(todo, "digest"), _least(rules), once=True).select("digest", "text").join(todo.hint("merge"), "digest").select("digest", "text", "todo")

    def thin(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[np.lexsort((rows["g"], rows["h"]))]
        group, size = _groups(rows["h"], rows["g"])
        lead = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
        twice = size[group] > 1
        done, on = rows[twice & ~lead].copy(), rows[lead].copy()
        done["f"] |= DECIDED
        on["f"] |= np.where(twice[lead], MULTI, 0).astype(np.uint8)
        out = np.concatenate((on, done[done["f"] & MARKER == 0]))
        return out, np.where(out["f"] & DECIDED > 0, out["d"].astype(U64), out["h"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            todo_of = batch.column(2).to_pylist()
            digest = batch.column(0).to_pylist()
            for chunk in chunks(as_bytes(batch.column(1))):
                asked = [np.frombuffer(x, VERDICT) for x in todo_of[chunk.lo : chunk.hi]]
                for rule in rules:
                    of_rule = [v[v["k"] & BY_WORDS == rule.mark] for v in asked]
                    if not any(map(len, of_rule)):
                        continue
                    block, text_start, _ = rule.places(chunk)
                    half = (rule.length + 1) // 2
                    for i in (i for i, v in enumerate(of_rule) if len(v)):
                        v = of_rule[i]
                        n = v["n"].astype(np.int64)
                        ends = np.cumsum(n)
                        at = np.arange(ends[-1]) + np.repeat(v["s"].astype(np.int64) - (ends - n), n)
                        out = np.zeros(len(at), START)
                        base = text_start[i] + at
                        out["h"], out["g"] = (fingerprint(block, x, x + half, 3 + rule.mark, rule.k) for x in (base, base + rule.length - half))
                        out["d"], out["e"], out["s"] = *np.frombuffer(digest[chunk.lo + i], DIGEST)[0].tolist(), at
                        out["f"] = np.repeat(np.where(v["k"] & KIND == REFERENCE, MARKER, 0).astype(np.uint8), n) | rule.mark
                        # a start may be both open and a reference: open comes first
                        out = out[np.lexsort((out["f"], at))]
                        out = out[np.concatenate(([True], out["s"][1:] != out["s"][:-1]))]
                        held.append(out)
                        size += len(out)
                        if size > HELD:
                            yield _deal(*thin(np.concatenate(held)), parts)
                            held, size = [], 0
        if size:
            yield _deal(*thin(np.concatenate(held)), parts)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _gathered(batches, START)
        done = e[e["f"] & DECIDED > 0]
        x = e[e["f"] & DECIDED == 0]
        x = x[np.lexsort((x["g"], x["h"]))]
        group, size = _groups(x["h"], x["g"])
        if len(x):
            x = x[((size[group] > 1) | (np.bincount(group, x["f"] & MULTI)[group] > 0)) & (x["f"] & MARKER == 0)]
        x = np.concatenate((done, x))
        v = np.zeros(len(x), VERDICT)
        v["d"], v["e"], v["s"], v["n"], v["k"] = x["d"], x["e"], x["s"], 1, REPEATED | x["f"] & BY_WORDS
        yield _deal(v, v["d"], parts)

    dealt = rows.mapInArrow(rank, DEALT)
    return _by_text(dealt.repartition(shuffle_partitions(docs.sparkSession), "part").mapInArrow(join, DEALT)).select("digest", "sure")


def cover(raw: bytes, rule: Rule, whole: bool, blobs: list[bytes | None]) -> list[tuple[int, int]]:
    """Maximal removed spans of a text, in bytes; a whole text goes if it holds a string of the rule."""
    v = np.concatenate([np.frombuffer(b, VERDICT) for b in blobs if b] or [np.zeros(0, VERDICT)])
    v = v[v["k"] & BY_WORDS == rule.mark]
    if not (whole or len(v)):
        return []
    first, last = words(np.frombuffer(raw, np.uint8)) if rule.by_words else (None, None)
    size = len(first) if rule.by_words else len(raw)
    if whole:
        start, end = (np.array([0]), np.array([size])) if size >= rule.length else (np.zeros(0, np.int64),) * 2
    else:
        v = v[np.argsort(v["s"], kind="stable")]
        start = v["s"].astype(np.int64)
        end = np.maximum.accumulate(start + v["n"] + rule.length - 1)
    if rule.by_words:
        start, end = first[start], last[end - 1]
    return merged(start, end)


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Spans in order of their starts as maximal ones."""
    if not len(start):
        return []
    end = np.maximum.accumulate(end)
    at = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[at].tolist(), end[np.append(at[1:], len(start)) - 1].tolist(), strict=True))


def union(spans: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The maximal spans of what any of the lists covers."""
    if sum(map(bool, spans)) < 2:
        return next(filter(None, spans), [])
    both = np.array(sorted(x for one in spans for x in one), np.int64)
    return merged(both[:, 0], both[:, 1])


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and the result of every row of docs(doc_id, text)."""
    out = _cut(docs.select(F.col("doc_id").cast("long").alias("head"), "text"), (BYTES,))
    return out.withColumnRenamed("head", "doc_id")


def repeats(docs: DataFrame) -> DataFrame:
    """spans(docs) and n_repeated: bytes in repeated strings of LENGTH bytes or PASSAGE words, that is, all that deduplicated() removes."""
    out = _cut(docs.select(F.col("doc_id").cast("long").alias("head"), "text"), (BYTES, WORDS), counted=True)
    return out.withColumnRenamed("head", "doc_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, all columns, without repeated strings of LENGTH bytes or PASSAGE words; n_chars follows; texts of which no word is left go."""
    rest = [c for c in docs.columns if c != "text"]
    out = _cut(docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("head"), "text"), (BYTES, WORDS), kept_text=True).where("kept is not null")
    changed = {"text": F.col("kept"), **({"n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("head.n_chars"))} if "n_chars" in rest else {})}
    return out.select(*(changed.get(c, F.col(f"head.`{c}`")).alias(c) for c in docs.columns))


def _cut(docs: DataFrame, rules: tuple[Rule, ...], counted: bool = False, kept_text: bool = False) -> DataFrame:
    """head and result of every row of docs(head, text) by all rules; with kept_text also what is left, null if it has no word.

    If counted, the result is by the first rule alone, and n_repeated counts the bytes that any rule finds.
    """
    least = _least(rules)
    parts = max(PARTS, 2 * shuffle_partitions(docs.sparkSession))
    first = saved(_by_text(_ranked_runs(docs, rules, parts)), "runs")
    second = saved(_ranked_starts(docs, first, rules, parts), "starts")

    def list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(as_bytes(batch.column(0))):
                yield pa.record_batch([pa.array(digests(chunk)[0], pa.binary())], names=["digest"])

    long = docs.select("text").where(F.octet_length("text") >= least)
    copies = long.mapInArrow(list_digests, "digest binary").groupBy("digest").count().where("count > 1").select("digest", F.lit(True).alias("whole"))
    decided = first.where("sure is not null").select("digest", F.col("sure").alias("a")).join(second.select("digest", F.col("sure").alias("b")), "digest", "full").join(copies, "digest", "full")
    decided = saved(decided.select("digest", F.when(F.col("whole"), None).otherwise(F.col("a")).alias("a"), F.when(F.col("whole"), None).otherwise(F.col("b")).alias("b"), F.coalesce("whole", F.lit(False)).alias("whole")), "decided")
    wanted = bloom(decided, "digest")

    def row(head: pa.Array, texts: list[bytes], found: list[list[list[tuple[int, int]]]]) -> pa.RecordBatch:
        all_cuts = [union(x) for x in found]
        cuts, kept = [x[0] for x in found] if counted else all_cuts, []
        for raw, cut in zip(texts, cuts, strict=True):
            edges = [0, *(x for pair in cut for x in pair), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if cut else raw)
        columns = [head, pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) - len(y) for x, y in zip(texts, kept, strict=True)], pa.int64()), pa.array([len(c) for c in cuts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        names_of = ["head", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if counted:
            columns.append(pa.array([sum(b - a for a, b in c) for c in all_cuts], pa.int64()))
            names_of.append("n_repeated")
        if kept_text:
            columns.append(pa.array([x.decode("utf-8", "ignore") if x.split() else None for x in kept], pa.string()))
            names_of.append("kept")
        return pa.record_batch(columns, names=names_of)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(as_bytes(batch.column(1))):
                maybe = passes(wanted.value, pa.array(digests(chunk)[1]["d"])) & (chunk.end - chunk.start >= least)
                own = np.flatnonzero(~maybe).tolist()
                yield row(batch.column(0).take(pa.array([chunk.lo + i for i in own], pa.int64())), [chunk.texts[i] for i in own], [[[]] for _ in own])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts, a, b, whole = (part.column(i).to_pylist() for i in range(1, 5))
                raws = [x.encode() for x in texts]
                yield row(part.column(0), raws, [[cover(raw, rule, all_of, [x, y]) for rule in rules] for raw, all_of, x, y in zip(raws, whole, a, b, strict=True)])

    schema = f"head {docs.schema['head'].dataType.simpleString()}, {RESULT}" + (", n_repeated long" if counted else "") + (", kept string" if kept_text else "")
    touched = _texts(docs, wanted, least, once=False).join(decided.hint("merge"), "digest", "left")
    touched = touched.select("head", "text", "a", "b", F.coalesce("whole", F.lit(False)).alias("whole")).mapInArrow(cut, schema)
    return docs.mapInArrow(untouched, schema).unionByName(touched)
