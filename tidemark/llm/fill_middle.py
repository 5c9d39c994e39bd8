"""Fill-in-the-middle transformation by an index of distinct texts.

Texts are cut into units: runs of A-Z and a-z, and every other code point alone. The boundaries of a text are kept as an
Elias-Fano list: low bits packed, high bits in unary, two select operations a cut. Identical texts share one list:

1. One scan gives each document a key, the SHA-256 of its text; counting the keys finds those of several documents.
2. The texts under such keys are grouped by their whole bytes, summed up in each task before anything is sent. A key with
   two different texts stops the job, so that a key stands for one content. Each group's list is made once: the index.
3. The documents join the index back by key, 256 of one key in a row, and select their cuts from the list.
   A key with more than a thousandth of all rows (a thousand keys at most) is dealt over a row of the index for each thousandth.
4. A document whose text no other shares is a group of its own: its list is made where the text is read, and nothing is sent.

A Bloom filter of fixed size tells the last two kinds apart. It may send lone texts through the index, never the reverse;
once it is full all texts go through the index. The rows are the same.

The cuts of a document come from its doc_id and a seed by SHA-256, so another partitioning gives the same ones.

Defined results: null texts count as empty; empty texts and texts that hold a marker stay plain; repeated rows each get a
row with the same cut; a null doc_id is cut as the text `null` in place of its digits and stays null; an empty table gives
an empty result; only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._filter import bloom, passes, thinned
from tidemark.llm._io import saved
from tidemark.llm._kernels import ROWS, as_bytes, give_back

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
OUT_BYTES = 1 << 20  # of texts in an Arrow batch
MEMBERS = 256  # documents of one text in a row
HOT = 1000  # a text with more than this part of all rows is dealt out
_HEAD = struct.Struct("<QQB")


@dataclass(frozen=True)
class Plan:
    """Markers, seed and shares (of 100) of a transformation."""

    seed: int = 1
    cut_percent: int = 90
    spm_percent: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def draws(self, doc_id: int | None) -> list[int]:
        digits = hashlib.sha256(f"{self.seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]


def boundaries(text: str) -> np.ndarray:
    """Where the units begin, and the end, in code points."""
    if text.isascii():
        points = np.frombuffer(text.encode(), np.uint8)
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = points | 32
    letter = (small >= 97) & (small <= 122)
    begin = ~letter
    begin[1:] |= ~letter[:-1]
    begin[:1] = True
    return np.append(np.flatnonzero(begin), len(points))


def elias_fano(values: np.ndarray) -> bytes:
    """An ascending list of numbers: u64 count, u64 largest, u8 low bits each; low bits; high bits in unary."""
    n, most = len(values), int(values[-1])
    low = max(0, (most // n).bit_length() - 1)
    bits = (values[:, None] >> np.arange(low) & 1).astype(np.uint8)
    high = np.zeros((most >> low) + n, np.uint8)
    high[(values >> low) + np.arange(n)] = 1
    return _HEAD.pack(n, most, low) + np.packbits(bits.reshape(-1), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


class Boundaries:
    """Selects numbers of an Elias-Fano list."""

    def __init__(self, raw: bytes):
        self.count, _, self.low = _HEAD.unpack_from(raw)
        at = _HEAD.size + -(-self.count * self.low // 8)
        self.lows = np.frombuffer(raw, np.uint8, at - _HEAD.size, _HEAD.size)
        self.high = np.frombuffer(raw, np.uint8, -1, at)
        self.ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)

    def __getitem__(self, k: int) -> int:
        at = int(np.searchsorted(self.ones, k + 1))
        inside = np.flatnonzero(np.unpackbits(self.high[at : at + 1], bitorder="little"))[k - (int(self.ones[at - 1]) if at else 0)]
        place, out = k * self.low, (8 * at + int(inside) - k) << self.low
        if self.low:
            window = int.from_bytes(self.lows[place // 8 : (place + self.low + 7) // 8].tobytes(), "little")
            out |= window >> place % 8 & (1 << self.low) - 1
        return out


def transformed(plan: Plan, doc_id: int | None, text: str, list_: Boundaries, marked: bool) -> tuple:
    """One document's row, its cut selected from its text's list."""
    n = list_.count - 1
    h1, h2, h3, h4 = plan.draws(doc_id)
    if not text or marked or h3 % 100 >= plan.cut_percent:
        return doc_id, n, "plain", None, None, text
    a, b = (list_[k] for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < plan.spm_percent:
        return doc_id, n, "spm", a, b - a, f"{plan.suffix}{suffix}{plan.prefix}{prefix}{plan.middle}{middle}"
    return doc_id, n, "psm", a, b - a, f"{plan.prefix}{prefix}{plan.suffix}{suffix}{plan.middle}{middle}"


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of some OUT_BYTES."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[-1]) + 64
        if size > OUT_BYTES:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*part, strict=True), types, strict=True)], names=names)
            part, size = [], 0
            give_back()
    if part:
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*part, strict=True), types, strict=True)], names=names)


def keys(docs: DataFrame) -> DataFrame:
    """doc_id, SHA-256 of the text, and 64 bits of that for the filter."""
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.xxhash64(digest).alias("short"))


def index(docs: DataFrame, shared) -> DataFrame:
    """digest, text and Elias-Fano list of each distinct text whose short key may be in the filter."""
    text = F.coalesce("text", F.lit(""))
    chosen = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")).select("digest", F.xxhash64("digest").alias("short"), "text")
    distinct = thinned(chosen, "short", shared).groupBy("digest", "text").agg(F.count("*").alias("copies")).select("digest", "text")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.record_batch([*part.columns, pa.array([elias_fano(boundaries(t)) for t in part.column(1).to_pylist()], pa.binary())], names=["digest", "text", "list"])

    return distinct.mapInArrow(lists, "digest binary, text string, list binary")


def transform(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, units, form, code points of prefix and middle (null if plain) and the transformed text of every row of docs(doc_id, text)."""
    known = saved(keys(docs), "fim-keys")
    counted = saved(known.groupBy("digest").agg(F.count("*").alias("copies"), F.first("short").alias("short")).where("copies > 1"), "fim-copies")
    shared = bloom(counted, "short")
    texts = saved(index(docs, shared), "fim-index")
    twice = texts.groupBy("digest").count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError("two different texts have one SHA-256")
    total = known.count()
    hot = F.broadcast(counted.where(F.col("copies") * HOT > total).select("digest", F.ceil(F.col("copies") * HOT / total).cast("int").alias("parts")))
    dealt = texts.join(hot, "digest", "left").select("digest", "text", "list", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(shared.value, batch.column(2))))
            of: dict[bytes, list[int | None]] = {}
            for doc_id, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of.setdefault(digest, []).append(doc_id)
            rows = [(d, ids[k : k + MEMBERS]) for d, ids in of.items() for k in range(0, len(ids), MEMBERS)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["digest", "ids"])

    members = known.select("doc_id", "digest", "short").mapInArrow(packed, "digest binary, ids array<bigint>")
    members = members.join(hot, "digest", "left").select("digest", "ids", F.coalesce(F.pmod(F.xxhash64("ids"), "parts"), F.lit(0)).cast("int").alias("part"))
    joined = members.join(dealt.hint("merge"), ["digest", "part"]).select("ids", "text", "list")
    markers = (plan.prefix, plan.suffix, plan.middle)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    for ids, text, raw in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                        list_, marked = Boundaries(raw), any(m in text for m in markers)
                        for doc_id in ids:
                            yield transformed(plan, doc_id, text, list_, marked)

        yield from _batches(rows())

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                inside = passes(shared.value, batch.column(2))
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS).filter(pa.array(~inside[at : at + ROWS]))
                    for doc_id, raw in zip(part.column(0).to_pylist(), as_bytes(part.column(1)).to_pylist(), strict=True):
                        text = (raw or b"").decode("utf-8", "surrogatepass")
                        yield transformed(plan, doc_id, text, Boundaries(elias_fano(boundaries(text))), any(m in text for m in markers))

        yield from _batches(rows())

    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    lone = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(digest).alias("short")).mapInArrow(alone, SCHEMA)
    return lone.unionByName(joined.mapInArrow(select, SCHEMA))


def restored(plan: Plan = Plan()):
    """The text that a row's output and form stand for, as a column."""
    out = F.col("output")

    def part(marker: str, k: int):
        return F.split_part(out, F.lit(marker), F.lit(k))

    head, rest = F.substr(part(plan.suffix, 1), F.lit(len(plan.prefix) + 1)), part(plan.suffix, 2)
    psm = F.concat(head, F.split_part(rest, F.lit(plan.middle), F.lit(2)), F.split_part(rest, F.lit(plan.middle), F.lit(1)))
    tail, body = F.substr(part(plan.prefix, 1), F.lit(len(plan.suffix) + 1)), part(plan.prefix, 2)
    spm = F.concat(F.split_part(body, F.lit(plan.middle), F.lit(1)), F.split_part(body, F.lit(plan.middle), F.lit(2)), tail)
    return F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(out)


def digests(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Digests in place of the texts of transform()."""
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(plan), 256).alias("restored_sha256"),
    )
