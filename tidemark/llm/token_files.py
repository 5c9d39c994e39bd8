"""Token ids in files of frequency-ranked, byte-aligned variable-length codes.

A block holds the ids of neighbouring documents. Its ids are numbered by frequency in the block, the most frequent
first, so that most numbers take one byte. Control bytes stand apart from data bytes, as four 2-bit lengths (1 to 4
bytes) each; one table lookup by control byte gives the lengths of four numbers, and numpy decodes a block whole.

Block layout, little-endian: magic `TDM1`; u32 documents, ids, kinds; u8[documents] null flags of the doc_ids and
i64[documents] doc_ids; then three coded sequences: ids in rank order, documents' lengths, and ranks. A coded
sequence is u32 numbers, u32 data bytes, control bytes, data bytes.

Files are Parquet with columns part, block, before (ids of the part's earlier blocks), documents, ids, payload: Spark's writer commits them to any store, and a
lost executor's part is written again. Documents lie in ascending doc_id order (null first; equal doc_ids by a
hash of the text, then the text), over parts in order and blocks in order.

Defined results: null and empty texts have the end id alone; repeated rows each get their place; an empty table gives
no file rows; only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._io import shuffle_partitions
from tidemark.llm._kernels import as_bytes, chunks
from tidemark.llm.bpe import Remembering, gather

FILE_SCHEMA = "part int, block int, before long, documents long, ids long, payload binary"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
CACHE = 900_000  # distinct pieces that a worker remembers, some 200 bytes each
WORD_END = "</w>"
#: Bytes of plain words: 1 for letters, 2 for marks. Letters are A-Z, a-z and those of Latin-1, which keep their number in
#: lower case and in NFC.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[list(b".,!?;:%*#&$|")] = 2
GROUP = 400  # words in one text for the library
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def code(values: np.ndarray) -> bytes:
    """A coded sequence of numbers below 2**32."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return struct.pack("<II", len(v), len(data)) + control.tobytes() + data.tobytes()


def decode(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    """The numbers of the coded sequence at a place, and the place after it."""
    count, data_size = struct.unpack_from("<II", raw, at)
    at += 8
    control = np.frombuffer(raw, np.uint8, -(-count // 4), at)
    at += len(control)
    data = np.frombuffer(raw, np.uint8, data_size, at)
    size = _LENGTHS[control].reshape(-1)[:count]
    out = np.zeros((count, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = data
    return out.view("<u4").reshape(-1), at + data_size


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    kinds, back, n = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    head = b"TDM1" + struct.pack("<III", len(doc_ids), len(ids), len(kinds))
    nulls = bytes(x is None for x in doc_ids)
    names = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    return head + nulls + names + code(kinds[order]) + code(lengths) + code(rank[back])


def unpack(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if raw[:4] != b"TDM1":
        raise ValueError("not a block of token ids")
    documents, count, kinds = struct.unpack_from("<III", raw, 4)
    nulls = raw[16 : 16 + documents]
    names = np.frombuffer(raw, "<i8", documents, 16 + documents).tolist()
    by_rank, at = decode(raw, 16 + 9 * documents)
    lengths, at = decode(raw, at)
    ranks, at = decode(raw, at)
    if len(ranks) != count or len(by_rank) != kinds or at != len(raw):
        raise ValueError("a block of token ids is cut short")
    return [None if null else x for null, x in zip(nulls, names, strict=True)], lengths.astype(np.int64), by_rank[ranks]


_encoders: dict[str, Remembering] = {}


def plain_words(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Which pieces are letters with or without a run of marks after them, how many words each of those is (1 or 2), and these
    words, each with a blank after it, with the place where each piece begins and the end."""
    size = np.array([len(x) + 1 for x in pieces], np.int64)
    end = np.cumsum(size)
    flat = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
    kind = _KIND[flat]
    wide = np.flatnonzero((flat[:-1] == 0xC3) & ((flat[1:] & 0xC0) == 0x80) & (flat[1:] != 0x97) & (flat[1:] != 0xB7))
    kind[wide] = kind[wide + 1] = 1
    kind[end - 1] = 3
    wrong = kind == 0
    wrong[1:] |= (kind[1:] == 1) & (kind[:-1] == 2)
    total = np.concatenate(([0], np.cumsum(wrong)))
    plain = (total[end] == total[end - size]) & (kind[end - size] == 1)
    on = np.repeat(plain, size)
    flat, kind, size = flat[on], kind[on], size[plain]
    turn = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
    last = np.cumsum(size)
    parts = 1 + (kind[last - 2] == 2)
    return np.flatnonzero(plain), parts, np.insert(flat, turn, 32).tobytes(), np.concatenate(([0], np.cumsum(size + parts - 1)))


def _encoder(path: str) -> Remembering:
    """Plain words go to the tokenizers library in lower case, many in a text that is parted at blanks, and their ids are parted at
    the tokens that end a word; a group with another number of word ends than its words have, and all other pieces, go one by one."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer, simple = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for x in (tokenizer, simple):
            x.no_truncation()
            x.no_padding()
        simple.normalizer = None
        simple.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True

        def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            plain, parts, raw, begin = plain_words(pieces)
            size, ids = np.zeros(len(pieces), np.int64), []
            order, other = [], [np.setdiff1d(np.arange(len(pieces)), plain, assume_unique=True)]
            lows = range(0, len(plain), GROUP)
            texts = [raw[begin[k] : begin[min(k + GROUP, len(plain))]].decode().lower() for k in lows]
            for k, encoding in zip(lows, simple.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                group, found = plain[k : k + GROUP], np.array(encoding.ids, np.int64)
                end = np.flatnonzero(ends[found]) + 1
                last = np.cumsum(parts[k : k + GROUP]) - 1
                if len(end) != last[-1] + 1 or end[-1] != len(found):
                    other.append(group)
                    continue
                size[group] = np.diff(end[last], prepend=0)
                ids.append(found)
                order.append(group)
            single = np.concatenate(other)
            for i, encoding in zip(single.tolist(), tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in single.tolist()], add_special_tokens=False), strict=True):
                size[i] = len(encoding.ids)
                ids.append(np.array(encoding.ids, np.int64))
            if not ids:
                return np.zeros(0, np.int64), size
            order = np.concatenate((*order, single))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            laid = size[order]
            return gather(np.concatenate(ids), np.cumsum(laid) - laid, laid, place)[0], size

        _encoders[path] = Remembering(encode, limit=CACHE, trim=True)
    return _encoders[path]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, partitions: int | None = None) -> None:
    """Encodes docs(doc_id, text) and writes the files."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    # the range is cut by text too, so that one repeated doc_id can't fill a partition
    ordered = rows.withColumn("tie", tie).repartitionByRange(partitions or shuffle_partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        texts = _encoder(tokenizer_path)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for chunk in chunks(as_bytes(batch.column(1)), 1 << 21):
                ids, n = texts.ids(chunk)
                ids = np.insert(ids, np.cumsum(n), end_id)
                payload = pack(names[chunk.lo : chunk.hi], n + 1, ids)
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before]), pa.array([len(n)]), pa.array([len(ids)]), pa.array([payload], pa.binary())], names=["part", "block", "before", "documents", "ids", "payload"])
                block += 1
                before += len(ids)

    ordered.mapInArrow(run, FILE_SCHEMA).write.mode("overwrite").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(folder)


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids before it, number of ids and their checksum, from the files."""
    files = read(spark, folder)
    sizes = files.groupBy("part").agg(F.sum("ids").alias("ids")).collect()  # one row a part
    first, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        first[r["part"]] = total
        total += r["ids"]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, earlier, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, lengths, ids = unpack(raw)
                end = np.cumsum(lengths)
                flat = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip((end - lengths).tolist(), end.tolist(), strict=True)]
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(first[part] + earlier + end - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "before", "payload").mapInArrow(run, SCHEMA)
