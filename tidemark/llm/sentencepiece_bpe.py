"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A blank is written `▁`, and one goes before each text. Symbols are code points at first. No merge can cross two
neighbours that stand side by side in no piece of the vocabulary, so texts fall into words there; each distinct piece of
text between blanks is encoded once. The symbols of all new words lie in one flat array. A round looks up the rank of
every neighbouring pair by binary search, takes each word's lowest by a segmented minimum, merges all its occurrences
from left to right at once, and compacts the array; words without a pair left are set aside.

One lowest pair at a time, the leftmost first, is what the library does. A round equals that as long as no merge of it
makes a pair of the same or a lower rank (runs of blanks do: their pieces share one rank). A word where it does, and one
of over LONG symbols, for which a round a rank would be quadratic, is ended by a heap of pairs in the library's order.

Symbols that the vocabulary lacks become their bytes' ids. Decoding gathers the bytes of all ids from one table.

Defined results: null texts count as empty (no ids, empty text); special tokens' strings are ordinary text; repeated
rows each get a row; null ids stay null; an empty table gives an empty result; only the named columns are read, so other
columns can't clash. Decoding skips null ids' rows (null lists give the empty text); bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._kernels import ROWS, Chunk, as_bytes, chunks, give_back
from tidemark.llm.bpe import Remembering, Table

SCHEMA = "doc_id long, ids array<int>, decoded string"
BLANK = "▁"
LONG = 2_000  # symbols of a word
_NONE = np.int64(1 << 40)
_RETURN = b"\xff"  # stands for a carriage return, which pieces may hold inside; no UTF-8 has this byte
_BITS = 21  # of a symbol: ids of the vocabulary, then code points that it lacks
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at : at + size]
        at += size


class PieceBpe:
    """A SentencePiece BPE model with identity normalisation, a blank before each text, and bytes for unknown symbols."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        trainer, normal = (dict(fields(v)) for number in (2, 3) for k, v in model if k == number)
        plain = not normal.get(2) and normal.get(3, 1) == 1 and normal.get(4, 1) == 0 and normal.get(5, 1) == 1
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or not plain:
            raise ValueError("only BPE models with identity normalisation, a leading blank and byte fallback are supported")
        entries = [dict(fields(v)) for k, v in model if k == 1]
        pieces = [e[1].decode() for e in entries]
        kinds = [e.get(3, NORMAL) for e in entries]
        if not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        known = {p: i for i, (p, kind) in enumerate(zip(pieces, kinds, strict=True)) if kind == NORMAL}
        if any(BLANK in p.lstrip(BLANK) or "\t" in p or "\n" in p for p in known):
            raise ValueError("pieces that hold white space after other characters are not supported")
        self.count = len(pieces)
        scores = {i: struct.unpack("<f", entries[i].get(2, b"\0\0\0\0"))[0] for i in known.values()}
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}  # equal scores share a rank
        pairs = sorted((known[p[:k]] << _BITS | known[p[k:]], place[scores[i]], i) for p, i in known.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known)
        self.key, self.rank, self.merged = (np.array([x[j] for x in pairs], np.int64) for j in range(3))
        self.join = {k: (r, m) for k, r, m in pairs}
        self.beside = np.unique(np.array([ord(a) << _BITS | ord(b) for p in known for a, b in zip(p, p[1:], strict=False)], np.int64))
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.count
        for p, i in known.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.byte = np.zeros(256, np.int64)
        for i, kind in enumerate(kinds):
            if kind == BYTE:
                self.byte[int(pieces[i][3:-1], 16)] = i
        unknown = trainer.get(44, " ⁇ ".encode())
        spelled = {NORMAL: lambda p: p.replace(BLANK, " ").encode(), UNKNOWN: lambda p: unknown, CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:-1], 16)])}
        self.strings = Table([spelled[kind](p) for p, kind in zip(pieces, kinds, strict=True)])
        self.silent = np.array(kinds) == CONTROL
        self.led = np.array([kind == NORMAL and p.startswith(BLANK) for p, kind in zip(pieces, kinds, strict=True)])

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (_NONE without one) and its place in the table."""
        key = left << _BITS | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE), at

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces of text, joined, and how many each has."""
        texts = [p.replace(_RETURN, b"\r").decode("utf-8", "surrogatepass") for p in pieces]
        n = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(points):
            return points, n
        points[points == 32] = ord(BLANK)
        pair = points[:-1] << _BITS | points[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        begin = np.append(True, self.beside[at] != pair)
        first = np.cumsum(n) - n
        begin[first[n > 0]] = True
        word = np.flatnonzero(begin)
        owner = np.searchsorted(np.cumsum(n), word, "right")
        ids, size = self.merge(self.symbol[points], np.diff(np.append(word, len(points))))
        owner = np.repeat(owner, size)
        lacking = np.flatnonzero(ids >= self.count)
        if len(lacking):
            kinds, back = np.unique(ids[lacking], return_inverse=True)
            spelled = Table([chr(x - self.count).encode("utf-8", "surrogatepass") for x in kinds.tolist()])
            flat, width = spelled.join(back)
            times = np.ones(len(ids), np.int64)
            times[lacking] = width
            end = np.cumsum(times)
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[np.arange(len(flat)) + np.repeat((end - times)[lacking] - (np.cumsum(width) - width), width)] = self.byte[flat]
        return ids, np.bincount(owner, minlength=len(pieces)).astype(np.int64)

    def merge(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words laid end to end."""
        index = np.arange(len(size))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def end_by_heap(words: np.ndarray) -> None:
            start = np.cumsum(size) - size
            for w in words.tolist():
                ids = self.by_heap(flat[start[w] : start[w] + size[w]].tolist())
                done.append((index[[w]], np.array(ids, np.int64), np.array([len(ids)])))

        drop = size > LONG
        while len(size):
            if drop.any():
                end_by_heap(np.flatnonzero(drop))
                flat, size, index = flat[np.repeat(~drop, size)], size[~drop], index[~drop]
                if not len(size):
                    break
            first = np.cumsum(size) - size
            rank, at = self._find(flat, np.append(flat[1:], 0))
            rank[first + size - 1] = _NONE
            lowest = np.minimum.reduceat(rank, first)
            live = lowest < _NONE
            on = np.repeat(live, size)
            if not live.all():
                done.append((index[~live], flat[~on], size[~live]))
                flat, rank, at, size, index, lowest = flat[on], rank[on], at[on], size[live], index[live], lowest[live]
                if not len(size):
                    break
            word = np.repeat(np.arange(len(size)), size)
            hit = np.flatnonzero(rank == lowest[word])
            # of overlapping pairs every other one merges, from the left
            run = np.cumsum(np.append(True, np.diff(hit) != 1))
            begin = np.flatnonzero(np.append(True, np.diff(run) != 0))
            hit = hit[(np.arange(len(hit)) - begin[run - 1]) % 2 == 0]
            merged = flat.copy()
            merged[hit] = self.merged[at[hit]]
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            drop = np.zeros(len(size), bool)
            many = np.bincount(word[hit], minlength=len(size)) > 1
            check = hit[many[word[hit]]]
            if len(check):
                self._early(check, flat, merged, keep, word, lowest, drop)
            if drop.any():  # these words keep their symbols of before the round
                stay = drop[word]
                merged[stay], keep[stay] = flat[stay], True
            flat, size = merged[keep], size - np.bincount(word[~keep], minlength=len(size))
        joined, index, size = (np.concatenate([x[j] for x in done]) if done else np.zeros(0, np.int64) for j in (1, 0, 2))
        order = np.argsort(index, kind="stable")
        start = np.cumsum(size) - size
        picked = size[order]
        end = np.cumsum(picked)
        return joined[np.arange(len(joined)) + np.repeat(start[order] - (end - picked), picked)], picked

    def _early(self, hit: np.ndarray, flat: np.ndarray, merged: np.ndarray, keep: np.ndarray, word: np.ndarray, lowest: np.ndarray, drop: np.ndarray) -> None:
        """Marks in drop the words where a merge makes a pair that the library would take before the round's next merge."""
        right = np.minimum(hit + 2, len(flat) - 1)
        rank, _ = self._find(merged[hit], flat[right])
        bad = (rank <= lowest[word[hit]]) & (right == hit + 2) & (word[right] == word[hit])
        left = hit - 1
        left = np.where((left >= 0) & ~keep[np.maximum(left, 0)], hit - 2, left)  # the symbol before was merged, too
        rank, _ = self._find(merged[np.maximum(left, 0)], merged[hit])
        bad |= (rank <= lowest[word[hit]]) & (left >= 0) & (word[np.maximum(left, 0)] == word[hit])
        drop[word[hit[bad]]] = True

    def by_heap(self, ids: list[int]) -> list[int]:
        """One word's ids, a pair at a time: the lowest rank, then the leftmost."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            found = self.join.get(ids[a] << _BITS | ids[b])
            if found:
                heapq.heappush(heap, (found[0], a, ids[a], ids[b]))

        for i in range(len(ids) - 1):
            offer(i, i + 1)
        while heap:
            _, a, x, y = heapq.heappop(heap)
            b = after[a]
            if ids[a] != x or b >= len(ids) or ids[b] != y:
                continue
            ids[a], ids[b] = self.join[x << _BITS | y][1], -1
            after[a] = after[b]
            if after[a] < len(ids):
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """The texts of lists of ids laid end to end, n ids each."""
        flat, width = self.strings.join(ids)
        total = np.concatenate(([0], np.cumsum(width)))
        last = np.cumsum(n)
        first = last - n
        begin = first.copy()
        while len(ids):  # the first id that is seen loses its blank
            silent = (begin < last) & self.silent[ids[np.minimum(begin, len(ids) - 1)]]
            if not silent.any():
                break
            begin += silent
        led = self.led[ids[np.minimum(begin, len(ids) - 1)]] & (begin < last) if len(ids) else np.zeros(len(n), bool)
        raw = flat.tobytes()
        return [raw[a + int(cut) : b].decode("utf-8", "replace") for a, b, cut in zip(total[first].tolist(), total[last].tolist(), led.tolist(), strict=True)]


_models: dict[str, tuple[PieceBpe, Remembering]] = {}


def _model(path: str) -> tuple[PieceBpe, Remembering]:
    if path not in _models:  # a worker keeps it for its next tasks
        bpe = PieceBpe(path)
        _models[path] = (bpe, Remembering(bpe.encode))
    return _models[path]


def _prefixed(column: pa.Array) -> Iterator[Chunk]:
    """Chunks of the whole texts, a blank before each that is not empty; blanks that are spelled out are blanks."""
    for at in range(0, len(column), ROWS):
        texts = [b" " + x.replace(BLANK.encode(), b" ").replace(b"\r", _RETURN) if x else b"" for x in column.slice(at, ROWS).to_pylist()]
        for chunk in chunks(texts, 1 << 19):
            chunk.lo, chunk.hi = chunk.lo + at, chunk.hi + at
            yield chunk
    give_back()


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids of every row of docs(doc_id, text); with decoded, also the text that the ids give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, texts = _model(path)
        for batch in batches:
            for chunk in _prefixed(as_bytes(batch.column(1))):
                ids, n = texts.ids(chunk)
                columns = [batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo), _lists(ids, n)]
                if decoded:
                    columns.append(pa.array(bpe.decode(ids, n), pa.string()))
                yield pa.record_batch(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    schema = SCHEMA if decoded else SCHEMA.rpartition(",")[0]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of every row of rows(doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                lists = batch.column(1).slice(at, ROWS)
                ids = lists.flatten()
                n = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                if ids.null_count:
                    raise ValueError("a list of ids holds a null")
                texts = bpe.decode(ids.to_numpy(zero_copy_only=False).astype(np.int64), n)
                yield pa.record_batch([batch.column(0).slice(at, ROWS), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def digests(rows: DataFrame) -> DataFrame:
    """Number of ids and digests of ids and text for rows(doc_id, ids, decoded)."""
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
