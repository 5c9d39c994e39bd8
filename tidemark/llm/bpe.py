"""BPE encoding and decoding in batched numpy merge rounds.

Texts are cut before each run of blanks, tabs and line ends that follows no other white space (a token of white space may
span no-break and plain blanks), where no token can cross; each distinct piece of a chunk is encoded once. The symbols of all new pieces lie in one flat array. A round looks up the ranks of all neighbouring pairs
by binary search over the sorted pair keys, finds each word's lowest, merges its occurrences from left to right, and
sets finished words aside. Decoding gathers the bytes of all ids from one table.

Defined results: null texts count as empty (no ids, the empty string's digests); the text of a special token is
that token's id, as in the library; repeated rows each get a row; null ids stay null; an empty table gives
an empty result; only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._kernels import Chunk, Strings, as_bytes, chunks

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CACHE = 150_000  # distinct pieces that a worker remembers
_NONE = np.int64(1 << 40)
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0D]] = True
#: Other white space in UTF-8, by its last byte, last two and last three.
_OTHER = [np.array([0x0B, 0x0C, *range(0x1C, 0x20)]), np.array([0xC285, 0xC2A0]), np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])]
_LAST = np.zeros(256, bool)
_LAST[np.concatenate(_OTHER) & 0xFF] = True


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of flat in [start, start + size) of each pick, joined, and the size of each pick."""
    n = size[pick]
    end = np.cumsum(n)
    at = np.arange(end[-1] if len(end) else 0) + np.repeat(start[pick] - (end - n), n)
    return flat[at], n


def after_space(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space that _GAP lacks ends before each place (places are above 0, and buf ends with a newline)."""
    code, out = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for k, known in enumerate(_OTHER):
        code |= buf[at - k - 1].astype(np.int64) << 8 * k
        out |= np.isin(code, known)
    return out


class Table:
    """Byte strings by id, for decoding by lookup."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.flat, self.start, self.size, ids)


class ByteBpe:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        strings = {i: bytes(letters[c] for c in token) for token, i in vocab.items()} | {i: x.encode() for x, i in self.special.items()}
        count = max(strings) + 1
        self.strings = Table([strings.get(i, b"") for i in range(count)])
        self.decimals = Table([b"%d," % i for i in range(count)])
        self.pattern = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, joined, and how many each has."""
        symbols, sizes, owner = [], [], []
        for i, piece in enumerate(pieces):
            text = piece.decode("utf-8", "surrogatepass")
            for part in self.cut.split(text) if self.cut and b"|" in piece else (text,):
                if part in self.special:
                    symbols.append(np.array([self.special[part]], np.int64))
                    sizes.append(1)
                    owner.append(i)
                    continue
                for word in self.pattern.findall(part):
                    raw = word.encode("utf-8", "surrogatepass")
                    symbols.append(raw)
                    sizes.append(len(raw))
                    owner.append(i)
        if not sizes:
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        flat = np.concatenate([self.byte[np.frombuffer(x, np.uint8)] if isinstance(x, bytes) else x for x in symbols]) if any(not isinstance(x, bytes) for x in symbols) else self.byte[np.frombuffer(b"".join(symbols), np.uint8)]
        ids, size = self.merge(flat, np.array(sizes, np.int64))
        return ids, np.bincount(owner, size, minlength=len(pieces)).astype(np.int64)

    def merge(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words laid end to end; each round ends the words that have no pair left."""
        index = np.arange(len(size))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(size):
            first = np.cumsum(size) - size
            key = flat[:-1] << 20 | flat[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.append(np.where(self.key[at] == key, self.rank[at], _NONE), _NONE)
            rank[first + size - 1] = _NONE
            lowest = np.minimum.reduceat(rank, first)
            live = lowest < _NONE
            on = np.repeat(live, size)
            if not live.all():
                done.append((index[~live], flat[~on], size[~live]))
                flat, rank, size, index, lowest = flat[on], rank[on], size[live], index[live], lowest[live]
                if not len(size):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            # a run of equal symbols has overlapping pairs: take every other one from its start
            run = np.cumsum(np.append(True, np.diff(hit) != 1))
            begin = np.flatnonzero(np.append(True, np.diff(run) != 0))
            hit = hit[(np.arange(len(hit)) - begin[run - 1]) % 2 == 0]
            flat = flat.copy()
            flat[hit] = self.merged[rank[hit]]
            word = np.repeat(np.arange(len(size)), size)
            size = size - np.bincount(word[hit], minlength=len(size))
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            flat = flat[keep]
        index = np.concatenate([x[0] for x in done])
        size = np.concatenate([x[2] for x in done])
        joined = np.concatenate([x[1] for x in done])
        order = np.argsort(index, kind="stable")
        start = np.cumsum(size) - size
        return gather(joined, start, size, order)


class Remembering:
    """Encodes chunks of whole texts piece by piece, each distinct piece once while it is remembered."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE, trim: bool = False):
        """trim: white space gives no ids, so pieces go without it."""
        self.encode, self.limit, self.trim = encode, limit, trim
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunk's texts, joined, and how many each text has."""
        buf = chunk.buf
        gap = _GAP[buf]
        if self.trim:
            edge = np.concatenate(([True], gap, [True]))
            start, end = np.flatnonzero(edge[:-1] & ~edge[1:]), np.flatnonzero(~edge[:-1] & edge[1:])
        else:
            begin = gap.copy()
            begin[1:] &= ~gap[:-1]
            begin[0] = False
            at = np.flatnonzero(begin)
            at = at[_LAST[buf[at - 1]]]
            begin[at[after_space(buf, at)]] = False
            begin[chunk.start] = True
            begin[chunk.end] = False
            start = np.flatnonzero(begin)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(chunk.end), np.int64)
        per_doc = chunk.per_doc(start)
        if not self.trim:
            end = np.minimum(np.append(start[1:], chunk.end[-1]), np.repeat(chunk.end, per_doc))
        back, first = Strings(buf).ids(start, end)
        if len(self.place) + len(first) > self.limit:
            self._clear()
        place, raw = self.place, buf.tobytes()
        pieces = [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        at = np.array([place.get(x, -1) for x in pieces], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            ids, size = self.encode(fresh)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
            self.flat[self.used : self.used + len(ids)] = ids
            at[new] = len(self.start) + np.arange(len(new))
            self.start = np.concatenate((self.start, self.used + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.used += len(ids)
            place.update(zip(fresh, at[new].tolist(), strict=True))
        ids, n = gather(self.flat, self.start, self.size, at[back])
        total = np.concatenate(([0], np.cumsum(n)))
        last = np.cumsum(per_doc)
        return ids.astype(np.int64), total[last] - total[last - per_doc]


_models: dict[tuple, Remembering] = {}


def _model(path: str, pattern: str) -> tuple[ByteBpe, Remembering]:
    if (path, pattern) not in _models:  # a worker keeps it for its next tasks
        bpe = ByteBpe(path, pattern)
        _models[path, pattern] = (bpe, Remembering(bpe.encode))
    return _models[path, pattern]


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, number of ids, digests of the ids and of the text decoded from them, for docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, texts = _model(path, pattern)
        for batch in batches:
            for chunk in chunks(as_bytes(batch.column(1)), 1 << 19):
                ids, n = texts.ids(chunk)
                digits, digit_n = bpe.decimals.join(ids)
                plain, plain_n = bpe.strings.join(ids)
                ends = np.cumsum(n)
                out = []
                for flat, size in ((digits.tobytes(), digit_n), (plain.tobytes(), plain_n)):
                    total = np.concatenate(([0], np.cumsum(size)))
                    out.append([flat[a:b] for a, b in zip(total[ends - n].tolist(), total[ends].tolist(), strict=True)])
                ids_hash = [hashlib.sha256(x[:-1]).hexdigest() for x in out[0]]
                text_hash = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in out[1]]
                yield pa.record_batch([batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo), pa.array(n), pa.array(ids_hash), pa.array(text_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
