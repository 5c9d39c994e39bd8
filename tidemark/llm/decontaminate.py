"""Benchmark decontamination: which texts hold a benchmark item, up to a share of edits.

Item-sized windows of every whole text are embedded by CGK random walks: at each step a walk writes the byte that it stands
on and moves on or stays, by a random bit for the step and the byte, so that a few edits of a window become a small Hamming
distance between the embeddings. A walk takes STEPS steps for each byte of the item, so all of the window is embedded. In
each table an embedding's bucket is given by SAMPLES sampled steps; the number of tables follows from the RECALL asked for and
from AGREE, the share of steps that agree at the edit limit. A window that shares a bucket with its item is verified exactly
(Myers' bit-parallel edit distance with a free start and end).

Only windows that can match are embedded, wherever they start (so texts without blanks are no exception): k edits leave
L - Q + 1 - Q k of an item's L - Q + 1 grams of Q bytes whole at least, and shift them against each other by k places at
most, so a window opens at the diagonals on which an item has that many hits. This loses nothing. Of grams that many
items share, an item leaves out some and needs as many hits less. Recall against brute force is measured in the tests, for edits
spread evenly, gathered at the start and in runs, up to the limit.

Texts and items are compared without case (Unicode's full case folding, then NFC) and with each run of white space as one blank. An item of L bytes
may differ by MAX_EDITS * L edits, by fewer if it is short ((L - q) / q at most).

Defined results: null and empty texts match nothing; null and blank items match nothing; items shorter than q bytes match exact copies, anywhere in a text;
repeated items or rows each give their own rows; null ids stay null; empty tables give an empty result; only the
named columns are read. Items are matched in blocks of at most ITEM_BLOCK, so a block's tables have a fixed size.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._kernels import LOWER, SPACE, U64, as_bytes, chunks, eights

Q = 10
MAX_EDITS = 0.08
ITEM_BLOCK = 20_000
WALKS, STEPS, SAMPLES = 4, 3, 3
RECALL, AGREE = 0.999, 0.3
TABLES = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**SAMPLES))
SEED = 77
PERIOD = 4096  # steps after which a walk's bits come again
STARTS = 6  # windows of one candidate; one with more diagonals goes to the exact verification without them
SHARED = 50  # places of a gram in the items of a block from which on an item may leave it out
HITS = 1 << 21  # hits of grams and items that are held at a time, unless one text has more
SCHEMA = "doc_id long, item_id long, edits int, place long"
_BEYOND = re.compile(rb"[\xc4-\xff]")
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def folded(raw: bytes) -> bytes:
    """Without case and in NFC, but for what latin() does; bytes that are no UTF-8 stay as they are."""
    if not _BEYOND.search(raw):
        return raw
    text = unicodedata.normalize("NFD", raw.decode("utf-8", "surrogateescape")).casefold()
    return unicodedata.normalize("NFC", text).encode("utf-8", "surrogateescape")


def latin(buf: np.ndarray) -> np.ndarray:
    """Case folding of the letters up to U+00FF, all of which keep their number of bytes. A-Z is left to normalised()."""
    lead = np.flatnonzero((buf[:-1] == 0xC3) | (buf[:-1] == 0xC2))
    if not len(lead):
        return buf
    buf, second = buf.copy(), buf[lead + 1]
    three = buf[lead] == 0xC3
    upper = lead[three & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
    buf[upper + 1] += 0x20
    sharp, micro = lead[three & (second == 0x9F)], lead[~three & (second == 0xB5)]
    buf[sharp] = buf[sharp + 1] = ord("s")
    buf[micro], buf[micro + 1] = 0xCE, 0xBC
    return buf


def normalised(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case with single blanks, and for each old place its new one."""
    gap = SPACE[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return np.where(gap, np.uint8(32), LOWER[buf])[keep], np.concatenate(([0], np.cumsum(keep)))


def gram_values(buf: np.ndarray) -> np.ndarray:
    """A 64-bit value of the Q bytes at each place (too few bytes left: none)."""
    n = len(buf) - Q + 1
    if n <= 0:
        return np.zeros(0, U64)
    eight = eights(buf)
    value = eight[:n] * _A
    value += eight[Q - 8 : Q - 8 + n] * _B
    return value


class Walks:
    """CGK embeddings, of which only the sampled steps are kept."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.move = rng.integers(0, 2, (PERIOD, WALKS, 256), dtype=np.int8)
        self.place = rng.random((TABLES, SAMPLES))
        self.walk = np.arange(TABLES) % WALKS

    def buckets(self, texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Bucket of each text in each table; a size sets the number of steps, and beyond a text's end its walk stays on 0."""
        flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        length = np.array([len(x) for x in texts], np.int64)
        end = np.cumsum(length + 1) - 1
        at = np.repeat((end - length)[None], WALKS, 0)
        steps = STEPS * sizes
        order = np.argsort(-steps, kind="stable")  # those with steps left come first
        at, end, left = at[:, order], end[order], steps[order]
        wanted = (self.place[None] * steps[order][:, None, None]).astype(np.int64)  # sampled step of each text, table, sample
        row, table, sample = np.unravel_index(np.argsort(wanted, axis=None, kind="stable"), wanted.shape)
        turn = wanted[row, table, sample]
        cut = np.searchsorted(turn, np.arange(int(left[0]) + 1))
        seen = np.zeros(wanted.shape, np.uint8)
        every = np.arange(WALKS)[:, None]
        for j in range(int(left[0])):
            n = int(np.searchsorted(-left, -j, "left"))
            c = flat[at[:, :n]]
            a, b = cut[j], cut[j + 1]
            if b > a:
                seen[row[a:b], table[a:b], sample[a:b]] = c[self.walk[table[a:b]], row[a:b]]
            at[:, :n] = np.minimum(at[:, :n] + self.move[j % PERIOD][every, c], end[:n])
        out = np.zeros(seen.shape[:2], np.int64)
        for k in range(SAMPLES):
            out = out << 8 | seen[:, :, k]
        back = np.empty_like(out)
        back[order] = out
        return back


class Verifier:
    """Least number of edits between an item and any part of a text."""

    def __init__(self, item: bytes):
        self.size, self.masks = len(item), {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: bytes) -> int:
        full, high = (1 << self.size) - 1, 1 << (self.size - 1)
        pv, mv, score = full, 0, self.size
        best = score
        for c in text:
            eq = self.masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
                best = min(best, score)
            ph, mh = ph << 1, mh << 1
            pv = (mh | ~(xv | ph)) & full
            mv = ph & xv & full
        return best


class Matcher:
    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids, self.items = [], []
        for item_id, text in rows:
            raw = np.frombuffer(folded((text or "").encode()), np.uint8)
            flat = normalised(latin(raw))[0].tobytes().strip() if len(raw) else b""
            if flat:
                self.ids.append(item_id)
                self.items.append(flat)
        self.edits = [max(0, min(int(MAX_EDITS * len(x)), (len(x) - Q) // Q)) for x in self.items]
        self.copies: dict[bytes, list[int]] = {}
        for i, x in enumerate(self.items):
            self.copies.setdefault(x, []).append(i)
        long = [x for x in self.copies if len(x) >= Q]
        self.short = [x for x in self.copies if len(x) < Q]
        own = [gram_values(np.frombuffer(x, np.uint8)) for x in long]
        size = np.array([len(x) for x in own], np.int64)
        value = np.concatenate(own or [np.zeros(0, U64)])
        item = np.repeat(np.arange(len(own)), size)
        offset = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
        self.first = np.array([self.copies[x][0] for x in long], np.int64)
        self.most = np.array([self.edits[i] for i in self.first], np.int64)
        self.least = size - Q * self.most  # grams that stay whole
        _, back, n = np.unique(value, return_inverse=True, return_counts=True)
        order = np.lexsort((-n[back], item))
        place = np.empty(len(order), np.int64)
        place[order] = offset  # of a gram among its item's, the most shared first
        keep = (n[back] <= SHARED) | (place >= self.least[item] // 2)
        self.least -= np.bincount(item[~keep], minlength=len(own))
        order = np.flatnonzero(keep)[np.argsort(value[keep], kind="stable")]
        self.grams, self.lo, self.n = np.unique(value[order], return_index=True, return_counts=True)
        self.item, self.offset = item[order], offset[order]
        self.bits = 22
        self.flag = np.zeros(1 << self.bits, bool)
        self.flag[(self.grams >> U64(64 - self.bits)).astype(np.int64)] = True
        self.verifier: dict[int, Verifier] = {}
        self.walks = Walks()
        self.bucket: dict[int, np.ndarray] = {}

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item index, edits, place in the normalised text) of each text and item that match."""
        if not self.items:
            return
        held: list[tuple[int, int, list[bytes], bytes, int]] = []  # text, distinct item, windows, bytes around them, their place
        for chunk in chunks(texts):
            lo = chunk.lo
            if (chunk.buf >= 0xC4).any():
                (chunk,) = chunks([folded(x) for x in chunk.texts], 1 << 62)
            buf, place = normalised(latin(chunk.buf))
            if self.short:
                whole = buf.tobytes()
                for d, (a, b) in enumerate(zip(place[chunk.start].tolist(), place[chunk.end].tolist(), strict=True)):
                    for x in self.short:
                        at = whole.find(x, a, b)
                        if at >= 0:
                            yield from ((lo + d, i, 0, at - a) for i in self.copies[x])
            if not len(self.grams):
                continue
            value = gram_values(buf)
            hit = np.flatnonzero(self.flag[(value >> U64(64 - self.bits)).astype(np.int64)])
            exact = np.searchsorted(self.grams, value[hit])
            hit = hit[self.grams[np.minimum(exact, len(self.grams) - 1)] == value[hit]]
            if not len(hit):
                continue
            gram = np.searchsorted(self.grams, value[hit])
            start, end = place[chunk.start], place[chunk.end]
            doc = np.searchsorted(start, hit, "right") - 1
            total = np.cumsum(self.n[gram])
            a = 0
            while a < len(hit):  # whole texts, of HITS hits or one text
                b = int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, "right"))
                if b < len(hit):
                    cut = int(np.searchsorted(doc, doc[b]))
                    b = cut if cut > a else int(np.searchsorted(doc, doc[a], "right"))
                held += [(lo + d, *rest) for d, *rest in self.candidates(buf, start, end, hit[a:b], gram[a:b], doc[a:b])]
                a = b
            if len(held) > 2000:
                yield from self.verified(held)
                held = []
        yield from self.verified(held)

    def candidates(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, hit: np.ndarray, gram: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, list[bytes], bytes, int]]:
        """What the hits of whole texts leave open: text, distinct item, item-sized windows, the bytes in which they lie, their place."""
        n = self.n[gram]
        at = np.arange(n.sum()) + np.repeat(self.lo[gram] - (np.cumsum(n) - n), n)
        c, diagonal, d = self.item[at], np.repeat(hit, n) - self.offset[at], np.repeat(doc, n)
        pair = d * len(self.first) + c
        _, back, often = np.unique(pair, return_inverse=True, return_counts=True)
        enough = often[back] >= self.least[c]
        pair, diagonal, c = pair[enough], diagonal[enough], c[enough]
        order = np.lexsort((diagonal, pair))
        pair, diagonal, c = pair[order], diagonal[order], c[order]
        last = np.arange(len(pair)) + self.least[c] - 1
        inside = np.flatnonzero(last < len(pair))
        last = last[inside]
        inside = inside[(pair[last] == pair[inside]) & (diagonal[last] - diagonal[inside] <= self.most[c[inside]])]
        last = inside + self.least[c[inside]] - 1
        parts: list[list] = []  # pair, bounds, diagonals
        for p, i, low, high in zip(pair[inside].tolist(), c[inside].tolist(), diagonal[inside].tolist(), diagonal[last].tolist(), strict=True):
            k, x = int(self.most[i]), p // len(self.first)
            a, b = max(int(start[x]), high - k), min(int(end[x]), low + len(self.items[self.first[i]]) + 2 * k)
            if parts and parts[-1][0] == p and a <= parts[-1][2]:
                parts[-1][2] = b
                parts[-1][3].update((low, high))
            else:
                parts.append([p, a, b, {low, high}])
        for p, a, b, diagonals in parts:
            x, i = divmod(p, len(self.first))
            size, k = len(self.items[self.first[i]]), int(self.most[i])
            near = sorted({min(max(s, int(start[x])), int(end[x])) for s in diagonals})
            # the item may start up to k places from a diagonal whose grams lie behind some edits
            near = sorted({*near, max(near[0] - k, a), near[0] + k}) if k else near
            if len(near) > STARTS:  # no window stands for the others: all of them are verified
                near = []
            yield x, i, [buf[s : min(s + size, int(end[x]))].tobytes() for s in near], buf[a:b].tobytes(), a - int(start[x])

    def verified(self, held: list[tuple[int, int, list[bytes], bytes, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item index, edits, place) of the candidates of which a window shares a bucket with its item and is near enough."""
        if not held:
            return
        new = [i for i in {c for _, c, *_ in held} if i not in self.bucket]
        if new:
            own = [self.items[self.first[i]] for i in new]
            self.bucket.update(zip(new, self.walks.buckets(own, np.array([len(x) for x in own], np.int64)), strict=True))
        windows = np.array([len(x[2]) for x in held])
        owner = np.repeat(np.arange(len(held)), windows)
        left = np.flatnonzero(windows == 0)
        if len(owner):
            size = np.array([len(self.items[self.first[x[1]]]) for x in held], np.int64)[owner]
            keys = self.walks.buckets([w for x in held for w in x[2]], size)
            left = np.union1d(left, owner[(keys == np.stack([self.bucket[x[1]] for x in held])[owner]).any(1)])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for h in left.tolist():
            d, i, _, text, at = held[h]
            if best.get((d, i), (1,))[0] == 0:
                continue
            item = self.items[self.first[i]]
            exact = text.find(item)
            if exact >= 0:
                best[d, i] = 0, at + exact
                continue
            if i not in self.verifier:
                self.verifier[i] = Verifier(item)
            edits = self.verifier[i].best(text)
            if edits <= self.most[i] and ((d, i) not in best or edits < best[d, i][0]):
                best[d, i] = edits, at
        for (d, c), (edits, at) in sorted(best.items()):
            for i in self.copies[self.items[self.first[c]]]:
                yield d, i, edits, at


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits and place for every text of docs(doc_id, text) and item of benchmark(item_id, text) that match."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    blocks = max(1, -(-items.count() // (ITEM_BLOCK // 2)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").limit(ITEM_BLOCK + 1).collect()
        if len(rows) > ITEM_BLOCK:
            raise ValueError("one benchmark item repeats beyond a block's size; remove copies of items first")
        shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                names = batch.column(0).to_pylist()
                found = [(names[d], matcher.ids[i], edits, at) for d, i, edits, at in matcher.find(as_bytes(batch.column(1)))]
                columns = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "edits", "place"])

        out.append(texts.mapInArrow(run, SCHEMA))
    return reduce(DataFrame.unionByName, out)
