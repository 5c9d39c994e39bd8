"""N-gram Jaccard join with set-relation skipping: exact links at a similarity of 0.8 or more, and their components.

1. A sketch of fixed size estimates in how many texts each shingle occurs. It only orders shingles, rarest first, so
   that shared lines and passages end up behind what is a text's own; results don't depend on it.
2. Each distinct set puts its prefix into index lists by shingle, but for shingles that the sketch counts once: two sets that link share
   a shingle of both prefixes. Lists are cut into blocks by position and size; a block pair whose bounds rule a link out is
   skipped whole. What remains joins sets into candidate components, as a spanning forest, never as all pairs. Of entries with
   equal shingle, size and position one stands for all, in each task first, so a list that a third of all rows share stays short.
3. Each candidate component's sets meet once (large components in blocks, every block pair) and are compared
   exactly. A set's overlaps with all others are derived from those of the most similar set done before it:
   only the lists of shingles in which the two differ are read.
4. Links give components; copies follow their set.

Defined results: null texts and texts without words have an empty set, 0 shingles, no links and themselves as
component; with fewer than five words the whole sequence is the one shingle; equal sets always link. Repeated
doc_ids are rows of their own with equal component ids where their sets link; a null doc_id stays null and is never a
component's id unless all its members are null. An empty table gives an empty result. Only the named
columns are read. A set is known by a 64-bit digest and a shingle by a 64-bit hash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._components import Forest, components
from tidemark.llm._filter import bloom, passes
from tidemark.llm._io import saved, shuffle_partitions
from tidemark.llm._kernels import LOWER, U64, Strings, as_bytes, chunks, grams, mix, words

N = 5
MAX_COUNTERS = 1 << 27  # half a byte each
MOST = 15
PARTS = 4096
SEGMENT = 1 << 16  # counters in one row of the sketch
BLOCK_SETS, BLOCK_TOKENS = 1000, 500_000  # of a candidate component that meet in one task
LIST_BLOCK = 128
SMALL_SIDE = 500_000  # rows of some 60 bytes that are broadcast at most
ENTRY = np.dtype([("t", "<u8"), ("v", "<i8"), ("n", "<u4"), ("p", "<u4")])


def shingles(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by text and hash, and their number by text."""
    buf = LOWER[chunk.buf]
    start, end = words(buf)
    per_doc = chunk.per_doc(start)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    h = Strings(buf).hash(start, end)
    g, at = grams(h, doc, N)
    owner = doc[at]
    first = np.cumsum(per_doc) - per_doc
    for k in range(1, N):  # short texts
        own = np.flatnonzero(per_doc == k)
        if len(own):
            whole = h[first[own]]
            for j in range(1, k):
                whole = mix(whole * U64(0x9E3779B97F4A7C15) + h[first[own] + j])
            g, owner = np.concatenate((g, mix(whole + U64(k)))), np.concatenate((owner, own))
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    if len(g):
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])))
        g, owner = g[new], owner[new]
    return g, np.bincount(owner, minlength=len(per_doc))


def digests(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set's sorted shingles, by BLAKE2; 0 stands for an empty one."""
    raw, out, at = g.tobytes(), [], 0
    for k in (8 * n).tolist():
        out.append(hashlib.blake2b(raw[at : at + k], digest_size=8).digest() if k else b"\0" * 8)
        at += k
    return np.where(n > 0, np.frombuffer(b"".join(out), "<u8") | U64(1), U64(0)).astype(np.int64)


def _slots(g: np.ndarray, counters: int) -> np.ndarray:
    return (mix(g ^ U64(0x5DEECE66D)) & U64(counters - 1)).astype(np.int64)


def pack_slots(slots: np.ndarray) -> bytes:
    """Sorted numbers with repeats as their gaps, a byte each; 255 stands for a step of 255 without a number."""
    gap = np.diff(slots, prepend=0)
    steps, rest = np.divmod(gap, 255)
    out = np.full(int(steps.sum()) + len(gap), 255, np.uint8)
    out[np.cumsum(steps + 1) - 1] = rest
    return zlib.compress(out.tobytes(), 1)


def unpack_slots(raw: bytes) -> np.ndarray:
    gap = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.cumsum(gap, dtype=np.int64)[gap < 255]


def sketch(docs: DataFrame) -> np.ndarray:
    """Estimated numbers of texts by shingle slot, up to MOST, never less than the true ones; two to a byte."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    counters = 1 << min(max((size // 6).bit_length(), 16), MAX_COUNTERS.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def rows() -> pa.RecordBatch:
            slots = np.sort(np.concatenate(held))
            if len(slots) > MOST:  # a counter needs no more of one slot
                slots = slots[np.concatenate((np.ones(MOST, bool), slots[MOST:] != slots[:-MOST]))]
            segment = slots // SEGMENT
            at = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            blobs = [pack_slots(x.astype(np.int64) % SEGMENT) for x in np.split(slots, at[1:])]
            return pa.record_batch([pa.array(segment[at].astype(np.int32)), pa.array(blobs, pa.binary())], names=["segment", "slots"])

        for batch in batches:
            for chunk in chunks(as_bytes(batch.column(0))):
                g, n = shingles(chunk)
                held.append(_slots(g[np.repeat(_first_seen(digests(g, n), seen), n)], counters).astype(np.uint32))
                size += len(held[-1])
                if size > 4_000_000:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.bincount(unpack_slots(raw), minlength=SEGMENT)
                total[i] = np.minimum(total.get(i, 0) + part, MOST).astype(np.uint8)
        for i, part in total.items():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([zlib.compress((part[::2] | part[1::2] << 4).tobytes(), 1)], pa.binary())], names=["segment", "counts"])

    out = np.zeros(counters // 2, np.uint8)
    dealt = docs.select("text").mapInArrow(count, "segment int, slots binary").repartition(min(shuffle_partitions(docs.sparkSession), counters // SEGMENT), "segment")
    for r in dealt.mapInArrow(add, "segment int, counts binary").collect():  # MAX_COUNTERS / 2 bytes
        out[r["segment"] * (SEGMENT // 2) :][: SEGMENT // 2] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out


def counted(counts: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The sketch's counts of shingles."""
    slot = _slots(g, 2 * len(counts))
    return counts[slot >> 1] >> ((slot & 1) << 2).astype(np.uint8) & MOST


def _first_seen(nodes: np.ndarray, seen: set, limit: int = 2_000_000) -> np.ndarray:
    """Which sets a task meets for the first time (it may forget, which costs time only)."""
    out = np.zeros(len(nodes), bool)
    if len(seen) > limit:
        seen.clear()
    for i, x in enumerate(nodes.tolist()):
        if x and x not in seen:
            seen.add(x)
            out[i] = True
    return out


def _may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For entries of one list: sizes and positions leave room for a similarity of 0.8. Equal sizes and positions always do."""
    na, nb, pa_, pb = (x.astype(np.int64) for x in (a["n"], b["n"], a["p"], b["p"]))
    return (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (9 * (np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb)) >= 4 * (na + nb))


def _list_edges(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of one list that may link, skipping block pairs by their bounds."""
    x = x[np.lexsort((x["p"], x["n"]))]
    blocks = [x[i : i + LIST_BLOCK] for i in range(0, len(x), LIST_BLOCK)]
    low, high = [int(b["n"][0]) for b in blocks], [int(b["n"][-1]) for b in blocks]
    head, tail = [int(b["p"].max()) for b in blocks], [int((b["n"] - b["p"]).max()) for b in blocks]
    forest = Forest() if len(blocks) > 1 else None
    for j in range(len(blocks)):
        for i in range(j + 1):
            if 5 * high[i] < 4 * low[j] or 9 * (min(head[i], head[j]) + min(tail[i], tail[j])) < 4 * (low[i] + low[j]):
                continue
            if forest:  # already one component: nothing to add
                roots = {forest.find(v) for v in (*blocks[i]["v"].tolist(), *blocks[j]["v"].tolist())}
                if len(roots) == 1:
                    continue
            a, b = np.triu_indices(len(blocks[j]), 1) if i == j else np.divmod(np.arange(len(blocks[i]) * len(blocks[j])), len(blocks[j]))
            fits = _may_link(blocks[i][a], blocks[j][b])
            for u, v in zip(blocks[i]["v"][a[fits]].tolist(), blocks[j]["v"][b[fits]].tolist(), strict=True):
                if forest:
                    forest.join(u, v)
                yield u, v


def thinned(x: np.ndarray, forest: Forest) -> np.ndarray:
    """Sorted entries of which one stands for all of equal shingle, size and position: any other entry may link with all of them or
    with none, and they may link with each other, so they are joined here."""
    x = x[np.lexsort((x["p"], x["n"], x["t"]))]
    if not len(x):
        return x
    lead = np.concatenate(([True], (x["t"][1:] != x["t"][:-1]) | (x["n"][1:] != x["n"][:-1]) | (x["p"][1:] != x["p"][:-1])))
    first = x["v"][np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    for u, v in np.unique(np.stack([first[~lead], x["v"][~lead]], 1), axis=0).tolist():
        forest.join(u, v)
    return x[lead]


def candidates(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Edges (a, b) that join all sets which may link; per task a spanning forest. shared: the sketch."""
    spark = docs.sparkSession
    parts = min(PARTS, 16 * shuffle_partitions(spark))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, held, size = shared.value, set(), [], 0
        forest = Forest()

        def rows(entries: np.ndarray) -> pa.RecordBatch:
            part = (entries["t"] >> U64(40)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            entries, part = entries[order], part[order]
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            cut = np.append(at, len(part)).tolist()
            raw = entries.tobytes()
            return pa.record_batch([pa.array(part[at].astype(np.int32)), pa.array([raw[24 * a : 24 * b] for a, b in zip(cut, cut[1:])], pa.binary())], names=["part", "entries"])

        for batch in batches:
            for chunk in chunks(as_bytes(batch.column(0))):
                g, n = shingles(chunk)
                node = digests(g, n)
                fresh = _first_seen(node, seen)
                g, doc = g[np.repeat(fresh, n)], np.repeat(np.flatnonzero(fresh), n[fresh])
                rarity = counted(counts, g)
                order = np.lexsort((g, rarity, doc))
                g, doc, rarity = g[order], doc[order], rarity[order]
                m = n[fresh]
                place = np.arange(len(g)) - np.repeat(np.cumsum(m) - m, m)
                # a shingle that is counted once is in no other set
                keep = (place < np.repeat(m + (-4 * m) // 5 + 1, m)) & (rarity > 1)
                out = np.zeros(int(keep.sum()), ENTRY)
                out["t"], out["v"], out["n"], out["p"] = g[keep], node[doc[keep]], n[doc[keep]], place[keep]
                held.append(out)
                size += len(out)
                if size > 400_000:
                    entries = thinned(np.concatenate(held), forest)
                    if len(entries) > 200_000:  # else what is left is kept, and thinned with what follows
                        yield rows(entries)
                        entries = entries[:0]
                    held, size = [entries], len(entries)
        # edges made here travel as entries of a list of their own
        entries = thinned(np.concatenate(held), forest) if held else np.zeros(0, ENTRY)
        made = forest.edges()
        lists = np.zeros(2 * made.num_rows, ENTRY)
        lists["v"] = np.stack([made.column(0).to_numpy(), made.column(1).to_numpy()], 1).reshape(-1)
        lists["t"] = np.repeat(mix(lists["v"][::2].astype(U64)), 2)
        lists["n"] = 1
        entries = np.concatenate((entries, lists))
        if len(entries):
            yield rows(entries)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [x for batch in batches for x in batch.column(1).to_pylist()]
        if not raw:
            return
        forest = Forest()
        e = np.frombuffer(b"".join(raw), ENTRY)
        del raw
        e = thinned(e, forest)
        t = e["t"]
        at = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        size = np.diff(np.append(at, len(t)))
        two = at[size == 2]
        a, b = e[two], e[two + 1]
        fits = _may_link(a, b) & (a["v"] != b["v"])
        for u, v in zip(a["v"][fits].tolist(), b["v"][fits].tolist(), strict=True):
            forest.join(u, v)
        for i, k in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            for u, v in _list_edges(e[i : i + k]):
                forest.join(u, v)
        yield forest.edges()

    lists = docs.select("text").mapInArrow(index, "part int, entries binary").repartition(shuffle_partitions(spark), "part")
    return lists.mapInArrow(join, "a long, b long")


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, node (null if empty) and n of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(as_bytes(batch.column(1))):
                g, n = shingles(chunk)
                yield pa.record_batch([batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo), pa.array(digests(g, n), mask=n == 0), pa.array(n)], names=["doc_id", "node", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node long, n long")


def shared_shingles(docs: DataFrame, wanted: Broadcast, shared: Broadcast) -> DataFrame:
    """node and, once a task, the shingles of a set in the filter, but for those that the sketch counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for chunk in chunks(as_bytes(batch.column(0))):
                g, n = shingles(chunk)
                node = digests(g, n)
                ship = np.flatnonzero(_first_seen(node, seen) & passes(wanted.value, pa.array(node)))
                end = np.cumsum(n)
                sets = [g[end[i] - n[i] : end[i]] for i in ship.tolist()]
                yield pa.record_batch([pa.array(node[ship]), pa.array([x[counted(shared.value, x) > 1].tobytes() for x in sets], pa.binary())], names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles binary")


def compare(sets: list[np.ndarray], size: np.ndarray, side: np.ndarray, cross: bool) -> Iterator[tuple[int, int]]:
    """Index pairs of linked sets: all pairs, or if cross those between side 0 and side 1. size counts also shingles left out of a set.

    The overlaps of a set with all others come from those of the most similar set done before it, corrected by the
    lists of the shingles in which the two differ; the first of its kind reads all its lists.
    """
    m = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    token, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count[back] > 1
    back, owner = back[common], owner[common]  # shingles of one set only never count
    order = np.argsort(back, kind="stable")
    posting, key = owner[order], back[order]
    first = np.searchsorted(key, np.arange(len(token)))
    length = np.searchsorted(key, np.arange(len(token)), "right") - first
    own = [back[a:b] for a, b in zip(np.searchsorted(owner, np.arange(m)).tolist(), np.searchsorted(owner, np.arange(m), "right").tolist(), strict=True)]

    def add(tokens: np.ndarray) -> np.ndarray:
        n = length[tokens]
        end = np.cumsum(n)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(first[tokens] - (end - n), n)
        return np.bincount(posting[at], minlength=m)

    kept: dict[int, np.ndarray] = {}  # overlaps of a few sets that others are derived from
    nearest = np.full(m, -1)
    nearest_overlap = np.zeros(m, np.int64)
    for x in np.argsort(size, kind="stable").tolist():
        y = int(nearest[x])
        if y >= 0 and y in kept and 2 * nearest_overlap[x] > len(own[x]):
            more, less = np.setdiff1d(own[x], own[y], assume_unique=True), np.setdiff1d(own[y], own[x], assume_unique=True)
            overlap = kept[y] + add(more) - add(less)
        else:
            overlap = add(own[x])
        hit = 100 * overlap >= 80 * (size[x] + size - overlap)
        hit[x] = False
        for z in np.flatnonzero(hit).tolist():
            if z > x and (not cross or side[x] != side[z]):
                yield x, z
        if len(kept) >= 64:
            kept.pop(next(iter(kept)))
        kept[x] = overlap
        better = overlap > nearest_overlap
        nearest[better], nearest_overlap[better] = x, overlap[better]


def _verify(table: pa.Table) -> pa.Table:
    """One block pair of a candidate component: forest of links, and each set's weighted number of links."""
    node = table["node"].to_numpy()
    _, at = np.unique(np.stack([node, table["side"].to_numpy()]), axis=1, return_index=True)
    node, side, weight = node[at], table["side"].to_numpy()[at], table["copies"].to_numpy()[at]
    blobs = table["shingles"].take(pa.array(at)).to_pylist()
    sets = [np.frombuffer(x, U64) for x in blobs]
    links, forest = np.zeros(len(node), np.int64), Forest()
    for x, z in compare(sets, table["n"].to_numpy()[at], side, table["i"][0].as_py() != table["j"][0].as_py()):
        links[x] += weight[z]
        links[z] += weight[x]
        forest.join(int(node[x]), int(node[z]))
    linked = np.flatnonzero(links)
    return pa.table({"a": pa.array(node[linked]), "b": pa.array([forest.find(int(v)) for v in node[linked]], pa.int64()), "links": pa.array(links[linked])})


ORACLE = """
with recursive lowered as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
shingle as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as s from lowered),
size as (select l.doc_id, count(s.s) as n from lowered l left join shingle s on l.doc_id = s.doc_id group by l.doc_id),
often as (select s from shingle group by s having count(*) > 1),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as k
  from (select * from shingle semi join often using (s)) a join (select * from shingle semi join often using (s)) b on a.s = b.s and a.doc_id <> b.doc_id group by all),
link as (select x, y from shared join size p on x = p.doc_id join size q on y = q.doc_id where 100 * k >= 80 * (p.n + q.n - k)),
reach(x, y) as (select doc_id, doc_id from size union select r.x, l.y from reach r join link l on r.y = l.x)
select s.doc_id, s.n as n_shingles, (select min(y) from reach r where r.x = s.doc_id) as component_id,
  (select count(*) from link l where l.x = s.doc_id) as n_links
from size s"""


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other documents linked) for every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs))
    maybe = components(candidates(docs, shared), forest=True)
    rows = saved(nodes(docs), "nodes")
    per_node = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("n").alias("n"))
    member = saved(maybe.join(per_node, "node"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    blocked = member.join(member.groupBy("root").agg(blocks.alias("blocks")), "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block pairs (i, j), i <= j, that a set of block `own` takes part in; side tells the two blocks apart
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (k < F.col("own")).cast("int").alias("side")))
    dealt = blocked.select("root", "node", "copies", "n", F.explode(pairs).alias("x")).select("root", "node", "copies", "n", "x.*")
    wanted = bloom(maybe, "node")
    sets = shared_shingles(docs, wanted, shared)
    # few block members go to the sets' tasks whole, so that sets are shuffled once; beyond that bound both sides are shuffled
    few = member.count() <= SMALL_SIDE and dealt.count() <= SMALL_SIDE
    dealt = F.broadcast(dealt) if few else dealt.hint("merge")
    links = saved(sets.join(dealt, "node").groupBy("root", "i", "j").applyInArrow(_verify, "a long, b long, links long"), "links")
    for used in (shared, wanted):
        used.unpersist()
    label = components(links.select("a", "b"))
    # the smallest doc_id of each component, then one row a set with copies or links
    node_min = per_node.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = node_min.groupBy("root").agg(F.min("least").alias("component_id"))
    found = node_min.join(least, "root").join(links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "node", "left")
    found = found.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc_id", "node", "n").join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
