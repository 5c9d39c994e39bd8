"""Transcript parsing: a hidden Markov model recovers the role of each segment, then turns are rendered canonically.

A turn's text is cut into segments at lines that open with a speaker marker ("User:", "### Assistant >"). A segment's
features are its marker (of its own line, else of the turn's role column if that is observed and names a role), its length class,
whether it ends in a question, whether it has several lines and whether its turn is the first. Viterbi finds the likeliest roles
of a conversation. Emissions of the line features and transitions are counted over all labelled turns.

A conversation may be long: it is cut into blocks of BLOCK turn numbers, and a block of more than SPLIT turns (many with equal or no
numbers) is cut further along the turns' order. Each block gives its max-plus transfer matrix
(3 x 3); a pass over a conversation's few matrices gives the best scores before and after each block; each block
is then decoded on its own. A task holds a block's turns at a time: some SPLIT, or as many as there are equal rows.

Defined results: a null or empty text is one empty segment; a null or unknown role is no marker, and the model decides; turns
with equal numbers keep an order by a hash of role and text, then by these; null conv_ids form one conversation, null turns count as 0; an empty
table gives an empty result; only the named columns are read. Equal scores go to the earlier of system, user, assistant.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROLES = ("system", "user", "assistant")
BLOCK = 512
SPLIT = 4 * BLOCK
#: Names that transcripts use for the roles.
NAMES = {"system": 0, "instruction": 0, "user": 1, "human": 1, "question": 1, "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "answer": 2}
MARKER = re.compile(r"^[ \t]*(?:#{1,6}[ \t]*)?\[?(" + "|".join(NAMES) + r")\]?[ \t]*[:>][ \t]*", re.IGNORECASE)
MARKED, UNMARKED, OTHER = np.log(0.98), np.log(0.02), np.log(1e-5)
LENGTHS = 12
SCHEMA = "conv_id long, turn long, role string, n_segments int, roles array<string>, rendered string"


def segments(text: str | None, role: str | None) -> list[tuple[int, str]]:
    """(marked role or -1, text without marker) of a turn."""
    out: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        m = MARKER.match(line)
        if m:
            out.append((NAMES[m[1].lower()], [line[m.end() :]]))
        elif out:
            out[-1][1].append(line)
        else:
            out.append((NAMES.get((role or "").strip().lower(), -1), [line]))
    if len(out) > 1 and not "".join(out[0][1]).strip():
        out = out[1:]
    return [(m, "\n".join(lines)) for m, lines in out]


def features(text: str, first: bool) -> tuple[int, int, int, int]:
    return min(len(text).bit_length(), LENGTHS), int(text.rstrip().endswith("?")), int("\n" in text), int(first)


class Model:
    def __init__(self, counts: list[np.ndarray], moves: np.ndarray, starts: np.ndarray):
        """counts[k][role, value] for each line feature; moves[from, to]; starts[role]."""
        self.emit = [np.log((c + 1) / (c + 1).sum(1, keepdims=True)) for c in counts]
        self.move = np.log((moves + 1) / (moves + 1).sum(1, keepdims=True))
        self.start = np.log((starts + 1) / (starts + 1).sum())

    def scores(self, turns: list[tuple[str | None, str | None, bool]]) -> tuple[np.ndarray, list[list[str]]]:
        rows, texts = [], []
        for text, role, first in turns:
            parts = segments(text, role)
            texts.append([t for _, t in parts])
            for marker, t in parts:
                e = sum(table[:, v] for table, v in zip(self.emit, features(t, first), strict=True))
                seen = np.full(3, UNMARKED if marker < 0 else OTHER)
                if marker >= 0:
                    seen[marker] = MARKED
                rows.append(e + seen)
        return np.array(rows), texts

    def transfer(self, scores: np.ndarray) -> np.ndarray:
        """Best score from each role before the block to each role at its end."""
        m = np.where(np.eye(3, dtype=bool), 0.0, -np.inf)
        for e in scores:
            m = (m[:, :, None] + self.move[None]).max(1) + e
        return m

    def decode(self, scores: np.ndarray, before: np.ndarray, opens: bool, after: np.ndarray) -> list[int]:
        back, now = [], before
        for i, e in enumerate(scores):
            step = (self.start[None].repeat(3, 0) if opens and i == 0 else self.move) + now[:, None]
            back.append(step.argmax(0))
            now = step.max(0) + e
        state = int((now + after).argmax())
        path = []
        for pointers in reversed(back):
            path.append(state)
            state = int(pointers[state])
        return path[::-1]


def _blocks(conversations: DataFrame) -> DataFrame:
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn.alias("at"), F.xxhash64("role", "text").alias("tie"), F.floor(turn / BLOCK).alias("wide"), "role", "text")
    per_turn = rows.groupBy(F.col("conv_id").alias("c"), F.col("at").alias("t"), F.col("wide").alias("w")).agg(F.count("*").alias("n"))
    wide = per_turn.groupBy(F.col("c").alias("bc"), F.col("w").alias("bw")).agg(F.sum("n").alias("all")).where(F.col("all") > SPLIT).drop("all")
    big = per_turn.join(wide, per_turn["c"].eqNullSafe(wide["bc"]) & (per_turn["w"] == wide["bw"])).select("c", "t", F.ceil(F.col("n") / SPLIT).alias("parts"))
    cut = rows.join(big, rows["conv_id"].eqNullSafe(big["c"]) & (rows["at"] == big["t"]), "left")
    # in a big block each turn number is a block of its own, and one with many turns is cut along their hashes
    part = F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("parts")), F.col("parts") - 1)
    block = F.when(F.col("parts").isNull(), F.col("wide") * BLOCK * (1 << 24)).otherwise(F.col("at") * (1 << 24) + part)
    return cut.withColumn("block", block).select("conv_id", "turn", "at", "tie", "block", "role", "text")


def fit(conversations: DataFrame) -> Model:
    rows = _blocks(conversations)
    known = F.lower(F.trim("role"))
    code = F.when(known.isin(*NAMES), F.element_at(F.create_map(*(x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v)))), known))
    labelled = rows.withColumn("code", code).where("code is not null")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            total: dict[tuple[int, int, int], int] = {}
            for c, at, text in zip(f["code"], f["at"], f["text"], strict=True):
                for marker, t in segments(text, ROLES[c]):
                    for k, v in enumerate(features(t, at == 0)):
                        key = (k, marker, v)
                        total[key] = total.get(key, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["feature", "role", "value", "n"])

    sizes = (LENGTHS + 1, 2, 2, 2)
    counts = [np.zeros((3, s)) for s in sizes]
    for r in labelled.select("code", "at", "text").mapInPandas(count, "feature int, role int, value int, n long").groupBy("feature", "role", "value").agg(F.sum("n").alias("n")).collect():
        counts[r["feature"]][r["role"], r["value"]] = r["n"]
    # neighbours within a block; the last turn of a block is not followed into the next one, which counts alone
    w = Window.partitionBy("conv_id", "block").orderBy("at", "tie", "role", "text")
    moves, starts = np.zeros((3, 3)), np.zeros(3)
    for r in labelled.withColumn("before", F.lag("code").over(w)).groupBy("before", "code", (F.col("at") == 0).alias("opens")).count().collect():
        if r["before"] is not None:
            moves[r["before"], r["code"]] += r["count"]
        elif r["opens"]:
            starts[r["code"]] += r["count"]
    return Model(counts, moves, starts)


def render(roles: list[int], texts: list[str]) -> str:
    """Neighbouring segments of one role are one message."""
    out: list[tuple[int, list[str]]] = []
    for role, text in zip(roles, texts, strict=True):
        if out and out[-1][0] == role:
            out[-1][1].append(text)
        else:
            out.append((role, [text]))
    return "".join(f"<|{ROLES[r]}|>\n{chr(10).join(t).strip()}\n<|end|>\n" for r, t in out)


def parse(conversations: DataFrame, model: Model, observed: bool = True) -> DataFrame:
    """For every turn: its recovered roles, the first of them, and its canonical rendering.

    observed: the role column, where it names a role, is seen as a marker of the turn's first line. Without it roles follow from markers in
    the text, line features and neighbours alone."""
    rows = _blocks(conversations)

    def turns_of(group: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        rows = sorted(group, key=lambda r: (r[3], r[4], r[5] is not None, r[5] or "", r[6] is not None, r[6] or ""))
        return rows, [(r[6], r[5] if observed else None, r[3] == 0) for r in rows]

    def matrix(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        scores, _ = model.scores(turns_of(group)[1])
        yield (*key, scores[0].tolist(), model.transfer(scores).reshape(-1).tolist(), model.transfer(scores[1:]).reshape(-1).tolist())

    def chain(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        blocks = sorted(group, key=lambda r: r[1])
        ms = [np.array(r[3]).reshape(3, 3) for r in blocks]
        before = [np.zeros(3)]
        # the first block opens with the start scores instead of a move
        now = (np.array(blocks[0][4]).reshape(3, 3) + (model.start + np.array(blocks[0][2]))[:, None]).max(0)
        for m in ms[1:]:
            before.append(now)
            now = (now[:, None] + m).max(0)
        after = [np.zeros(3)]
        for m in ms[:0:-1]:
            after.append((m + after[-1]).max(1))
        for i, (r, x, y) in enumerate(zip(blocks, before, after[::-1], strict=True)):
            yield key[0], r[1], i == 0, x.tolist(), y.tolist()

    def decode(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        rows, turns = turns_of(group)
        scores, texts = model.scores(turns)
        path = model.decode(scores, np.array(rows[0][8]), rows[0][7], np.array(rows[0][9]))
        i = 0
        for r, parts in zip(rows, texts, strict=True):
            roles = path[i : i + len(parts)]
            i += len(parts)
            yield key[0], r[2], ROLES[roles[0]], len(parts), [ROLES[x] for x in roles], render(roles, parts)

    arrays = "first_scores array<double>, m array<double>, rest array<double>"
    matrices = _grouped(rows.select("conv_id", "block", "turn", "at", "tie", "role", "text"), 2, matrix, f"conv_id long, block long, {arrays}")
    edges = _grouped(matrices, 1, chain, "conv_id long, block long, opens boolean, before array<double>, after array<double>")
    e = edges.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "opens", "before", "after")
    joined = rows.join(e, rows["conv_id"].eqNullSafe(e["c"]) & (rows["block"] == e["b"]))
    return _grouped(joined.select("conv_id", "block", "turn", "at", "tie", "role", "text", "opens", "before", "after"), 2, decode, SCHEMA)


def _grouped(rows: DataFrame, keys: int, f, schema: str) -> DataFrame:
    """f(key, rows) for each group of equal values in the first columns: groups lie together and stream through a task, so
    that many small ones cost no call of their own."""
    names = rows.columns[:keys]
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        held: list[tuple] = []
        for key, group in groupby(stream(), key=lambda r: r[:keys]):
            held.extend(f(key, list(group)))
            if len(held) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, out)
