"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._io import saved

ROUNDS = 60
_EDGE = "a long, b long"


class Forest:
    """Union-find over 64-bit ids; the smaller root wins."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        members = list(self.up)
        return pa.record_batch([pa.array(members, pa.int64()), pa.array([self.find(x) for x in members], pa.int64())], names=["a", "b"])


def local_forest(edges: DataFrame) -> DataFrame:
    """Edges of each partition cut down to a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            if len(forest.up) > 1_000_000:
                yield forest.edges()
                forest = Forest()
        yield forest.edges()

    return edges.select("a", "b").mapInArrow(run, _EDGE)


def components(edges: DataFrame, forest: bool = False) -> DataFrame:
    """(node, root) of every node of edges(a, b): root is the least node that it reaches. forest: each partition's
    edges are one already."""
    now = saved((edges if forest else local_forest(edges)).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(ROUNDS):
        # large star: greater neighbours of a node go to the least of all its neighbours and itself
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its lesser neighbours go to the least of them
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor).where("a <> b").distinct()
        now = saved(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return saved(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "components")


def as_int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))
