"""A Bloom filter of ids with a fixed size, made on the executors: it thins out texts before a join.

It never loses an id. Once it holds more ids than it has bits it lets most rows through, and the join
that follows does the rest; results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidemark.llm._kernels import U64, mix

BITS = 1 << 25


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).astype(U64)) >> U64(64 - 25)).astype(np.int64)


def bloom(ids: DataFrame, column: str) -> Broadcast:
    """The filter, broadcast: at most BITS / 64 words. Of binary ids the first eight bytes count."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).drop_null()
            if pa.types.is_binary(known.type):
                known = np.frombuffer(b"".join(x[:8] for x in known.to_pylist()), "<i8")
            else:
                known = known.to_numpy(zero_copy_only=False)
            bit = np.unique(_bit(known))
            word, first = np.unique(bit >> 6, return_index=True)
            value = np.bitwise_or.reduceat(U64(1) << (bit & 63).astype(U64), first) if len(bit) else np.zeros(0, U64)
            yield pa.record_batch([pa.array(word), pa.array(value.view(np.int64))], names=["word", "bits"])

    chosen = F.col(column) if ids.schema[column].dataType == BinaryType() else F.col(column).cast("long")
    table = ids.select(chosen.alias("id")).mapInArrow(words, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out)


def passes(filter_words: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Which ids may be in the filter; a null never is."""
    bit = _bit(ids.fill_null(0).to_numpy(zero_copy_only=False))
    hit = (filter_words[bit >> 6].view(U64) >> (bit & 63).astype(U64)) & U64(1)
    return (hit == 1) & ids.is_valid().to_numpy(zero_copy_only=False)


def thinned(rows: DataFrame, column: str, shared: Broadcast, inside: bool = True) -> DataFrame:
    """The rows whose id may be in the filter, or else those whose id isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            yield batch.filter(pa.array(passes(shared.value, batch.column(at).cast(pa.int64())) == inside))

    return rows.mapInArrow(run, rows.schema)


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id is not among ids (null ids stay). Only rows that the filter can't clear are shuffled."""
    shared = bloom(ids, column)
    doubtful = thinned(rows, column, shared).join(ids.select(column).hint("merge"), column, "left_anti").select(rows.columns)
    return thinned(rows, column, shared, inside=False).unionByName(doubtful)
