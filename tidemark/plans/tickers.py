"""Ticker resolution over documents and conversations. The listings are made from the texts' own words, so that all kinds of evidence occur."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import resolver
from tidemark.registry import query
from tidemark.sources.adapters import table
from tidemark.sources.store import saved

LISTED, COMMON_SHARE, LEAST = 600, 50, 0.35
HELD = 500_000  # words that a task counts before it sends them


def commentary(spark: SparkSession, sf: str) -> DataFrame:
    """id, text of documents and turns: every third line in capitals, and words before a comma written as cash-tags where a line is even."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 2, F.upper(x)).when(i % 2 == 0, F.regexp_replace(x, r"\b([A-Za-z]{2,5}),", r"\$$1,")).otherwise(x))
    return docs.unionByName(turns).select("id", F.array_join(lines, "\n").alias("text"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """word and in how many texts it stands: counted in each task first, up to HELD words at a time."""
    word = re.compile("[a-z]+")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(set(word.findall((text or "").lower())))
                if len(seen) > HELD:
                    yield pa.record_batch([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
                    seen.clear()
        yield pa.record_batch([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("texts"))


def listings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The most frequent words of two to five letters with an even checksum as listings, named after their neighbour in that order; and
    words that stand in at least a fiftieth of all texts, which are common."""
    texts = commentary(spark, sf)
    words = saved(vocabulary(texts), "vocabulary")  # read by both
    top = words.where((F.length("word").between(2, 5)) & (F.crc32("word") % 2 == 0)).orderBy(F.desc("texts"), "word").limit(LISTED)  # a universe of fixed size
    w = Window.orderBy(F.desc("texts"), "word")  # over LISTED rows
    named = top.withColumn("n", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("word").over(w), F.lit("first")))
    name = F.when(F.col("n") % 3 == 0, F.concat(F.initcap("word"), F.lit(" Holdings, Inc."))).when(F.col("n") % 3 == 1, F.concat_ws(" ", F.initcap("word"), "next", F.lit("Corp"))).otherwise(F.concat(F.col("word"), F.lit(" plc")))
    total = F.broadcast(texts.agg(F.count("*").alias("all")))
    common = words.crossJoin(total).where(F.col("texts") * COMMON_SHARE >= F.col("all")).select("word")  # one row
    return named.select(F.upper("word").alias("symbol"), name.alias("name"), F.array(F.concat_ws(" ", "next", "word")).alias("aliases")), common


@query("ticker_mentions")
def ticker_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions with a confidence that makes them usable."""
    directory = resolver.Directory.of(*listings(spark, sf))
    terms = resolver.TERMS + ("tion", "ent", "ing", "der", "que", "los")  # endings that stand alone in the invented prose
    found = resolver.resolve(commentary(spark, sf), directory, terms, digest=True)
    return found.where(F.col("confidence") >= LEAST).select("id", "symbol", "method", "matched", F.col("context").alias("context_sha256"), "confidence")
