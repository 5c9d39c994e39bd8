"""Duplicate groups of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import duplicates
from tidemark.registry import query
from tidemark.sources.adapters import rich_posts


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, post_id, text: posts of a community about a symbol, with a third word that varies."""
    n = F.col("post_id")
    text = F.concat_ws(" ", "text", F.concat(F.lit("w"), (n % 4).cast("string")), F.concat(F.lit("v"), (n % 7).cast("string")))
    return rich_posts(spark, sf).select("symbol", "post_id", F.when(n % 17 != 0, text).alias("text"))


@query("duplicate_groups")
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each post that repeats another, with the first post of its group."""
    return duplicates.groups(notes(spark, sf))
