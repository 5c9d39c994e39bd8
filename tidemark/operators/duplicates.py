"""Groups of duplicate posts of a symbol: equal texts, then leaders over similar ones.

The rule is a loop over posts in order: a post that no earlier leader is similar to becomes a leader, any other joins its
earliest similar leader. It runs here in rounds over the edges: a post is decided once all earlier posts that it is similar to
are, so each round decides the local minima among those left; rounds are as many as the longest such chain.

Similar pairs come from prefixes in order of rarity: two sets with a Jaccard similarity of s share a word among the first
n - ceil(s n) + 1 of each, rarest words first, so common words join nothing. Equal sets of words stand in one row and are
spread over their posts only where links need it.

Defined results: null and empty texts have no words and group only by equal text (nulls with nothing); repeated rows of a post_id
count once; ties in order go by post_id; an empty table gives no groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.store import saved

SIMILAR = 0.75
WORDS = r"([a-z0-9']+)"


def similar_sets(sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Pairs a < b of sets(symbol, set_id, words) of one symbol with a Jaccard similarity of at least `least`."""
    each = sets.where(F.size("words") > 0).select("symbol", "set_id", F.explode("words").alias("word"))
    rarity = each.groupBy("word").agg(F.count("*").alias("n"))
    ranked = each.join(rarity, "word").groupBy("symbol", "set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda s: s["word"]).alias("words"))
    size = F.size("words")
    first = ranked.withColumn("word", F.explode(F.slice("words", 1, (size - F.ceil(size * F.lit(least)) + 1).cast("int"))))
    a, b = (first.select("symbol", "word", F.col("set_id").alias(k), F.col("words").alias(f"w{k}")) for k in "ab")
    near = (F.col("a") < F.col("b")) & (F.size("wa") >= F.ceil(F.size("wb") * F.lit(least))) & (F.size("wb") >= F.ceil(F.size("wa") * F.lit(least)))
    pairs = a.join(b, ["symbol", "word"]).where(near)
    shared = F.size(F.array_intersect("wa", "wb"))
    linked = pairs.where(shared >= F.lit(least) * (F.size("wa") + F.size("wb") - shared))
    return linked.select("symbol", "a", "b").distinct()


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol, id, leader of nodes(symbol, id) by edges(symbol, a, b), a before b; a leader leads itself."""
    edges = saved(edges, "edges")
    state = saved(nodes.select("symbol", "id").distinct().withColumn("leader", F.lit(None).cast("long")), "leaders")
    while True:
        earlier = edges.join(state.select("symbol", F.col("id").alias("a"), F.col("leader").alias("a_leader")), ["symbol", "a"])
        seen = earlier.groupBy("symbol", F.col("b").alias("id")).agg(
            F.min(F.when(F.col("a_leader") == F.col("a"), F.col("a"))).alias("joins"), F.count_if(F.col("a_leader").isNull()).alias("waiting")
        )
        # a post may join only once no undecided earlier post could still lead it
        sooner = F.when(F.coalesce("waiting", F.lit(0)) == 0, F.coalesce("joins", "id"))
        state = saved(state.join(seen, ["symbol", "id"], "left").select("symbol", "id", F.coalesce("leader", sooner).alias("leader")), "leaders")
        if state.where("leader is null").limit(1).count() == 0:
            return state


def groups(posts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """symbol, post_id, group_id (its first post_id), kind (`equal`, `similar`) of posts(symbol, post_id, text) in groups of two or more."""
    one = posts.groupBy("symbol", "post_id").agg(F.max("text").alias("text"))
    key = F.when(F.col("text").isNotNull(), F.sha2("text", 256)).otherwise(F.concat(F.lit("none "), F.col("post_id").cast("string")))
    keyed = saved(one.withColumn("key", key).drop("text"), "post-keys")
    sizes = keyed.groupBy("symbol", "key").agg(F.count("*").alias("n"), F.min("post_id").alias("group_id"))
    equal = keyed.join(sizes.where("n > 1"), ["symbol", "key"]).select("symbol", "post_id", "group_id", F.lit("equal").alias("kind"))
    single = saved(sizes.where("n = 1").select("symbol", F.col("group_id").alias("id")), "single-posts")
    texts = one.join(single.withColumnRenamed("id", "post_id"), ["symbol", "post_id"])
    worded = texts.select("symbol", "post_id", F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORDS)))).alias("words"))
    sets = saved(worded.where(F.size("words") > 0).groupBy("symbol", "words").agg(F.min("post_id").alias("set_id")), "word-sets")
    member = saved(worded.join(sets, ["symbol", "words"]).select("symbol", "post_id", "set_id"), "set-members")
    # posts with one set of words are similar to the same posts: the first of them decides for all
    led = leaders(sets.select("symbol", F.col("set_id").alias("id")), similar_sets(sets, least))
    similar = member.join(led.withColumnRenamed("id", "set_id"), ["symbol", "set_id"]).select("symbol", "post_id", F.col("leader").alias("group_id"))
    several = similar.groupBy("symbol", "group_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return equal.unionByName(similar.join(several, ["symbol", "group_id"]).select("symbol", "post_id", "group_id", F.lit("similar").alias("kind")))
