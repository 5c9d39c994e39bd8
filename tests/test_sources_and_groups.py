"""The post source by batch and stream, and duplicate groups against the plain loop."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import duplicates
from tidemark.plans import posts_extra
from tidemark.sources import post_source


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def post(i, day=1, **more):
    return {"external_id": i, "created_at": f"2024-01-{day:02d}T10:00:00+00:00", "author": f"a{i % 3}", "symbol": "S1", "text": f"text {i}", "engagement": i} | more


def test_batch_and_stream_give_the_same_posts(spark, tmp_path):
    a, b = tmp_path / "forum", tmp_path / "wire"
    write(a, "001.jsonl", [post(1), post(2, 2), post(1), "", '{"external_id": 3}', "no json", post(4, created_at="yesterday")])
    write(b, "001.jsonl", [post(1, 3, text=None, author=None), post(9, 4)])
    (a / "notes.txt").write_text("not posts")
    sources = {"forum": str(a), "wire": str(b), "gone": str(tmp_path / "gone")}
    posts, failures = post_source.fetch(spark, sources)
    assert sorted((r["source"], r["external_id"]) for r in posts.collect()) == [("forum", "1"), ("forum", "2"), ("wire", "1"), ("wire", "9")]
    assert sorted((r["source"], r["error"]) for r in failures.collect()) == [("forum", "001.jsonl line 5: KeyError"), ("forum", "001.jsonl line 6: JSONDecodeError"), ("forum", "001.jsonl line 7: ValueError"), ("gone", "FileNotFoundError")]
    import datetime as dt

    late, _ = post_source.fetch(spark, sources, since=dt.datetime(2024, 1, 2, 10, tzinfo=dt.UTC), until=dt.datetime(2024, 1, 3, 10, tzinfo=dt.UTC))
    assert [(r["source"], r["external_id"]) for r in late.collect()] == [("wire", "1")]

    def run(k):
        for rows, name in zip(post_source.follow(spark, sources), ("posts", "failures"), strict=True):
            q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out/{name}").option("checkpointLocation", f"{tmp_path}/check/{name}").trigger(availableNow=True).start()
            q.awaitTermination(120)

    run(1)
    write(a, "002.jsonl", [post(5, 4), post(2, 2)])
    write(tmp_path / "gone", "001.jsonl", [post(7, 4)])
    run(2)
    run(3)
    streamed = spark.read.parquet(f"{tmp_path}/out/posts").collect()
    assert sorted((r["source"], r["external_id"]) for r in streamed) == sorted((r["source"], r["external_id"]) for r in post_source.fetch(spark, sources)[0].collect())
    assert sum(r["source"] == "gone" for r in spark.read.parquet(f"{tmp_path}/out/failures").collect()) == 1


def loop(posts, least):
    """Groups of one symbol's posts(id, text): equal texts, then a loop over the rest."""
    import re

    by = {}
    for i, t in posts:
        by.setdefault(t if t is not None else ("none", i), []).append(i)
    out = {i: (min(g), "equal") for g in by.values() if len(g) > 1 for i in g}
    text = dict(posts)
    left = sorted(g[0] for g in by.values() if len(g) == 1)
    words = {i: set(re.findall(r"[a-z0-9']+", (text[i] or "").lower())) for i in left}
    taken = set()
    for k, i in enumerate(left):
        if i in taken:
            continue
        group = [i] + [j for j in left[k + 1 :] if j not in taken and words[i] and words[j] and len(words[i] & words[j]) >= least * len(words[i] | words[j])]
        if len(group) > 1:
            taken |= set(group)
            out |= {j: (i, "similar") for j in group}
    return out


def test_groups_equal_the_loop(spark):
    rng, rows = random.Random(4), []
    for s in ("A", "B", None):
        base = [rng.choice("abcdefghij") * 2 + str(k) for k in range(8)]
        for i in range(120):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(8)] = rng.choice(["one", "two", "three", "four"])
            rng.shuffle(w)
            rows.append((s, i, rng.choice([" ".join(w), " ".join(w).upper(), " ".join(base), None, "", "??", "lone " + str(i)])))
    rows += rows[:5]
    d = spark.createDataFrame(rows, "symbol string, post_id long, text string").where("symbol is not null")
    got = {}
    for r in duplicates.groups(d).collect():
        got.setdefault(r["symbol"], {})[r["post_id"]] = (r["group_id"], r["kind"])
    assert got == {s: loop(sorted({(i, t) for x, i, t in rows if x == s}, key=lambda r: r[0]), 0.75) for s in ("A", "B")}
    assert {k for v in got["A"].values() for k in v[1:]} == {"equal", "similar"}


def test_leaders_follow_long_chains(spark):
    """1-2-3-...: odd ones lead, each even one joins the one before."""
    nodes = spark.range(1, 10).select(F.lit("A").alias("symbol"), "id")
    edges = spark.range(1, 9).select(F.lit("A").alias("symbol"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["id"]: r["leader"] for r in duplicates.leaders(nodes, edges).collect()} == {i: i - (i % 2 == 0) for i in range(1, 10)}
    assert duplicates.groups(spark.createDataFrame([], "symbol string, post_id long, text string")).count() == 0


def test_duplicate_groups_query_equals_the_loop(spark, sf):
    by = {}
    for r in posts_extra.notes(spark, sf).collect():
        by.setdefault(r["symbol"], []).append((r["post_id"], r["text"]))
    got = {(r["symbol"], r["post_id"]): (r["group_id"], r["kind"]) for r in posts_extra.duplicate_groups(spark, sf).collect()}
    assert got == {(s, i): v for s, p in by.items() for i, v in loop(sorted(p), 0.75).items()} and got
