"""Moving ranks against counting, and cases of the two axes."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.calendar import sessions
from tidemark.operators import axes
from tidemark.operators.moving import Rank, ranked
from tidemark.plans import axes as plans


def count_rank(values, i, r):
    window = [v for v in values[max(0, i - r.rows + 1) : i + 1] if v is not None and not math.isnan(v)]
    if values[i] is None or math.isnan(values[i]) or len(window) < (r.least or r.rows):
        return None
    return 0.5 if r.even and min(window) == max(window) else sum(v <= values[i] for v in window) / len(window)


def test_moving_ranks_equal_counting(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.choice([None, float("nan"), 1.0, 2.0, rng.random()])) for k in ("a", "b", None) for i in range(150)]
    d = spark.createDataFrame(rows, "k string, i int, v double")
    ranks = {"full": Rank("v", 5), "some": Rank("v", 20, 3), "even": Rank("v", 2, 1, True)}
    for r in ranked(d, ["k"], "i", ranks).collect():
        values = [v for k, _, v in rows if k == r["k"]]
        for name, rank in ranks.items():
            assert r[name] == count_rank(values, r["i"], rank)
    assert ranked(d.limit(0), ["k"], "i", ranks).count() == 0
    long = np.random.default_rng(1).random(3000)
    assert np.allclose(Rank("v", 1000, 1).over(long)[999:], [(long[i - 999 : i + 1] <= long[i]).mean() for i in range(999, 3000)])


def test_self_history_of_adx(spark, sf):
    h = plans.self_history(spark, sf).where("symbol in ('S1', 'S2')").orderBy("symbol", "session").collect()
    for s in ("S1", "S2"):
        rows = [r for r in h if r["symbol"] == s]
        for c in plans.SELF:
            values = [r[c] for r in rows]
            assert [r[f"{c}_pctl"] for r in rows] == [count_rank(values, i, Rank(c, 120)) for i in range(len(rows))]


def posts_of(spark, rows):
    d = spark.createDataFrame([(i, s, src, f"2024-01-{day:02d} 12:00:00", a, p, 10.0) for i, (s, src, day, a, p) in enumerate(rows)], "post_id long, symbol string, source string, created_at string, author long, polarity double, engagement double")
    facts = {c: F.lit(100.0) for c in ("author_age_days", "author_karma", "author_followers")}
    return d.withColumns({"created_at": F.to_timestamp("created_at"), "kind": F.lit("social"), **facts}).withColumn("session", F.to_date("created_at"))


def test_missing_sources_have_no_weight_and_tallies_no_polarity(spark):
    plan = axes.Axes({"forum": 0.2, "wire": 0.1}, ("tally",), least_posts=2, least_authors=2, least_history=2, least_growth=1)
    rows = [("A", "forum", 3, a, 0.6) for a in (1, 2)] + [("A", "wire", 3, 1, -0.6)]  # the wire is too small
    rows += [("B", "news", 3, a, -0.3) for a in (1, 2)]  # no slot: all together stand in
    rows += [("C", "tally", d, a, 0.9) for d, n in ((2, 2), (3, 2), (4, 40)) for a in range(n)]  # a tally never is polarity, nor its posts alone
    rows += [("D", "forum", 3, 1, 0.5)]  # too small for any
    read = axes.with_growth(axes.readings(posts_of(spark, rows)), sessions(spark, "2023-12-01", "2024-02-01"), plan)
    got = {(r["symbol"], r["session"].day, r["direction"]): r for r in axes.score(read, plan).collect()}
    a = got["A", 3, "long"]
    assert (a["forum_weight"], a["wire_weight"], a["measured"]) == (0.2, 0.0, "forum") and a["forum_score"] == 100.0 and a["wire_score"] == 50.0 and got["A", 3, "short"]["forum_score"] == 0.0
    b = got["B", 3, "long"]
    assert (b["forum_weight"], b["wire_weight"], b["measured"]) == (0.1, 0.05, "all") and abs(b["forum_score"] - 25) < 1e-6 and b["forum_score"] == b["wire_score"]
    c = got["C", 4, "long"]
    assert c["tallies"] == "tally" and got["C", 2, "long"]["tallies"] == "" and c["attention_score"] > 90 and c["attention_weight"] == 0.1
    d = got["D", 3, "long"]
    assert (d["forum_weight"], d["wire_weight"], d["measured"], d["forum_score"]) == (0.0, 0.0, "", 50.0)
