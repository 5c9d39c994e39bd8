"""Snapshots, versions, quarantine and cache against plain loops."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fetch_health, institutional, model_cache
from tidemark.plans import upkeep
from tidemark.sources.versions import VersionedTable


def test_bad_elements_go_one_by_one(spark):
    good = {"month": 3, "year": 2024, "shares_bought": 5, "insiders_buy_count": "4", "trans_sell_amount": None}
    payload = {"insider_monthly": [good, "x", None, 5, [1], {"month": 1}, {"month": "one", "year": 2024}, {"month": "2", "year": "2023"}],
               "recent_insider_transactions": [{"name": ""}, {"name": "A", "r_date": "2024-02-30", "is_officer": "yes"}, {"action": 1}],
               "hedge_fund_holdings_by_quarter": {"date": "2024-01-01"}, "notable_holder_moves": [{}, 3, {"stars": 4.5, "is_active": False}], "num_of_insiders": "many", "market_cap_usd": "1e9"}
    rows = spark.createDataFrame([("A", json.dumps(payload)), ("B", "{"), ("C", None), ("D", "[]"), ("A", json.dumps(payload))], "symbol string, payload string").withColumn("session", F.lit("2024-01-01").cast("date"))
    found = {r["symbol"]: r for r in institutional.read(rows).collect()}
    a = found["A"]
    assert [(m["month"], m["year"], m["shares_bought"], m["insiders_buy_count"], m["insiders_sell_count"]) for m in a["insider_monthly"]] == [(3, 2024, 5.0, 4, 0), (2, 2023, None, 0, 0)]
    assert [(t["name"], t["r_date"], t["is_officer"]) for t in a["recent_insider_transactions"]] == [("A", None, True)]
    assert a["hedge_fund_holdings_by_quarter"] == [] and [(m["stars"], m["is_active"], m["manager_name"]) for m in a["notable_holder_moves"]] == [(None, True, ""), (4.5, False, "")]
    assert a["num_of_insiders"] is None and a["market_cap_usd"] == 1e9 and not a["broken"]
    assert all(found[s]["broken"] and found[s]["insider_monthly"] == [] for s in "BCD")
    once = institutional.read(rows)
    again = institutional.read(institutional.write(once))
    assert sorted(map(str, again.drop("broken").collect())) == sorted(map(str, once.drop("broken").collect()))


def test_institutional_query_equals_python(spark, sf):
    got = {(r["symbol"], r["session"]): r for r in upkeep.institutional_payloads(spark, sf).collect()}
    for r in upkeep.payloads(spark, sf).collect():
        g = got[r["symbol"], str(r["session"])]
        try:
            d = json.loads(r["payload"])
        except ValueError:
            d = None
        months, quarters = [], []
        if isinstance(d, dict):
            months = [m for m in d["insider_monthly"] if isinstance(m, dict) and str(m["month"] or "").isdigit()]
            for h in d["hedge_fund_holdings_by_quarter"]:
                try:
                    quarters.append((dt.date.fromisoformat(h["date"]), h))
                except ValueError:
                    pass
        assert g["broken"] == (not isinstance(d, dict)) and g["same"]
        assert (g["months"], g["quarters"], g["complete"]) == (len(months), len(quarters), sum(h.get("is_complete", False) for _, h in quarters))
        assert (g["bought"], g["held"]) == (sum(m["trans_buy_amount"] for m in months), sum(h["holding_amount"] for _, h in quarters))
    assert any(g["months"] for g in got.values()) and any(g["broken"] for g in got.values())


def test_upsert_and_the_two_newest(spark):
    d = spark.createDataFrame([("A", f"2024-0{m}-01", str(m)) for m in range(1, 5)], "symbol string, session string, payload string").withColumn("session", F.to_date("session"))
    fresh = d.where("session = '2024-03-01'").withColumn("payload", F.lit("new")).unionByName(d.limit(1).withColumn("symbol", F.lit("B")))
    rows = institutional.upsert(d, fresh)
    assert sorted(tuple(r)[::2] for r in rows.collect()) == [("A", "1"), ("A", "2"), ("A", "4"), ("A", "new"), ("B", "1")]
    two = institutional.latest_and_previous(rows, F.lit("2024-03-15").cast("date")).where("symbol = 'A'")
    assert sorted((r["rank"], r["payload"]) for r in two.collect()) == [(1, "new"), (2, "2")]


def test_readers_see_one_version_or_another(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "day")
    rows = lambda *xs: spark.createDataFrame(list(xs), "day string, v int")
    see = lambda df: sorted(tuple(r) for r in df.collect())
    with pytest.raises(ValueError, match="no version"):
        t.read()
    assert t.write(rows(("a", 1), ("b", 1), (None, 9)), 1) == 1
    before = t.read()
    orphan = rows(("a", 7))
    orphan.write.parquet(f"{t.path}/data/{'0' * 32}")  # a writer that died before its manifest
    (tmp_path / "t/manifests/2").mkdir()  # and one that died within it
    assert t.versions() == [1] and t.read().count() == 3
    (tmp_path / "t/manifests/2").rmdir()
    assert t.write(rows(("a", 2), ("c", 2)), 2) == 2
    assert see(before.where("day is not null")) == [("a", 1), ("b", 1)]  # the old reader still reads its version
    assert see(t.read().where("day is not null")) == [("a", 2), ("b", 1), ("c", 2)]
    assert see(t.stale(2)) == [("",), ("b",)]
    asked = []

    def build(parts):
        asked.extend(r["part"] for r in parts.collect())
        return rows(("b", 5), (None, 6))

    assert t.rebuild(2, build) == 3 and sorted(asked) == ["", "b"] and t.rebuild(2, build) is None
    assert see(t.read().where("day is not null")) == [("a", 2), ("b", 5), ("c", 2)] and t.read().where("day is null").collect()[0]["v"] == 6
    assert t.restore(1) == 4 and see(t.read().where("day is not null")) == [("a", 1), ("b", 1)] and len(see(t.read(3).where("day is not null"))) == 3
    assert t.prune(2) == [1, 2] and t.versions() == [3, 4] and see(t.read().where("day is not null")) == [("a", 1), ("b", 1)]
    assert t.write(rows(("z", 0)), 3, keep_others=False) == 5 and see(t.read()) == [("z", 0)]
    assert t.prune(1) == [3, 4] and see(t.read()) == [("z", 0)]
    assert len([f for f in (tmp_path / "t/data").iterdir()]) == 2  # the live one, and the orphan that no manifest names


def plain_health(log, limit, days):
    out = {}
    for symbol, _, at, ok, outage in sorted(log, key=lambda r: (str(r[0]), r[2], r[1])):
        h = out.setdefault(symbol, [0, 0, 0, None, None])
        if h[4] and at < h[4]:
            h[1] += 1
            continue
        h[0] += 1
        if ok:
            h[2:] = [0, None, None]
        elif not outage:
            h[2], h[3] = h[2] + 1, at
            if h[2] >= limit:
                h[4] = at + dt.timedelta(days=days)
    return {k: tuple(v) for k, v in out.items()}


def test_quarantine_equals_a_loop(spark, sf):
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    log = [(f"S{i % 9}" if i % 9 else None, i, start + dt.timedelta(hours=rng.randrange(1500)), rng.random() < 0.25, rng.random() < 0.2) for i in range(900)]
    d = spark.createDataFrame(log, "symbol string, refresh_id long, at timestamp, ok boolean, outage boolean")
    for limit, days in ((3, 7), (1, 1)):
        found = fetch_health.health(d, limit, days)
        assert {r["symbol"]: tuple(r)[1:] for r in found.collect()} == plain_health(log, limit, days)
    now = F.lit("2024-02-20").cast("timestamp")
    states = {r["state"]: r["symbols"] for r in fetch_health.report(fetch_health.health(d), now).collect()}
    assert sum(states.values()) == 9 and states.get("quarantined", 0) == fetch_health.quarantined(fetch_health.health(d), now).count()
    assert fetch_health.health(d.limit(0)).count() == 0
    rows = [tuple(r) for r in upkeep.fetch_log(spark, sf).withColumn("at", F.col("at").cast("timestamp")).collect()]
    got = {r["symbol"]: (r["attempts"], r["skipped"], r["failures"], r["until"]) for r in upkeep.fetch_quarantine(spark, sf).collect()}
    want = plain_health(rows, 3, 7)
    assert got == {k: (*v[:3], v[4] and v[4].strftime("%Y-%m-%d %H:%M:%S.%f")) for k, v in want.items()} and any(v[1] for v in got.values())


def test_cache_serves_fresh_and_well_formed_answers(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    rows = spark.createDataFrame([("a", '{"label":"bullish","confidence":0.5}'), ("b", '{"label":"up","confidence":0.5}'), ("c", '{"label":"bearish","confidence":7}'), ("d", "not json"), ("e", '{"label":"neutral"}')], "key string, answer string")
    empty = spark.createDataFrame([], "key string, answer string, created_at timestamp, expires_at timestamp, hits long")
    cache = model_cache.put(empty, rows, now)
    assert [r["key"] for r in cache.collect()] == ["a"]
    asked = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    found = model_cache.get(asked, cache, now)
    assert sorted((r["key"], r["status"], r["served"] and r["served"]["label"]) for r in found.collect()) == [("a", "hit", "bullish"), ("a", "hit", "bullish"), ("b", "miss", None)]
    assert model_cache.counted(cache, found).collect()[0]["hits"] == 2
    later = F.lit("2024-01-03 00:00:01").cast("timestamp")
    assert {r["status"] for r in model_cache.get(asked, cache, later).collect()} == {"expired", "miss"} and model_cache.purge(cache, later).count() == 0 and model_cache.purge(cache, now).count() == 1
    k = lambda **p: spark.range(1).select(model_cache.key(F.lit("t"), F.lit("1"), F.lit("m"), {n: F.lit(v) for n, v in p.items()})).first()[0]
    assert k(a="1", b="2") == k(b="2", a="1") and len({k(a="1", b="2"), k(a="12", b=""), k(a="1|b=1:2", b=None), k(a=None, b=None)}) == 4
