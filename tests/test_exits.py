"""Each rule of an exit, and invariants over the query."""

import datetime as dt

import pytest

from tidemark.operators import indicators as ind
from tidemark.operators.exits import Rules, exits, walk
from tidemark.plans import positions
from tidemark.sources import adapters

DAY = dt.date(2024, 1, 1)
NAN = float("nan")


def bar(k, o, h, low, c, v=1000.0, atr=NAN, average=NAN):
    return {"symbol": "A", "session": DAY + dt.timedelta(k), "open": o, "high": h, "low": low, "close": c, "volume": v, "atr": atr, "average": average}


def position(**more):
    return {"position_id": "p", "symbol": "A", "direction": "long", "entry_session": DAY, "entry_price": 100.0, "shares": 10, "stop": 90.0, "target1": 110.0, "target2": 120.0, "hold": 5, "report": None} | more


def seen(p, bars, **rules):
    return [(r[2].day - 1, r[3], round(r[4], 6), r[5], r[6]) for r in walk(p, bars, Rules(**({"trail": None} | rules)))]


@pytest.mark.parametrize(
    ("bars", "more", "rules", "want"),
    [
        ([bar(1, 100, 101, 89, 95)], {}, {}, [(1, "stop_loss", 90.0, 10, 0)]),
        ([bar(1, 85, 130, 80, 95)], {}, {}, [(1, "gap_through_stop", 85.0, 10, 0)]),
        ([bar(1, 100, 115, 95, 112), bar(2, 112, 113, 89, 90)], {}, {}, [(1, "partial_target", 110.0, 5, 5), (2, "stop_loss", 90.0, 5, 0)]),
        ([bar(1, 100, 115, 95, 112), bar(2, 121, 125, 119, 120)], {}, {}, [(1, "partial_target", 110.0, 5, 5), (2, "target", 121.0, 5, 0)]),
        ([bar(1, 100, 112, 88, 95)], {}, {}, [(1, "stop_loss", 90.0, 10, 0)]),
        ([bar(1, 100, 112, 88, 95)], {}, {"optimistic": True}, [(1, "partial_target", 110.0, 5, 5)]),
        ([bar(1, 100, 112, 88, 95, v=0.0)], {}, {}, []),
        ([bar(k, 100, 101, 99, 100) for k in range(1, 7)], {"hold": 3}, {}, [(3, "time_stop", 100.0, 10, 0)]),
        ([bar(1, 100, 101, 99, 98, average=99)], {}, {"average": True}, [(1, "moving_average_exit", 98.0, 10, 0)]),
        ([bar(1, 100, 101, 99, 100), bar(2, 100, 101, 99, 100)], {"report": DAY + dt.timedelta(4)}, {"report_days": 2}, [(2, "pre_earnings_exit", 100.0, 10, 0)]),
        ([bar(1, 100, 109, 99, 108, atr=2.0), bar(2, 107, 108, 103, 104)], {}, {"trail": 2.0}, [(2, "trailing_stop", 104.0, 10, 0)]),
        ([bar(1, 100, 109, 99, 108, atr=2.0), bar(2, 108, 109, 105, 106, atr=9.0), bar(3, 106, 106, 103, 104)], {}, {"trail": 2.0}, [(3, "trailing_stop", 104.0, 10, 0)]),
        ([bar(1, 100, 101, 89, 95, v=8.0), bar(2, 95, 96, 94, 95), bar(3, 89, 91, 88, 90)], {}, {"participation": 0.5}, [(1, "stop_loss", 90.0, 4, 6), (3, "gap_through_stop", 89.0, 6, 0)]),
        ([bar(1, 100, 111, 99, 110)], {"direction": "short", "stop": 110.0, "target1": 90.0}, {}, [(1, "stop_loss", 110.0, 10, 0)]),
        ([bar(1, 88, 91, 87, 90)], {"direction": "short", "stop": 110.0, "target1": 90.0, "target2": NAN}, {"fractions": (1.0,)}, [(1, "target", 88.0, 10, 0)]),
        ([bar(1, 100, 101, 99, 100)], {"stop": NAN, "target1": NAN, "target2": NAN}, {"close_at_end": True}, [(1, "end", 100.0, 10, 0)]),
        ([bar(1, 85, 86, 80, 82, v=100.0)], {}, {"spread": 0.01, "impact": 0.1}, [(1, "gap_through_stop", 85 - 85 * (0.01 + 0.1 * 0.1 * 2), 10, 0)]),
    ],
)
def test_rules(bars, more, rules, want):
    assert seen(position(**more), bars, **rules) == [(d, r, round(p, 6), n, left) for d, r, p, n, left in want]


def test_positions_meet_the_bars_after_their_entry(spark):
    held = [position(position_id=f"p{k}", entry_session=DAY + dt.timedelta(k)) for k in (0, 1, 5)] + [position(position_id="none", symbol="B")]
    schema = "position_id string, symbol string, direction string, entry_session date, entry_price double, shares long, stop double, target1 double, target2 double, hold int, report date"
    series = [bar(1, 100.0, 101.0, 89.0, 95.0), bar(2, 100.0, 101.0, 88.0, 95.0)]
    b = spark.createDataFrame([tuple(x.values()) for x in series], "symbol string, session date, open double, high double, low double, close double, volume double, atr double, average double")
    got = exits(spark.createDataFrame([tuple(p.values()) for p in held], schema), b).collect()
    assert sorted((r["position_id"], r["session"].day, r["reason"]) for r in got) == [("p0", 2, "stop_loss"), ("p1", 3, "stop_loss")]
    assert exits(spark.createDataFrame([], schema), b).count() == 0


def test_query_closes_what_it_opened(spark, sf):
    rows = positions.position_exits(spark, sf).collect()
    held, by, twice = {}, {}, set()
    for p in positions.positions(spark, sf).collect():
        twice |= {p["position_id"]} & set(held)
        held[p["position_id"]] = p
    for r in rows:
        if r["position_id"] not in twice:
            by.setdefault(r["position_id"], []).append(r)
    assert len(by) > 1000
    for i, out in by.items():
        out.sort(key=lambda r: -r["remaining"])
        assert sum(r["shares"] for r in out) + out[-1]["remaining"] == held[i]["shares"] and all(r["session"] > str(held[i]["entry_session"]) for r in out)
    assert {r["reason"] for r in rows} >= {"stop_loss", "gap_through_stop", "partial_target", "target", "time_stop", "trailing_stop", "moving_average_exit"}


def test_positions_and_bars_come_from_one_exchange(spark, sf):
    held, series = positions.held_and_series(spark, sf)
    assert sorted(map(str, held.collect())) == sorted(map(str, positions.positions(spark, sf).collect()))
    assert {(r["symbol"], r["session"]): r["close"] for r in series.collect()} == {(r["symbol"], r["session"]): r["close"] for r in adapters.bars(spark, sf).collect()}
    x = positions.position_exits(spark, sf)
    sent = [line for line in x._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert sum("REPARTITION_BY_COL" in line for line in sent) == 2 and not [line for line in sent if "session" in line]  # AQE runs the two once


def test_a_missing_true_range_is_made(spark):
    b = [bar(k, 100.0 + k % 5, 104.0 + k % 3, 97.0 - k % 4, 101.0 + k % 7) for k in range(1, 30)]
    names = ["symbol", "session", "open", "high", "low", "close", "volume", "average"]
    series = spark.createDataFrame([tuple(x[n] for n in names) for x in b], "symbol string, session date, open double, high double, low double, close double, volume double, average double")
    schema = "position_id string, symbol string, direction string, entry_session date, entry_price double, shares long, stop double, target1 double, target2 double, hold int, report date"
    held = spark.createDataFrame([tuple(position(entry_session=DAY + dt.timedelta(15), stop=50.0, target1=200.0, target2=300.0).values())], schema)
    ranged = series.join(ind.smoothed(series, ("atr14",)).withColumnRenamed("atr14", "atr"), ["symbol", "session"])
    rules = Rules(trail=0.5)
    assert exits(held, series, rules).collect() == exits(held, ranged, rules).collect() != []
