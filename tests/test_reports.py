"""Warnings and report sections on books made for each rule."""

from datetime import date, timedelta

from tidemark.operators import evaluation as ev

SCHEMA = "trade_id string, book string, symbol string, entry_session date, entry_price double, exit_price double, shares double, gross double, net double, return_pct double"


def trades(spark, books):
    """books: name -> list of (day, symbol, net); a cost of 1 a trade."""
    rows = []
    for book, items in books.items():
        for i, (day, symbol, net) in enumerate(items):
            rows.append((f"{book}-{i}", book, symbol, date(2020, 1, 1) + timedelta(day), 10.0, 10.0 + net / 100, 100.0, net + 1.0, net, net / 10))
    return spark.createDataFrame(rows, SCHEMA)


def sectors(spark):
    return spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y"), ("D", None)], "symbol string, sector string")


def test_each_warning(spark):
    books = {
        "few": [(k, "ABCD"[k % 4], 5.0) for k in range(8)],
        "steady": [(k, "ABCD"[k % 4], 5.0 if k % 4 else 4.0) for k in range(120)] + [(k, "ABCD"[k % 4], -2.0) for k in range(20)],
        "lucky": [(k, "A", 900.0 if k < 3 else 1.0) for k in range(40)] + [(k, "B", -30.0) for k in range(30)],
        "huge_loss": [(k, "ABCD"[k % 4], 2.0) for k in range(50)] + [(k, "C", -400.0) for k in range(5)],
        "costs": [(k, "ABCD"[k % 4], 3.0 if k % 2 else -3.5) for k in range(100)],
    }
    got = {r["book"]: r["warnings"] for r in ev.judged(trades(spark, books), ["book"], 1e4, sectors(spark)).collect()}
    assert got["few"] == ["not_significant", "too_few_trades", "one_sector", "no_losses"]
    assert got["steady"] == ["one_sector"]
    assert got["lucky"] == ["few_trades_for_ratio", "three_trades", "one_symbol", "one_sector"] or got["lucky"][0] == "not_significant"
    assert {"three_trades", "one_symbol", "one_sector"} <= set(got["lucky"])
    assert {"wins_but_loses_money", "loss_over_twice_win"} <= set(got["huge_loss"])
    assert {"not_significant", "edge_lost_to_costs"} <= set(got["costs"])


def test_sections_by_evidence(spark):
    books = {
        "short": [(k, "A", 5.0) for k in range(60)],
        "silent": [(0, "A", 5.0), (700, "A", 5.0)],
        "long": [(k * 9, "ABCD"[k % 4], 5.0 + k % 3) for k in range(120)],
    }
    got = {r["book"]: r for r in ev.report_sections(trades(spark, books), ["book"], 1e4, sectors(spark)).collect()}
    assert (got["short"]["evidence"], got["short"]["folds"], got["short"]["trades"], got["short"]["reason"]) == ("in_sample", 0, 60, "insufficient_history")
    assert (got["silent"]["folds"], got["silent"]["trades"], got["silent"]["reason"], got["silent"]["warnings"]) == (1, 0, "zero_completed_trades", [])
    long = got["long"]
    folds = (119 * 9 - 630) // 126 + 1
    inside = [k for k in range(120) if 504 <= k * 9 < 504 + 126 * folds]
    assert (long["folds"], long["trades"], long["reason"], long["headline"]) == (folds, len(inside), None, "significant")
    chained = 1.0
    for f in range(folds):
        chained *= 1 + sum(5.0 + k % 3 for k in inside if (k * 9 - 504) // 126 == f) / 1e4
    assert abs(long["chained_return_pct"] - (chained - 1) * 100) < 1e-9


def test_no_trades(spark):
    assert ev.report_sections(trades(spark, {}), ["book"], 1e4, sectors(spark)).count() == 0
    losing = trades(spark, {"bad": [(k, "A", -1.0) for k in range(3)]})
    r = ev.judged(losing, ["book"], 1e4, sectors(spark)).first()
    assert (r["top3_pct"], r["top_sector_pct"]) == (0.0, 0.0)
