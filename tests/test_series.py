"""The daily series against a loop over sessions and posts."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import holidays
from tidemark.operators import series

START = datetime(2023, 1, 3, 12)
#: hours after START: both sides of a close and the very close, gaps within and beyond fading, over one block of days and over two.
HOURS = (0, 7.5, 8, 8.0001, 20, 31, 31, 55, 56, 80, 24 * 29, 24 * 29.5, 24 * 62, 24 * 62 + 3, 24 * 400, 24 * 401, 24 * 1000)


def rows():
    for i, h in enumerate(HOURS):
        author = None if i % 5 == 4 else i % 3
        age = None if i % 4 == 0 else 30.0 * i
        labels = {k: ((i * 7 + j) % 11) / 10.0 for j, k in enumerate(series.LABELS)}
        yield {"post_id": i, "symbol": "A" if i % 6 else "B", "created_at": START + timedelta(hours=h), "author": author, "kind": "news" if i % 7 == 0 else "social", "engagement": float(i % 4) * 5, "author_age_days": age, "author_karma": None, "author_followers": None, "polarity": (i * 37 % 21) / 10 - 1, "bullish": (i % 3) / 2, "bearish": (i % 4) / 3, **labels}
    base = {k: None for k in ("author", "kind", "engagement", "author_age_days", "author_karma", "author_followers", "polarity", "bullish", "bearish", *series.LABELS)}
    yield {**base, "post_id": 90, "symbol": None, "created_at": START}
    yield {**base, "post_id": 91, "symbol": "A", "created_at": None}
    yield {**base, "post_id": 92, "symbol": "C", "created_at": START + timedelta(days=999)}


SCHEMA = "post_id long, symbol string, created_at timestamp, author long, kind string, engagement double, author_age_days double, author_karma double, author_followers double, polarity double, bullish double, bearish double, " + ", ".join(f"{k} double" for k in series.LABELS)


def mean(pairs):
    total = sum(w for _, w in pairs)
    return sum(v * w for v, w in pairs) / total if total > 1e-12 else sum(v for v, _ in pairs) / len(pairs)


def credibility(p):
    if p["author_age_days"] is None:
        return 0.6 if p["kind"] == "news" else 0.0
    return min(1.0, p["author_age_days"] / 365) / 3


def trading(day):
    return day.weekday() < 5 and day not in holidays(day.year)


def expected():
    posts = [p for p in rows() if p["symbol"] and p["created_at"]]
    last = max(p["created_at"] for p in posts)
    out, day = {}, START.date()
    while datetime.combine(day, datetime.min.time()) + timedelta(hours=20) < last + timedelta(days=1):
        close = datetime.combine(day, datetime.min.time()) + timedelta(hours=20)
        for symbol in ("A", "B", "C") if trading(day) else ():
            mine = [p for p in posts if p["symbol"] == symbol]
            old = [(p, (close - p["created_at"]) / timedelta(hours=1)) for p in mine if p["created_at"] <= close]
            if not old:
                continue
            w = [(p, a, 0.5 ** (a / 18)) for p, a in old]
            voices = {}
            for p, _, d in w:
                voices.setdefault(f"post {p['post_id']}" if p["author"] is None else p["author"], []).append((p["polarity"] or 0.0, d))
            raw = mean([(p["polarity"] or 0.0, d) for p, _, d in w])
            total = sum(d for *_, d in w)
            parts = [[((p["polarity"] or 0.0), d) for p, a, d in w if a < 24 * n] for n in (2, 10)]
            fast, slow = (mean(x) if x else 0.0 for x in parts)
            recent, base = len(parts[0]), len(parts[1]) - len(parts[0])
            opened = lambda a, b: max(1, sum(trading(day - timedelta(k)) for k in range(b, a)))  # noqa: E731, B023
            growth = 0.0 if recent + base < 5 else max(-10, min(10, (recent / opened(2, 0) + 0.5) / (base / opened(10, 2) + 0.5) - 1))
            out[symbol, str(day)] = {
                "post_count": len(w), "later": len(mine) - len(w), "authors": len({p["author"] for p, *_ in w if p["author"] is not None}), "raw": raw, "mention_growth": growth, "acceleration": fast - slow,
                "engagement_weighted": mean([(p["polarity"] or 0.0, d * (1.0 if p["kind"] == "news" else math.log1p(p["engagement"] or 0.0))) for p, _, d in w]),
                "credibility_weighted": mean([(p["polarity"] or 0.0, d * credibility(p)) for p, _, d in w]),
                "unique_author": sum(mean(v) for v in voices.values()) / len(voices), "age_hours": mean([(a, d) for _, a, d in w]),
                "dispersion": 0.0 if len(w) < 2 or total <= 1e-12 else math.sqrt(sum(d * ((p["polarity"] or 0.0) - raw) ** 2 for p, _, d in w) / total),
                "author_concentration": sum(len(v) ** 2 for v in voices.values()) / len(w) ** 2, "total_engagement": sum(p["engagement"] or 0.0 for p, *_ in w),
                "hype": mean([(p["hype"] or 0.0, d) for p, _, d in w]), "catalyst_quality": mean([(max(p[c] or 0.0 for c in series.CATALYSTS), d) for p, _, d in w]),
            }
        day += timedelta(1)
    return out


def test_series_equals_loop(spark):
    posts = spark.createDataFrame([tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in rows()], SCHEMA).withColumn("d", F.lit("clash"))
    got = {(r["symbol"], str(r["session"])): r for r in series.daily_series(posts).collect()}
    want = expected()
    assert set(got) == set(want)
    for key, row in want.items():
        for name, value in row.items():
            assert got[key][name] == pytest.approx(value, abs=1e-7), (key, name)


def test_series_without_posts(spark):
    assert series.daily_series(spark.createDataFrame([], SCHEMA)).count() == 0


def test_series_counts_repeated_posts(spark):
    p = [tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in rows()][:8]
    one, two = (series.daily_series(spark.createDataFrame(p * k, SCHEMA)).orderBy("symbol", "session").collect() for k in (1, 2))
    assert [2 * r["post_count"] for r in one] == [r["post_count"] for r in two]
    assert [r["raw"] for r in one] == pytest.approx([r["raw"] for r in two])
