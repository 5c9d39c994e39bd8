"""The trading calendar: rule-based holidays, sessions with their UTC closes. Some 250 rows a year, made when asked for."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def easter(year: int) -> date:
    """Gregorian computus."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th such weekday of a month; the last for n = -1."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = (date(year, month + 1, 1) if month < 12 else date(year + 1, 1, 1)) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def _observed(d: date) -> date:
    return d - timedelta(1) if d.weekday() == 5 else d + timedelta(1) if d.weekday() == 6 else d


def holidays(year: int) -> set[date]:
    fixed = [date(year, 1, 1), date(year, 7, 4), date(year, 12, 25)] + ([date(year, 6, 19)] if year >= 2022 else [])
    moving = [_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), easter(year) - timedelta(2), _nth(year, 5, 0, -1), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4)]
    return {_observed(d) for d in fixed} | set(moving)


def _closed(start: str, end: str) -> list[date]:
    a, b = date.fromisoformat(start).year, date.fromisoformat(end).year
    return sorted(d for y in range(a, b + 2) for d in holidays(y))


def sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """session, ordinal from 1, close_utc (16:00 in New York, without zone) and open_after (the close before)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("session"))
    open_days = days.where(F.weekday("session") < 5).where(~F.col("session").isin(*_closed(start, end)))
    w = Window.partitionBy(F.lit(0)).orderBy("session")  # one small calendar
    close = F.to_utc_timestamp(F.concat(F.col("session").cast("string"), F.lit(" 16:00:00")).cast("timestamp"), "America/New_York").cast("timestamp_ntz")
    s = open_days.withColumn("ordinal", F.row_number().over(w)).withColumn("close_utc", close)
    return s.withColumn("open_after", F.coalesce(F.lag("close_utc").over(w), F.col("close_utc") - F.expr("interval 10 days")))


#: The same calendar in SQL, for the years between its two dates.
SESSIONS_SQL = (
    "days as (select cast(unnest(generate_series(date '1994-12-01', date '2001-12-31', interval 1 day)) as date) as session), "
    "sessions as (select session, row_number() over (order by session) as ordinal, timezone('UTC', timezone('America/New_York', cast(session as timestamp) + interval 16 hours)) as close_utc "
    "from days where isodow(session) < 6 and session not in ("
    + ", ".join(f"date '{d}'" for d in _closed("1994-12-01", "2001-12-31") + _closed("2023-12-01", "2024-12-31"))
    + "))"
)
