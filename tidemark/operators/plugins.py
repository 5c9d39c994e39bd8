"""Strategies as plug-ins in Python: a class that sees one symbol's feature rows in order, run as a table function.

    class Mine(Plugin):
        name, direction = "mine", "long"
        def step(self, row): return Verdict(score=50.0, stop=row["low"], target=row["close"] * 1.1)

    run(feature_rows, Mine)

Spark partitions the rows by symbol and sorts them; a new object serves each symbol, so what it keeps on itself is that symbol's own
past. Rule tables (`strategies.register`) stay the faster way; this is for rules that need state or Python. A plug-in that
raises fails the job with its name. In SQL, after `register(spark, Mine)`:

    select * from mine(table(feature_rows) partition by symbol order by session)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

SCHEMA = "strategy string, direction string, symbol string, session date, close double, decline string, score double, stop double, target double"


@dataclass
class Verdict:
    decline: str | None = None
    score: float | None = None
    stop: float | None = None
    target: float | None = None


class Plugin:
    name = ""
    direction = "long"

    def step(self, row: Row) -> Verdict | None:
        """The verdict on a bar; None for no row."""
        raise NotImplementedError


def table_function(plugin: type[Plugin]):
    """The plug-in as a table function of rows that are partitioned by symbol and ordered by session."""
    if not plugin.name or plugin.direction not in ("long", "short"):
        raise ValueError("a plug-in needs a name and a direction")

    class Run:
        def __init__(self):
            self.plugin = plugin()

        def eval(self, row: Row):
            try:
                v = self.plugin.step(row)
            except Exception as e:
                raise RuntimeError(f"the plug-in {plugin.name} failed at {row['symbol']} on {row['session']}: {e}") from e
            if v is not None:
                yield plugin.name, plugin.direction, row["symbol"], row["session"], row["close"], v.decline, v.score, v.stop, v.target

    return udtf(Run, returnType=SCHEMA)


def run(rows: DataFrame, plugin: type[Plugin]) -> DataFrame:
    """Verdicts of rows(symbol, session, close, ...)."""
    return table_function(plugin)(rows.asTable().partitionBy("symbol").orderBy("session"))


def register(spark: SparkSession, plugin: type[Plugin]) -> None:
    spark.udtf.register(plugin.name, table_function(plugin))
