"""A strategy that runs as a plug-in: the volume breakout once more, with its own memory of the level before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import plugins
from tidemark.operators.strategies import REGISTRY, THRESHOLD
from tidemark.plans.strategies import _EVAL, feature_rows
from tidemark.registry import query


def _share(x: float | None, low: float, high: float) -> float:
    return 0.0 if x is None else min(1.0, max(0.0, (x - low) / (high - low)))


class VolumeBreakout(plugins.Plugin):
    """Breaks of the prior high on volume which the day's posts don't confirm."""

    name, direction = "volume_breakout_plugin", "long"

    def step(self, row) -> plugins.Verdict:
        level, ma50, volume, mood = row["level"], row["ma50"], row["rel_volume"], row["mood"]
        confirmed = (row["mentions"] or 0) >= 2 and mood is not None and mood > 0.15
        if level is None or ma50 is None:
            return plugins.Verdict("warming_up")
        if not row["close"] > level:
            return plugins.Verdict("no_breakout")
        if volume is None or volume < 1.2:
            return plugins.Verdict("thin_volume")
        if confirmed:
            return plugins.Verdict("sentiment_confirmed_elsewhere")
        score = REGISTRY["volume_breakout"].baseline + 25 * _share(volume, 1.2, 3.0) + 20 * _share((row["close"] / level - 1) * 100, 0.0, 5.0)
        score += 15 * _share(row["roc20"], 0.0, 15.0) + 10 * _share((row["close"] / ma50 - 1) * 100, 0.0, 20.0) - (12 if mood is not None and mood < -0.15 else 0)
        return plugins.Verdict(None, min(100.0, max(0.0, score)), level * 0.97, row["close"] + 2 * (row["close"] - level * 0.97))


@query("plugin_strategy", f"{_EVAL} select symbol, cast(session as varchar) as session, round_even(score + 3e-8, 4) as score, round_even(stop + 3e-8, 4) as stop, round_even(target + 3e-8, 4) as target from ev where strategy = 'volume_breakout' and decline is null and score >= {THRESHOLD}")
def plugin_strategy(spark: SparkSession, sf: str) -> DataFrame:
    found = plugins.run(feature_rows(spark, sf), VolumeBreakout).where(F.col("decline").isNull() & (F.col("score") >= THRESHOLD))
    return found.select("symbol", F.col("session").cast("string").alias("session"), *(F.bround(F.col(c) + 3e-8, 4).alias(c) for c in ("score", "stop", "target")))
