"""Ranks within a moving window of a key's own past: order statistics that are kept, not counted anew.

Each window is a sorted list from which the leaving value is taken and into which the new one is put, so a row costs the same
whatever the window's length. All ranks of a key come from one pass over its rows in order.

Defined results: null and NaN values have no rank and don't count in a window's values, though they take a row of it; ties in order go
by the remaining ranked columns; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rank:
    """The share of a column's last `rows` values that are at most the current one, once `least` values are there (all of them by
    default); with `even`, 0.5 where all are equal."""

    column: str
    rows: int
    least: int | None = None
    even: bool = False

    def over(self, values: np.ndarray) -> np.ndarray:
        window: deque = deque()
        kept: list[float] = []
        out = np.full(len(values), np.nan)
        least = self.rows if self.least is None else self.least
        for i, v in enumerate(values.tolist()):
            if len(window) == self.rows:
                old = window.popleft()
                if old == old:
                    kept.pop(bisect_left(kept, old))
            window.append(v)
            if v != v:
                continue
            insort(kept, v)
            if len(kept) >= least:
                out[i] = 0.5 if self.even and kept[0] == kept[-1] else bisect_right(kept, v) / len(kept)
        return out


def ranked(rows: DataFrame, keys: list[str], order: str, ranks: dict[str, Rank]) -> DataFrame:
    """keys, order, the ranked columns and their ranks by name."""
    columns = list(dict.fromkeys(r.column for r in ranks.values()))
    kinds = dict(rows.dtypes)

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([order, *columns], ignore_index=True)
        for name, r in ranks.items():
            f[name] = r.over(f[r.column].to_numpy(float))
        return f

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*keys, order)), *(f"{c} double" for c in (*columns, *ranks))])
    found = rows.select(*keys, order, *(rows[c].cast("double").alias(c) for c in columns)).groupBy(*keys).applyInPandas(kernel, schema)
    return found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in (*columns, *ranks)})
