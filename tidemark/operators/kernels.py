"""Sequential kernels that run in Python workers; nothing here touches a Spark session."""

from __future__ import annotations

import numpy as np
import pandas as pd


def _ema(x: pd.Series, alpha: float, least: int) -> pd.Series:
    return x.ewm(alpha=alpha, adjust=False, min_periods=least).mean()


NAMES = ("ema12", "ema26", "macd", "macd_signal", "macd_hist", "rsi14", "atr14", "adx14", "keltner_up", "keltner_down")


def smoothed_frame(f: pd.DataFrame, columns: tuple[str, ...] = NAMES) -> pd.DataFrame:
    """Recursive averages of one symbol's bars in session order: those asked for."""
    c, h, low = f["close"], f["high"], f["low"]
    known: dict[str, pd.Series] = {}

    def of(name: str) -> pd.Series:
        if name not in known:
            known[name] = make(name)
        return known[name]

    def make(name: str) -> pd.Series:
        if name in ("ema12", "ema26"):
            n = int(name[3:])
            return _ema(c, 2 / (n + 1), n)
        if name == "macd":
            return of("ema12") - of("ema26")
        if name == "macd_signal":
            return _ema(of("macd").dropna(), 2 / 10, 9).reindex(f.index)
        if name == "macd_hist":
            return of("macd") - of("macd_signal")
        if name == "rsi14":
            d = c.diff()
            gain, loss = _ema(d.clip(lower=0), 1 / 14, 14), _ema((-d).clip(lower=0), 1 / 14, 14)
            rsi = 100 - 100 / (1 + gain / loss.where(loss != 0))
            return rsi.where(loss != 0, 100.0).where(~((gain == 0) & (loss == 0)), 50.0).where(gain.notna())
        if name == "atr14":
            before = c.shift(1)
            tr = np.fmax(np.fmax((h - low).to_numpy(), (h - before).abs().to_numpy()), (low - before).abs().to_numpy())
            return _ema(pd.Series(tr, f.index).where(before.notna()), 1 / 14, 14)
        if name == "adx14":
            up, down, atr = h.diff(), -low.diff(), of("atr14")
            plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
            p, m = 100 * _ema(plus, 1 / 14, 14) / atr.where(atr != 0), 100 * _ema(minus, 1 / 14, 14) / atr.where(atr != 0)
            return _ema(100 * (p - m).abs() / (p + m).where(p + m != 0), 1 / 14, 14)
        if name in ("keltner_up", "keltner_down"):
            return _ema(c, 2 / 21, 20) + (2 if name == "keltner_up" else -2) * of("atr14")
        raise ValueError(f"no recursive average named {name}")

    return pd.DataFrame({"symbol": f["symbol"], "session": f["session"], **{name: of(name) for name in columns}})


def cluster(points: list[tuple[float, int]], tolerance: float) -> list[tuple[float, int, int]]:
    """Prices with their rows, in ascending order, merged while within tolerance of the running mean: (mean, members, last row)."""
    out: list[tuple[float, int, int]] = []
    total = 0.0
    for p, at in sorted(points):
        if out and out[-1][0] != 0 and abs(p - out[-1][0]) / abs(out[-1][0]) <= tolerance:
            total += p
            n = out[-1][1] + 1
            out[-1] = (total / n, n, max(out[-1][2], at))
        else:
            total = p
            out.append((p, 1, at))
    return out
