"""Features of a bounded lookback that are no plain window aggregate: exponential averages, Fourier features.

Bars are cut into chunks with the lookback's bars in front (``frames.in_chunks``), so a long symbol is many tasks and
no group is larger than a chunk and its halo. Inside a chunk numpy steps through the lookback once for all bars.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from ..frames import in_chunks


class Folds:
    """Recursions over the last ``lookback`` values of every bar at once."""

    def __init__(self, size: int, lookback: int) -> None:
        self.size, self.lookback = size, min(lookback, size)

    def steps(self):
        """(bars that have the step, rows that they read), oldest first; a bar near the start has fewer steps."""
        for back in range(self.lookback - 1, -1, -1):
            yield np.arange(back, self.size), np.arange(0, self.size - back)

    def adjusted(self, x: np.ndarray, alpha: float) -> np.ndarray:
        """Exponential mean with adjustment; gaps let the weights fade."""
        top, bottom = np.zeros(self.size), np.zeros(self.size)
        for bars, rows in self.steps():
            valid = ~np.isnan(x[rows])
            top[bars], bottom[bars] = top[bars] * (1 - alpha) + np.where(valid, x[rows], 0.0), bottom[bars] * (1 - alpha) + valid
        with np.errstate(all="ignore"):
            return top / bottom

    def difference(self, x: np.ndarray, fast: float, slow: float, signal: float) -> tuple[np.ndarray, np.ndarray]:
        """Fast less slow adjusted mean, and the adjusted mean of that difference along the lookback."""
        state = np.zeros((6, self.size))
        line = np.full(self.size, np.nan)
        for bars, rows in self.steps():
            for k, alpha in ((0, fast), (2, slow)):
                state[k, bars] = state[k, bars] * (1 - alpha) + x[rows]
                state[k + 1, bars] = state[k + 1, bars] * (1 - alpha) + 1
            line[bars] = state[0, bars] / state[1, bars] - state[2, bars] / state[3, bars]
            state[4, bars], state[5, bars] = state[4, bars] * (1 - signal) + line[bars], state[5, bars] * (1 - signal) + 1
        return line, state[4] / state[5]

    def smoothed(self, streams: list[np.ndarray], alpha: float) -> np.ndarray:
        """Means without adjustment of several series, of which the first value starts the mean; the last bar's."""
        state = np.full((len(streams), self.size), np.nan)
        for bars, rows in self.steps():
            for k, x in enumerate(streams):
                now = state[k, bars]
                state[k, bars] = np.where(np.isnan(now), x[rows], np.where(np.isnan(x[rows]), now, now + alpha * (x[rows] - now)))
        return state

    def opened(self, x: np.ndarray, alpha: float, first: float) -> np.ndarray:
        """As ``smoothed`` for one series whose value at the lookback's first bar is ``first``."""
        state = np.full(self.size, np.nan)
        for bars, rows in self.steps():
            now = state[bars]
            state[bars] = np.where(np.isnan(now), first, now + alpha * (x[rows] - now))
        return state


def _lagged(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.nan], x[:-1]])


def rsi(d: pd.DataFrame, lookback: int, n: int = 14) -> dict[str, np.ndarray]:
    """Wilder's index over the lookback, whose first bar has no move; no loss gives 100."""
    move = d.close.to_numpy(float) - _lagged(d.close.to_numpy(float))
    folds = Folds(len(d), lookback)
    gain, loss = (folds.opened(np.maximum(sign * move, 0), 1 / n, 0.0) for sign in (1, -1))
    with np.errstate(all="ignore"):
        found = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
    return {f"rsi_{n}": np.where(np.minimum(np.arange(len(d)) + 1, lookback) > n, found, np.nan)}


def adx(d: pd.DataFrame, lookback: int, n: int = 14) -> dict[str, np.ndarray]:
    """Wilder's directional indices over the lookback."""
    high, low, close = (d[c].to_numpy(float) for c in ("high", "low", "close"))
    up, down, before = high - _lagged(high), _lagged(low) - low, _lagged(close)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    true = np.nanmax([high - low, np.abs(high - before), np.abs(low - before)], axis=0)
    size, alpha = len(d), 1 / n
    state, count, strength, seen = np.full((3, size), np.nan), np.zeros(size), np.full(size, np.nan), np.zeros(size)
    with np.errstate(all="ignore"):
        for bars, rows in Folds(size, lookback).steps():
            fresh = count[bars] == 0
            for k, x in enumerate((np.where(fresh, (high - low)[rows], true[rows]), np.where(fresh, 0.0, plus[rows]), np.where(fresh, 0.0, minus[rows]))):
                state[k, bars] = np.where(fresh, x, state[k, bars] + alpha * (x - state[k, bars]))
            count[bars] += 1
            p, m = 100 * state[1, bars] / state[0, bars], 100 * state[2, bars] / state[0, bars]
            dx = np.where((count[bars] >= n) & (p + m > 0), 100 * np.abs(p - m) / (p + m), np.nan)
            valid, now = ~np.isnan(dx), strength[bars]
            strength[bars] = np.where(valid, np.where(np.isnan(now), dx, now + alpha * (dx - now)), now)
            seen[bars] += valid
        enough = count > n
        return {
            f"adx_{n}": np.where(enough & (seen >= n), strength, np.nan),
            f"di_plus_{n}": np.where(enough, 100 * state[1] / state[0], np.nan),
            f"di_minus_{n}": np.where(enough, 100 * state[2] / state[0], np.nan),
        }


def averages(d: pd.DataFrame, lookback: int, ema: int = 12, fast: int = 12, slow: int = 26, signal: int = 9, atr: int = 14) -> dict[str, np.ndarray]:
    """The adjusted average of the close, MACD, and both over the close and the plain average true range."""
    high, low, close = (d[c].to_numpy(float) for c in ("high", "low", "close"))
    folds, alpha = Folds(len(d), lookback), lambda n: 2 / (n + 1)
    average = folds.adjusted(close, alpha(ema))
    line, follow = folds.difference(close, alpha(fast), alpha(slow), alpha(signal))
    before = _lagged(close)
    true = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    spread = pd.Series(true).rolling(atr).mean().to_numpy()
    seen = np.minimum(np.arange(len(d)) + 1, lookback)
    average = np.where(seen >= ema, average, np.nan)
    line, follow = np.where(seen >= slow, line, np.nan), np.where(seen >= slow, follow, np.nan)
    with np.errstate(all="ignore"):
        return {
            f"ema_{ema}": average, f"over_ema_{ema}": close / average, f"log_over_ema_{ema}": np.log(close / average), f"dist_ema_{ema}_atr_{atr}": (close - average) / spread,
            "macd_line": line, "macd_signal": follow, "macd_hist": line - follow, "macd_line_over_close": line / close, "macd_hist_over_close": (line - follow) / close,
            "macd_line_over_atr": line / spread, "macd_hist_over_atr": (line - follow) / spread,
        }


def chaikin(d: pd.DataFrame, lookback: int, fast: int = 3, slow: int = 10) -> dict[str, np.ndarray]:
    """Difference of two adjusted averages of the accumulation line that starts with the lookback."""
    high, low, close, volume = (d[c].to_numpy(float) for c in ("high", "low", "close", "volume"))
    with np.errstate(all="ignore"):
        flow = np.where(high > low, ((close - low) - (high - close)) / (high - low), 0.0) * volume
    size = len(d)
    line, state = np.zeros(size), np.zeros((4, size))
    for bars, rows in Folds(size, lookback).steps():
        line[bars] += flow[rows]
        for k, n in ((0, fast), (2, slow)):
            keep = 1 - 2 / (n + 1)
            state[k, bars], state[k + 1, bars] = state[k, bars] * keep + line[bars], state[k + 1, bars] * keep + 1
    found = state[0] / state[1] - state[2] / state[3]
    return {f"chaikin_{fast}_{slow}": np.where(np.minimum(np.arange(size) + 1, lookback) >= slow, found, np.nan)}


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, n) if len(x) >= n else np.zeros((0, n))


def _placed(found: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([np.full(size - len(found), np.nan), found])


def dominant_cycle(d: pd.DataFrame, lookback: int, n: int = 50) -> dict[str, np.ndarray]:
    """Length of the strongest wave of the window and its share of all amplitudes; the lookback must hold the window."""
    w = _windows(d.close.to_numpy(float), n if lookback >= n else len(d) + 1)
    if not len(w):
        return {f"cycle_length_{n}": np.full(len(d), np.nan), f"cycle_strength_{n}": np.full(len(d), np.nan)}
    size = np.abs(np.fft.fft(w - w.mean(axis=1, keepdims=True), axis=1))[:, 1 : n // 2]
    best = size.argmax(axis=1)
    with np.errstate(all="ignore"):
        share = size[np.arange(len(size)), best] / size.sum(axis=1)
    return {f"cycle_length_{n}": _placed(n / (best + 1.0), len(d)), f"cycle_strength_{n}": _placed(share, len(d))}


def spectral_entropy(d: pd.DataFrame, lookback: int, n: int = 50) -> dict[str, np.ndarray]:
    """Entropy of the window's power spectrum, between 0 and 1; the lookback must hold the window."""
    w = _windows(d.close.to_numpy(float), n if lookback >= n else len(d) + 1)
    if not len(w):
        return {f"spectral_entropy_{n}": np.full(len(d), np.nan)}
    power = np.abs(np.fft.rfft(w - w.mean(axis=1, keepdims=True), axis=1)) ** 2
    with np.errstate(all="ignore"):
        share = power / power.sum(axis=1, keepdims=True)
    return {f"spectral_entropy_{n}": _placed(-(share * np.log(share + 1e-12)).sum(axis=1) / np.log(power.shape[1]), len(d))}


#: Features by name with their columns for the default parameters.
FEATURES = {rsi: ["rsi_14"], adx: ["adx_14", "di_plus_14", "di_minus_14"], chaikin: ["chaikin_3_10"], dominant_cycle: ["cycle_length_50", "cycle_strength_50"], spectral_entropy: ["spectral_entropy_50"]}
FEATURES[averages] = [
    "ema_12", "over_ema_12", "log_over_ema_12", "dist_ema_12_atr_14", "macd_line", "macd_signal", "macd_hist", "macd_line_over_close", "macd_hist_over_close", "macd_line_over_atr", "macd_hist_over_atr",
]


def with_lookback_features(bars: DataFrame, features=tuple(FEATURES), lookback: int = 720, every: int = 5000) -> DataFrame:
    """``bars`` with the columns of the features; NULL while a bar has too few bars before it."""
    names = [n for f in features for n in FEATURES[f]]
    schema = StructType([f for f in bars.schema.fields if f.name not in names] + [StructField(n, DoubleType()) for n in names])
    kept = [f.name for f in schema.fields if f.name not in names]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts").reset_index(drop=True)
        found: dict[str, np.ndarray] = {}
        for feature in features:
            found |= feature(rows, lookback)
        out = rows.assign(**found)[~rows._halo]
        return out[[*kept, *names]].replace([np.inf, -np.inf], np.nan)

    return in_chunks(bars, lookback, every).groupBy("symbol", "_chunk").applyInPandas(run, schema)
