"""Causal wavelet denoising: each value is the last one of its own window's reconstruction.

Windows end at their row, so no value sees the future. The windows of a run of rows are
transformed together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from barloom.operators.chunks import CHUNK_SECONDS, Line, Values, carried

#: Daubechies 4 scaling filter (fixed values).
DB4 = np.array([-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965])
LOW, HIGH = DB4, np.array([(-1) ** (k + 1) * DB4[len(DB4) - 1 - k] for k in range(len(DB4))])


def split(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Filter symmetric extensions of the rows and keep every second value."""
    n, pad = x.shape[1], len(taps) - 1
    ext = np.pad(x, ((0, 0), (pad, pad)), mode="symmetric")
    out = np.stack([ext[:, k : k + n + pad] for k in range(len(taps))], axis=2) @ taps[::-1]
    return out[:, 1::2]


def join(a: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Inverse of split for both bands, cut to n values."""
    up = np.zeros((a.shape[0], 2 * a.shape[1], 2))
    up[:, ::2, 0], up[:, ::2, 1] = a, d
    taps = len(DB4)
    full = np.zeros((a.shape[0], up.shape[1] + taps - 1))
    for k in range(taps):
        full[:, k : k + up.shape[1]] += up[:, :, 0] * LOW[::-1][k] + up[:, :, 1] * HIGH[::-1][k]
    return full[:, taps - 2 : taps - 2 + n]


def denoised_last(windows: np.ndarray, level: int = 2, scale: float = 0.5) -> np.ndarray:
    """Last value of every row after soft thresholding all detail bands at scale * sigma * sqrt(2 ln n)."""
    bands, sizes, a = [], [], windows
    for _ in range(level):
        sizes.append(a.shape[1])
        bands.append(split(a, HIGH))
        a = split(a, LOW)
    sigma = np.median(np.abs(bands[0]), axis=1) / 0.6745
    cut = (scale * sigma * np.sqrt(2 * np.log(windows.shape[1])))[:, None]
    for d, n in zip(reversed(bands), reversed(sizes), strict=True):
        a = join(a, np.sign(d) * np.maximum(np.abs(d) - cut, 0), n)
    return a[:, -1]


def with_denoised(df: DataFrame, column: str, window: int = 64, level: int = 2, scale: float = 0.5, key: str = "symbol", time: str = "ts", chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """df plus <column>_denoised, NULL until the window is full. A chunk of a key's history gets the window - 1 values
    before it, so no task holds the whole history."""
    name, back = f"{column}_denoised", window - 1

    def moved(state: Line | None, made: Line) -> Line:
        return [*(state or []), *made][-back:]

    def filled(x: Values, state: Line | None) -> Values:
        before = np.array(state or [], float)
        whole = np.r_[before, x[column]]
        out = np.full(len(whole), np.nan)
        if len(whole) >= window:
            w = np.lib.stride_tricks.sliding_window_view(whole, window)
            for i in range(0, len(w), 4096):
                out[back + i : back + i + 4096] = denoised_last(np.ascontiguousarray(w[i : i + 4096]), level, scale)
        return {name: out[len(before) :]}

    return carried(df, [column], [name], lambda x: x[column][-back:].tolist(), moved, filled, key, time, chunk_seconds)
