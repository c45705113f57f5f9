"""How one patch lies against another: correlation, and the shift by phase correlation to a part of a pixel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHIFT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("dy", "dx", "peak")])


def _between(before: float, top: float, after: float) -> float:
    """Place of a parabola's peak through three neighbours, from the middle one."""
    bend = before - 2 * top + after
    return 0.5 * (before - after) / bend if bend else 0.0


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dy, dx, peak) by which a lies beyond b: the highest place of the cross-spectrum's phases, which lie within half a patch."""
    flat = [(m - m.mean()) / (m.std() + 1e-9) for m in (a, b)]
    cross = np.fft.fft2(flat[0]) * np.conj(np.fft.fft2(flat[1]))
    found = np.fft.ifft2(cross / (np.abs(cross) + 1e-9)).real
    at = np.unravel_index(int(np.round(found, 12).argmax()), found.shape)
    out = []
    for axis, n in enumerate(found.shape):
        line = np.take(found, at[1 - axis], axis=1 - axis)
        i = at[axis]
        place = i + _between(line[i - 1], line[i], line[(i + 1) % n])
        out.append(place - n if place > n / 2 else place)
    return float(out[0]), float(out[1]), float(found[at])


@F.pandas_udf(SHIFT)
def shift_of(a: pd.Series, b: pd.Series, width: pd.Series) -> pd.DataFrame:
    """phase_shift of two patches of one size, given row by row with their width."""
    return pd.DataFrame([phase_shift(np.asarray(x, float).reshape(-1, w), np.asarray(y, float).reshape(-1, w)) for x, y, w in zip(a, b, width, strict=True)], columns=["dy", "dx", "peak"])


def correlations(pairs: DataFrame, by: str, a: Column, b: Column) -> DataFrame:
    """(by, corr, n): Pearson's correlation of two values of each group's pixels, on their logarithms of 1 + value, since tones of sensor and picture differ."""
    return pairs.groupBy(by).agg(F.corr(F.log1p(a), F.log1p(b)).alias("corr"), F.count("*").alias("n"))
