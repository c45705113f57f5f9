"""Where two frames of a plot hand over to each other, and the brightness step along that line.

A strip is one row: the composite so far and the new frame as arrays of one
band's or several bands' pixels, row by row, and what each of them covers.
A strip is one plot's crop, or a part of it: its pixels bound a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows back into the overlap, pull towards its edge, rows a column, cost of a forbidden place, least overlap in pixels.
SLACK, BIAS, STEP, FORBIDDEN, LEAST_OVERLAP = 300, 0.05, 4, 1e4, 5000
#: Rows of the measured bands, rows over which an offset fades, its largest size, parts of the width that it is smoothed over.
HALF_BAND, FADE, MOST_OFFSET, SMOOTH_PARTS = 24, 600, 60.0, 12


class Seam(NamedTuple):
    path: np.ndarray  # row of the seam in each column
    active: np.ndarray  # columns in which both frames meet
    below: bool  # whether the new frame lies below
    turned: bool  # whether rows and columns are exchanged
    take: np.ndarray  # pixels that the new frame supplies


def _ends(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last marked row of each column (0 and -1 where there is none)."""
    any_ = mask.any(axis=0)
    return np.where(any_, mask.argmax(axis=0), 0), np.where(any_, len(mask) - 1 - mask[::-1].argmax(axis=0), -1)


def _middles(mask: np.ndarray) -> np.ndarray:
    n = mask.sum(axis=0)
    return (np.arange(len(mask))[:, None] * mask).sum(axis=0) / np.maximum(n, 1)


def cheapest_path(cost: np.ndarray, step: int) -> np.ndarray:
    """Row in each column of the path from left to right with the least sum, moving at most step rows a column; the upper one on ties."""
    rows, cols = cost.shape
    total, back = cost[:, 0].astype(float), np.zeros((cols, rows), np.int16)
    for c in range(1, cols):
        reach = sliding_window_view(np.pad(total, step, constant_values=np.inf), 2 * step + 1)
        best = reach.argmin(axis=1)
        back[c] = best - step
        total = reach[np.arange(rows), best] + cost[:, c]
    path = np.empty(cols, np.int64)
    path[-1] = total.argmin()
    for c in range(cols - 1, 0, -1):
        path[c - 1] = path[c] + back[c, path[c]]
    return path


def seam_between(old: np.ndarray, new: np.ndarray, filled: np.ndarray, valid: np.ndarray, slack: int = SLACK, bias: float = BIAS, step: int = STEP, least: int = LEAST_OVERLAP) -> Seam | None:
    """The seam of a composite (grey values old, filled) and a new frame (new, valid); None where the frames don't meet along a band.

    The new frame gives what the composite lacks.  Along the border the seam
    may go back into the overlap by slack rows, where the frames differ least.
    """
    overlap, lacking = valid & filled, valid & ~filled
    if not lacking.any() or overlap.sum() < least:
        return None
    kinds = lacking.astype(np.int8) - overlap
    turned = bool(np.count_nonzero(np.diff(kinds, axis=1)) > np.count_nonzero(np.diff(kinds, axis=0)))
    if turned:
        old, new, overlap, lacking, valid = old.T, new.T, overlap.T, lacking.T, valid.T
    height, width = overlap.shape
    active = overlap.any(axis=0) & lacking.any(axis=0)
    if active.sum() < 0.2 * width:
        return None
    first, last = _ends(overlap)
    below = bool(np.sign(_middles(lacking) - _middles(overlap))[active].sum() >= 0)
    edge, slack = (last if below else first), max(8, int(slack))
    lo = max(0, int(edge[active].min()) - slack * below)
    hi = min(height - 1, int(edge[active].max()) + slack * (not below))
    if hi - lo < 2:
        return None
    rows = np.arange(lo, hi + 1)[:, None]
    from_edge = (edge - rows) if below else (rows - edge)
    allowed = overlap[lo : hi + 1] & (from_edge >= 0) & (from_edge <= slack)
    cost = np.where(allowed, np.abs(old[lo : hi + 1].astype(float) - new[lo : hi + 1]), FORBIDDEN) + bias * np.abs(from_edge)
    path = np.clip(cheapest_path(cost, max(1, int(step))) + lo, 0, height - 1)
    beyond = np.arange(height)[:, None] > path if below else np.arange(height)[:, None] < path
    take = (lacking | (overlap & beyond & active)) & valid
    return Seam(path, active, below, turned, take.T if turned else take)


def feathered(old: np.ndarray, new: np.ndarray, seam: Seam, fade: int = FADE, half: int = HALF_BAND) -> np.ndarray:
    """new (bands by rows by columns) with the step to old along the seam taken out: an offset of each column, smoothed along the seam, that fades over fade rows."""
    if seam.turned:
        old, new = old.transpose(0, 2, 1), new.transpose(0, 2, 1)
    height, width = old.shape[1:]
    away = (np.arange(height)[:, None] - seam.path) * (1 if seam.below else -1)
    before, after = (away < 0) & (away >= -half), (away >= 0) & (away <= half)
    good = (before.sum(axis=0) > 4) & (after.sum(axis=0) > 4) & seam.active
    fading = np.clip(1 - np.maximum(away, 0) / fade, 0, 1)
    box = np.ones(max(3, int(width / SMOOTH_PARTS) | 1))
    near = np.convolve(good.astype(float), box, "same")
    if len(near) > width:  # a strip narrower than the box
        near = near[(len(near) - width) // 2 :][:width]
    out = new.astype(float)
    for k in range(len(out)):
        gap = (old[k] * before).sum(axis=0) / np.maximum(before.sum(axis=0), 1) - (new[k] * after).sum(axis=0) / np.maximum(after.sum(axis=0), 1)
        spread = np.convolve(np.where(good, gap, 0), box, "same")
        spread = spread[(len(spread) - width) // 2 :][:width] if len(spread) > width else spread
        offset = np.where(near > 0.5, spread / np.maximum(near, 1), 0)
        out[k] += np.clip(offset, -MOST_OFFSET, MOST_OFFSET) * fading
    out = np.clip(out, 0, 255)
    return out.transpose(0, 2, 1) if seam.turned else out


def handed_over(strips: DataFrame, slack: int = SLACK, bias: float = BIAS, step: int = STEP, least: int = LEAST_OVERLAP, fade: int = FADE, half: int = HALF_BAND) -> DataFrame:
    """strips' key with seam (false: holes are filled plainly), turned, below, path, take, and bands: the composite with the taken pixels of the feathered new frame.

    strips: key, h, w, old and new (arrays of bands), filled and valid (arrays
    of booleans); all row by row.  The seam is sought on the bands' mean.
    """

    def hand_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for r in range(batch.num_rows):
                h, w = batch.column("h")[r].as_py(), batch.column("w")[r].as_py()
                old, new = (np.array([np.asarray(b.values).reshape(h, w) for b in batch.column(c)[r]], float) for c in ("old", "new"))
                filled, valid = (batch.column(c)[r].values.to_numpy(zero_copy_only=False).astype(bool).reshape(h, w) for c in ("filled", "valid"))
                seam = seam_between(old.mean(axis=0), new.mean(axis=0), filled, valid, slack, bias, step, least)
                take = seam.take if seam else valid & ~filled
                given = feathered(old, new, seam, fade, half) if seam else new
                bands = np.where(take, np.rint(given), np.where(filled, old, 0)).astype(np.int32)
                done.append((seam is not None, seam.turned if seam else None, seam.below if seam else None, seam.path.astype(np.int32) if seam else None, take.ravel(), [b.ravel() for b in bands]))
            kinds = [pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array([d[k] for d in done], t) for k, t in enumerate(kinds))], names=["key", "seam", "turned", "below", "path", "take", "bands"])

    bool_, ints = T.BooleanType(), T.ArrayType(T.IntegerType())
    fields = [("seam", bool_), ("turned", bool_), ("below", bool_), ("path", ints), ("take", T.ArrayType(bool_)), ("bands", T.ArrayType(ints))]
    schema = T.StructType([strips.schema["key"], *[T.StructField(n, t) for n, t in fields]])
    return strips.select("key", "h", "w", "old", "new", "filled", "valid").mapInArrow(hand_over, schema)
