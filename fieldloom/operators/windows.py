"""Windows of rasters in a plot's own axes: sample grids that meet raster blocks by their keys.

A raster is a table of blocks: raster, by, bx (the block's place), x0, y0, w, h
(its cells) and bands (an array for each band, row by row).  A window is a grid
of samples, i along and j across, whose cell is a bilinear function of i and j.
Windows are sent to the blocks that they overlap, so a task holds one block
and one window's numbers; no cell or sample is a row before it is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a raster that a grid of samples reads at least; a smaller overlap is none.
LEAST_CELLS = 4
#: Samples of a profile leave out this much of a plot's length at both ends.
PROFILE_ENDS = (0.06, 0.94)
VALID_ABOVE = 4


def to_blocks(cells: DataFrame, raster: str, size: int, bands: list[str]) -> DataFrame:
    """Blocks of size by size cells of cells (raster, row, col and bands); a block's cells make a full rectangle, at most one for each place."""
    row, col = F.col("row").cast("long"), F.col("col").cast("long")
    placed = cells.select(raster, F.floor(row / size).alias("by"), F.floor(col / size).alias("bx"), F.struct(row.alias("row"), col.alias("col"), *bands).alias("c"))
    one = placed.groupBy(raster, "by", "bx").agg(F.sort_array(F.collect_list("c")).alias("cells"), F.min("c.col").alias("x0"), F.min("c.row").alias("y0"), (F.max("c.col") - F.min("c.col") + 1).alias("w"), (F.max("c.row") - F.min("c.row") + 1).alias("h"))
    whole = F.when(F.size("cells") != F.col("w") * F.col("h"), F.raise_error(F.lit("a block's cells must fill a rectangle, each once")).cast("array<array<int>>"))
    return one.select(raster, "by", "bx", "x0", "y0", "w", "h", whole.otherwise(F.array(*[F.col(f"cells.{b}").cast("array<int>") for b in bands])).alias("bands"))


def inverse(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(col, row) of a place by the transform t (a to f): x = a col + b row + c, y = d col + e row + f."""
    det = t.a * t.e - t.b * t.d
    return (t.e * (x - t.c) - t.b * (y - t.f)) / det, (t.a * (y - t.f) - t.d * (x - t.c)) / det


def _bilinear(v00: Column, v10: Column, v01: Column, v11: Column, n: Column, m: Column) -> Column:
    """Coefficients of 1, i, j and i j, from the values at samples 0 and n - 1 of i and 0 and m - 1 of j."""
    n1, m1 = F.greatest(n - 1, F.lit(1)).cast("double"), F.greatest(m - 1, F.lit(1)).cast("double")
    return F.array(v00, (v10 - v00) / n1, (v01 - v00) / m1, (v11 - v10 - v01 + v00) / (n1 * m1))


def oriented_windows(plots: DataFrame, rasters: DataFrame, step: float, pad_share: float = 0.15) -> DataFrame:
    """A window for each plot in its frame: n_i samples along and n_j across, pad_share of the width beyond both sides; outside says that the raster has too few cells there.

    plots: plot, raster, cx, cy (centre), ux, uy (unit axis along), vx, vy
    (across), hl, hw (half length and half width).  rasters: raster, t (the
    transform, a to f), width, height.  Rasters much finer than step are read
    by every f-th cell, f being three quarters of the cells between samples.
    """
    p = plots.join(rasters, "raster")
    count = lambda x: F.greatest(F.lit(8), F.bround(x / step).cast("int"))
    pad = pad_share * 2 * F.col("hw")
    p = p.withColumns({"n_i": count(2 * F.col("hl")), "n_j": count(2 * (F.col("hw") + pad)), "across0": -F.col("hw") - pad})
    along = lambda i: -F.col("hl") + (i + 0.5) * (2 * F.col("hl") / F.col("n_i"))
    across = lambda j: F.col("across0") + (j + 0.5) * step

    def cell(i: Column, j: Column) -> tuple[Column, Column]:
        u, v = along(i), across(j)
        return inverse(F.col("t"), F.col("cx") + F.col("ux") * u + F.col("vx") * v, F.col("cy") + F.col("uy") * u + F.col("vy") * v)

    return _planned(p, cell, lambda span, between: F.greatest(F.lit(1), F.floor(span / F.greatest(F.lit(1.0), 0.75 * between))).cast("long"), lambda span, read: span / read)


def profile_windows(plots: DataFrame, rasters: DataFrame, extend: float, n_across: int, n_along: int, cells_per_pitch: Column | None = None) -> DataFrame:
    """A window for each plot between its edges: n_across samples (i) from extend of its width before the low edge to as far beyond the other, n_along (j) from 6 to 94 % of its length.

    plots: plot, raster, ring (four corners in the raster's places; the first
    edge is the short one).  Samples beyond the raster take its edge cells.
    Where cells_per_pitch is given the raster is read so that a pitch has some
    30 cells.  rasters is as for oriented_windows.
    """
    p = plots.join(rasters, "raster").withColumns({"n_i": F.lit(n_across), "n_j": F.lit(n_along)})
    a, b, c, d = (F.get("ring", F.lit(k)) for k in range(4))
    lo, hi = PROFILE_ENDS

    def cell(i: Column, j: Column) -> tuple[Column, Column]:
        s, t = -extend + i * ((1 + 2 * extend) / (n_across - 1)), lo + j * ((hi - lo) / (n_along - 1))
        at = lambda k: a[k] + s * (b[k] - a[k]) + t * (d[k] - a[k]) + s * t * (c[k] - b[k] - d[k] + a[k])
        return inverse(F.col("t"), at("x"), at("y"))

    every = F.greatest(F.lit(1), F.floor((cells_per_pitch if cells_per_pitch is not None else F.lit(1)) / 30)).cast("long")
    return _planned(p, cell, lambda span, between: F.ceil(span / every).cast("long"), lambda span, read: every.cast("double"), exact=True)


def _planned(p: DataFrame, cell, read, per, exact: bool = False) -> DataFrame:
    """Windows of plots: their bilinear cells, the part of the raster that they touch, and how it is read."""
    zero, n, m = F.lit(0), F.col("n_i"), F.col("n_j")
    corners = [cell(zero, zero), cell(n - 1, zero), cell(zero, m - 1), cell(n - 1, m - 1)]
    p = p.withColumns({"col_at": _bilinear(*[c for c, _ in corners], n, m), "row_at": _bilinear(*[r for _, r in corners], n, m)})
    between = F.hypot(F.get("col_at", F.lit(1)), F.get("row_at", F.lit(1)))
    if exact:  # cells beyond the raster are its edge's
        inside = lambda v, most: F.greatest(F.lit(0).cast("long"), F.least(most.cast("long") - 1, F.floor(v)))
        cols, rows = [inside(c, F.col("width")) for c, _ in corners], [inside(r, F.col("height")) for _, r in corners]
        p = p.withColumns({"c0": F.least(*cols), "c1": F.greatest(*cols) + 1, "r0": F.least(*rows), "r1": F.greatest(*rows) + 1})
        p = p.withColumn("outside", F.lit(False))
    else:
        hold = lambda v, most: F.greatest(F.lit(0).cast("long"), F.least(most.cast("long"), v.cast("long")))
        cols, rows = [c for c, _ in corners], [r for _, r in corners]
        p = p.withColumns({
            "c0": hold(F.floor(F.least(*cols)) - 1, F.col("width")), "c1": hold(F.ceil(F.greatest(*cols)) + 2, F.col("width")),
            "r0": hold(F.floor(F.least(*rows)) - 1, F.col("height")), "r1": hold(F.ceil(F.greatest(*rows)) + 2, F.col("height")),
        })
        p = p.withColumn("outside", (F.col("c1") - F.col("c0") < LEAST_CELLS) | (F.col("r1") - F.col("r0") < LEAST_CELLS))
    high, wide = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    p = p.withColumns({"oh": read(high, between), "ow": read(wide, between)})
    return p.withColumns({"per_r": per(high, F.col("oh")).cast("double"), "per_c": per(wide, F.col("ow")).cast("double")})


_PLAN = ("n_i", "n_j", "col_at", "row_at", "c0", "c1", "r0", "r1", "oh", "ow", "per_r", "per_c")
PART_DDL = "at array<int>, bands array<array<int>>"


def cells_of(plan: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the raster that a window's samples take, j by j: the nearest cell of those that are read, the edge's beyond them."""
    i, j = np.arange(plan["n_i"], dtype=float), np.arange(plan["n_j"], dtype=float)[:, None]

    def taken(q, first, last, read, per):
        place = q[0] + q[1] * i + q[2] * j + q[3] * (i * j)
        nth = np.clip(((place - first) / per).astype(np.int64), 0, read - 1)
        return first + ((2 * nth + 1) * (last - first)) // (2 * read)

    return taken(plan["row_at"], plan["r0"], plan["r1"], plan["oh"], plan["per_r"]), taken(plan["col_at"], plan["c0"], plan["c1"], plan["ow"], plan["per_c"])


def sampled(windows: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """The samples of windows in each block: plot, n_i, n_j, at (places j * n_i + i) and bands (their values).

    Windows that lie outside have none, and neither have the samples in cells
    that no block has.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size)))
    keyed = windows.where("not outside").select("plot", "raster", *_PLAN, span("r0", "r1").alias("by")).select("*", span("c0", "c1").alias("bx"))
    met = keyed.join(blocks, ["raster", "by", "bx"])
    out = T.StructType([windows.schema["plot"], T.StructField("n_i", T.IntegerType()), T.StructField("n_j", T.IntegerType()), *T._parse_datatype_string(PART_DDL).fields])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = batch.select(["plot", *_PLAN, "x0", "y0", "w", "h"]).to_pylist()
            bands = batch.column("bands")
            for k, plan in enumerate(plans):
                row, col = cells_of(plan)
                x, y = col - plan["x0"], row - plan["y0"]
                at = np.flatnonzero(((x >= 0) & (x < plan["w"]) & (y >= 0) & (y < plan["h"])).ravel())
                if not len(at):
                    continue
                cell = (y * plan["w"] + x).ravel()[at]
                values = [np.asarray(band.values)[cell] for band in bands[k]]
                yield pa.RecordBatch.from_pydict({
                    "plot": batch.column("plot").slice(k, 1), "n_i": pa.array([plan["n_i"]], pa.int32()), "n_j": pa.array([plan["n_j"]], pa.int32()),
                    "at": pa.array([at.astype(np.int32)], pa.list_(pa.int32())), "bands": pa.array([[v.astype(np.int32) for v in values]], pa.list_(pa.list_(pa.int32()))),
                })

    return met.select("plot", *_PLAN, "x0", "y0", "w", "h", "bands").mapInArrow(sample, out)


def samples(parts: DataFrame, names: list[str]) -> DataFrame:
    """One row for each sample of sampled: plot, n_i, n_j, i, j and a column for each band."""
    zipped = F.explode(F.arrays_zip(F.col("at"), *[F.get("bands", F.lit(k)).alias(n) for k, n in enumerate(names)])).alias("s")
    each = parts.select("plot", "n_i", "n_j", zipped)
    return each.select("plot", "n_i", "n_j", (F.col("s.at") % F.col("n_i")).alias("i"), F.expr("s.at div n_i").cast("int").alias("j"), *[F.col(f"s.{n}").alias(n) for n in names])


def eight_bits(samples_: DataFrame, names: list[str], share: float = 0.995) -> DataFrame:
    """Bands of samples with 16 bits as 0 to 255: over the given percentile of all bands of the plot (255 where that is 0), cut off beyond."""
    top = samples_.select("plot", F.explode(F.array(*names)).alias("v")).groupBy("plot").agg(F.percentile("v", share).alias("_p"))
    scale = F.when(F.col("_p") == 0, 1.0).otherwise(F.col("_p"))
    held = samples_.join(top, "plot")
    return held.withColumns({n: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(n) / scale * 255)).cast("int") for n in names}).drop("_p")


def greenness_profiles(samples_: DataFrame, windows: DataFrame, valid: Column | None = None) -> DataFrame:
    """plot, profile: mean of 2 g - r - b over the valid samples of each step across (i); null where under half of a plot's samples are valid.

    valid is what makes a sample valid; without it one whose largest band is
    above 4.  A step without a valid sample has 0.
    """
    valid = valid if valid is not None else F.greatest("r", "g", "b") > VALID_ABOVE
    green = F.when(valid, (2 * F.col("g") - F.col("r") - F.col("b")).cast("double"))
    steps = samples_.groupBy("plot", "i").agg(F.coalesce(F.avg(green), F.lit(0.0)).alias("v"), F.count(green).alias("n"))
    plots = steps.groupBy("plot").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("steps"), F.sum("n").alias("n"))
    all_ = windows.select("plot", (F.col("n_i") * F.col("n_j")).alias("all"), "n_i").join(plots, "plot", "left")
    whole = F.transform(F.sequence(F.lit(0), F.col("n_i") - 1), lambda i: F.coalesce(F.try_element_at(F.map_from_arrays("steps.i", "steps.v"), i), F.lit(0.0)))
    return all_.select("plot", F.when(F.coalesce(F.col("n"), F.lit(0)) >= 0.5 * F.col("all"), F.when(F.size("steps") == F.col("n_i"), F.col("steps.v")).otherwise(whole)).alias("profile"))
