"""Generators: plot grids, crop rows, tiles along a span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def starts(a: Column, b: Column, tile: Column, stride: Column) -> Column:
    """Tile starts that cover [a, b): every stride, the last flush with b; one at a where the span is no longer than a tile."""
    return F.when(b - a <= tile, F.array(a)).otherwise(F.array_union(F.sequence(a, b - tile, stride), F.array(b - tile)))


def tile_grid(crops: DataFrame, tile: int, stride: int, whole_only: bool = False) -> DataFrame:
    """crops (w, h) with one row for each tile: col, row, x, y, tw, th, in reading order; tiles cut below half a side go."""
    t, s, zero = F.lit(tile), F.lit(stride), F.lit(0)
    out = crops.select("*", F.posexplode(starts(zero, F.col("h").cast("int"), t, s)).alias("row", "y")).select("*", F.posexplode(starts(zero, F.col("w").cast("int"), t, s)).alias("col", "x"))
    out = out.withColumns({"tw": F.least(t, F.col("w") - F.col("x")), "th": F.least(t, F.col("h") - F.col("y"))})
    if whole_only:
        return out.where((F.col("tw") == tile) & (F.col("th") == tile))
    return out.where((F.col("tw") >= tile // 2) & (F.col("th") >= tile // 2))


def row_tiles(rows: DataFrame, length: int, stride: int) -> DataFrame:
    """rows (span) with tile_k and start of each tile: as many as fit, centred in the span; none where span is shorter."""
    n = F.floor((F.col("span") - length) / stride).cast("int") + 1
    fits = rows.where(F.col("span") >= length).withColumn("n", n)
    lead = F.floor((F.col("span") - ((F.col("n") - 1) * stride + length)) / 2)
    return fits.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("tile_k")).withColumn("start", lead + F.col("tile_k") * stride).drop("n")


def slot_edges(n: Column, size: float, gap: float) -> Column:
    """(lo, hi) of n slots as shares of the whole, with gaps between."""
    total = n * size + (n - 1) * gap
    slot = lambda i: F.struct((i * (size + gap) / total).alias("lo"), ((i * (size + gap) + size) / total).alias("hi"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), slot))


def grid_of(banks: DataFrame, width: float, length: float, gap_x: float, gap_y: float) -> DataFrame:
    """Plots of fixed size in metres for each bank: banks has b (from 0) and n (plots in it)."""
    out = banks.where("n > 0").select("b", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("r"))
    x0, y0 = F.col("r") * (width + gap_x), F.col("b") * (length + gap_y)
    return out.select("b", "r", x0.alias("x0"), y0.alias("y0"), (x0 + width).alias("x1"), (y0 + length).alias("y1"))


def rows_from_count(plots: DataFrame, pitch: Column | None = None) -> DataFrame:
    """plots (width, n) with row_idx from 1 and v, the row's distance from the middle; none where n is not positive."""
    step = pitch if pitch is not None else F.col("width") / F.col("n")
    out = plots.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    return out.withColumns({"row_idx": F.col("k") + 1, "v": (F.col("k") - (F.col("n") - 1) / 2) * step}).drop("k")


def renumber(rows: DataFrame, by: str, v: str, ord_: str) -> DataFrame:
    """row_idx from 1 in each plot by v, equal ones in their order."""
    return rows.withColumn("row_idx", F.row_number().over(Window.partitionBy(by).orderBy(v, ord_)))


def even_spacing(rows: DataFrame, by: str, v: str, ord_: str) -> DataFrame:
    """v spread evenly between the first and last row of each plot of three rows or more."""
    w = Window.partitionBy(by)
    k = F.row_number().over(w.orderBy(v, ord_)) - 1
    n, lo, hi = F.count("*").over(w), F.min(v).over(w), F.max(v).over(w)
    return rows.withColumn("v_even", F.when(n < 3, F.col(v)).otherwise(lo + (hi - lo) * k / F.nullif(n - 1, F.lit(0))))


def spread_pick(cands: DataFrame, by: str, ord_: str, n: int) -> DataFrame:
    """At most n rows of each group, evenly over its order: places of a line from first to last, rounded half to even."""
    w = Window.partitionBy(by)
    cands = cands.withColumns({"_i": F.row_number().over(w.orderBy(ord_)) - 1, "_n": F.count("*").over(w)})
    places = F.transform(F.sequence(F.lit(0), F.lit(max(0, n - 1))), lambda k: F.bround(k * (F.col("_n") - 1) / max(1, n - 1)).cast("int"))
    return cands.where((F.col("_n") <= n) | F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def hash_pick(cands: DataFrame, by: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """At most n rows of each group by a hash of key: an equal chance for all, the same in every run."""
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return cands.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")
