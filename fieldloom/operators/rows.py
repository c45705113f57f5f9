"""Row detection on profiles (by, at, v), and the choice of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge_smooth(df: DataFrame, by: str, at: str, v: str, k: int) -> Column:
    """Mean of the k values around; beyond the ends the end values repeat, and k // 2 lie before."""
    before, after = k // 2, k - 1 - k // 2
    w = Window.partitionBy(by).orderBy(at)
    whole = Window.partitionBy(by)
    i, n = F.row_number().over(w), F.count("*").over(whole)
    inner = F.sum(v).over(w.rowsBetween(-before, after))
    lead = F.greatest(F.lit(0), F.lit(before) - (i - 1)) * F.min_by(v, at).over(whole)
    trail = F.greatest(F.lit(0), F.lit(after) - (n - i)) * F.max_by(v, at).over(whole)
    return (inner + lead + trail) / k


def ridge(df: DataFrame, by: str, at: str, v: str, narrow: int, wide: int) -> DataFrame:
    """signal: narrow mean less wide mean, over its population deviation."""
    d = df.withColumn("_r", edge_smooth(df, by, at, v, narrow) - edge_smooth(df, by, at, v, wide))
    sd = F.stddev_pop("_r").over(Window.partitionBy(by))
    return d.withColumn("signal", F.coalesce(F.col("_r") / F.nullif(sd, F.lit(0.0)), F.lit(0.0))).drop("_r")


def fine_pitch(df: DataFrame, by: str, at: str, v: str, pitch: Column, steps: int = 241, lo: float = 0.94, hi: float = 1.06) -> DataFrame:
    """The pitch near a rough one whose wave is strongest, of steps even candidates; the first on ties."""
    share = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(i.alias("i"), (lo + i * (hi - lo) / (steps - 1)).alias("f"))))
    c = df.select(by, at, v, pitch.alias("_p"), share.alias("c")).withColumn("pitch", F.col("_p") * F.col("c.f"))
    turn = 2 * math.pi * F.col(at) / F.col("pitch")
    power = c.groupBy(by, "c", "pitch").agg(F.sum(F.col(v) * F.cos(turn)).alias("a"), F.sum(F.col(v) * F.sin(turn)).alias("b"))
    power = power.withColumn("power", F.round(F.col("a") * F.col("a") + F.col("b") * F.col("b"), 5))
    return power.groupBy(by).agg(F.max_by("pitch", F.struct("power", -F.col("c.i"))).alias("pitch"))


def best_block(rows: DataFrame, by: str, at: str, contrast: str, n: int) -> DataFrame:
    """Start of the n adjoining rows with the largest sum of contrast, all of which have one; the first on ties."""
    w = Window.partitionBy(by).orderBy(at).rowsBetween(0, n - 1)
    r = rows.withColumns({"_s": F.round(F.sum(contrast).over(w), 6), "_n": F.count(contrast).over(w)}).where(F.col("_n") == n)
    return r.groupBy(by).agg(F.max_by(at, F.struct("_s", -F.col(at))).alias("start"), F.max("_s").alias("contrast"))


def middle_block(rows: DataFrame, by: str, at: str, pos: str, n: int, centre: Column) -> DataFrame:
    """Start of the n adjoining rows whose middle is nearest centre (to a thousandth), then nearest the middle of all."""
    w, whole = Window.partitionBy(by).orderBy(at), Window.partitionBy(by)
    mid = (F.col(pos) + F.lead(pos, n - 1).over(w)) / 2
    r = rows.withColumns({"_m": mid, "_all": (F.min(pos).over(whole) + F.max(pos).over(whole)) / 2}).where(F.col("_m").isNotNull())
    key = F.struct(F.round(F.abs(F.col("_m") - centre), 3).alias("a"), F.round(F.abs(F.col("_m") - F.col("_all")), 6).alias("b"), F.col(at).alias("i"))
    return r.groupBy(by).agg(F.min_by(at, key).alias("start"))


def present_run(rows: DataFrame, by: str, at: str, present: Column) -> DataFrame:
    """Rows from the first to the last present one, those between too."""
    ends = rows.where(present).groupBy(by).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    return rows.join(ends, by).where(F.col(at).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def row_band(peaks: DataFrame, spans: DataFrame, by: str, pos: str, half: float) -> DataFrame:
    """(lo, hi) of each signal: half beyond its outer peaks, inside its span (n); the span where it has under two peaks."""
    p = peaks.groupBy(by).agg(F.min(pos).alias("a"), F.max(pos).alias("b"), F.count("*").alias("k"))
    out = spans.join(p, by, "left")
    ok = F.coalesce(F.col("k") >= 2, F.lit(False))
    return out.select(by, F.when(ok, F.greatest(F.lit(0.0), F.col("a") - half)).otherwise(0.0).alias("lo"), F.when(ok, F.least(F.col("n").cast("double"), F.col("b") + half)).otherwise(F.col("n").cast("double")).alias("hi"))


def keep_sparse(tiles: DataFrame, veg: Column, least: float, share: float, key: Column, seed: int = 7) -> DataFrame:
    """tiles with at least so much green, and of the others a share by a hash of key: an equal chance, the same in every run."""
    chance = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000
    return tiles.where((veg >= least) | (chance < share))


def mesh_cells(nodes: DataFrame, by: list[str], value: str) -> DataFrame:
    """Cells (i, j) of a node mesh whose four nodes are all there, with their mean value."""
    at = lambda di, dj, name: nodes.select(*by, (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col(value).alias(name))
    out = at(0, 0, "v00").join(at(1, 0, "v10"), [*by, "i", "j"]).join(at(0, 1, "v01"), [*by, "i", "j"]).join(at(1, 1, "v11"), [*by, "i", "j"])
    corners = [F.col(c) for c in ("v00", "v10", "v01", "v11")]
    whole = out.where(corners[0].isNotNull() & corners[1].isNotNull() & corners[2].isNotNull() & corners[3].isNotNull())
    return whole.withColumn("mean", (corners[0] + corners[1] + corners[2] + corners[3]) / 4)


def tile_result(same: Column, shape_ok: Column, bits: Column, src_bits: Column, scaled_same: Column) -> Column:
    """Result of a tile against its window: RESAMPLED, IDENTICAL, EXACT CONVERSION or FAIL."""
    return F.when(~shape_ok, "RESAMPLED").when((bits == src_bits) & same, "IDENTICAL").when((bits != src_bits) & scaled_same, "EXACT CONVERSION").otherwise("FAIL")


def scale_of_points(crops: DataFrame, by: str, points: str, least_px: float) -> DataFrame:
    """pairs and median ground metres for each pixel, over pairs of a crop's control points (k, col, row, x, y) at least least_px pixels apart.

    A crop has a bounded number of points (25), so pairs are made in its row.
    """
    pixels = lambda a, b: F.hypot(a.col - b.col, a.row - b.row)
    later = lambda a: F.filter(points, lambda b: (b.k > a.k) & (pixels(a, b) >= least_px))
    ratios = F.flatten(F.transform(points, lambda a: F.transform(later(a), lambda b: F.hypot(a.x - b.x, a.y - b.y) / pixels(a, b))))
    each = crops.select(by, F.array_sort(ratios).alias("r")).where(F.size("r") > 0)
    at = lambda i: F.get("r", i.cast("int"))
    middle = (at(F.floor((F.size("r") - 1) / 2)) + at(F.floor(F.size("r") / 2))) / 2
    return each.select(by, F.size("r").cast("long").alias("pairs"), F.round(middle, 9).alias("scale"))
