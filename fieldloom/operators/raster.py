"""Pixels as rows (raster, row, col, value): statistics, layers, blocks and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A pixel is valid above this in tiles; oblique frames fill last.
VALID_ABOVE, CLEAN_ANISO, MIN_OVERLAP, SCALE_LO, SCALE_HI = 4, 1.6, 500, 0.6, 1.6


def excess_green(r: Column, g: Column, b: Column) -> Column:
    return 2 * g - r - b


def chromatic_excess_green(r: Column, g: Column, b: Column) -> Column:
    """Excess green over the sum of the channels; 0 for black."""
    return F.coalesce((2 * g - r - b) / F.nullif(r + g + b, F.lit(0)), F.lit(0.0))


def crop(pixels: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """The pixels of a box, counted from its corner."""
    inside = F.col("col").between(x0, x0 + w - 1) & F.col("row").between(y0, y0 + h - 1)
    return pixels.where(inside).withColumns({"row": F.col("row") - y0, "col": F.col("col") - x0})


def stretch(pixels: DataFrame, by: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """shown: value spread over 0 to 255 between two percentiles of its raster, cut off beyond."""
    ends = pixels.groupBy(by).agg(F.percentile("value", [lo, hi]).alias("e"))
    share = (F.col("value") - F.col("e")[0]) / F.greatest(F.col("e")[1] - F.col("e")[0], F.lit(1.0))
    return pixels.join(ends, by).withColumn("shown", F.floor(255 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(share, 9))) + 0.5).cast("int")).drop("e")


def reduced(pixels: DataFrame, by: str, factor: int) -> DataFrame:
    """Means of factor by factor blocks."""
    out = pixels.groupBy(by, F.expr(f"row div {factor}").alias("row"), F.expr(f"col div {factor}").alias("col"))
    return out.agg(F.avg("value").alias("value"))


def pyramid(pixels: DataFrame, by: str, levels: int) -> DataFrame:
    """(level, row, col, value): the raster and its halvings; each level comes from the one before."""
    at = pixels.select(by, F.lit(0).alias("level"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    out = at
    for level in range(1, levels + 1):
        at = reduced(at, by, 2).select(by, F.lit(level).alias("level"), "row", "col", "value")
        out = out.unionByName(at)
    return out


def filled(layers: DataFrame, by: str) -> DataFrame:
    """Each pixel from one frame: the first valid layer, upright frames before oblique ones, in order of rank.

    layers: by, row, col, value, rank, aniso.
    """
    valid = layers.where(F.col("value") > 0)
    key = F.struct((F.col("aniso") > CLEAN_ANISO).cast("int").alias("oblique"), F.col("rank").alias("rank"))
    return valid.groupBy(by, "row", "col").agg(F.min_by(F.struct("value", "rank"), key).alias("p")).select(by, "row", "col", F.col("p.value").alias("value"), F.col("p.rank").alias("source"))


def matched(pixels: DataFrame, by: str, base: str, other: str, least: int = MIN_OVERLAP) -> DataFrame:
    """(by, n, scale, offset) that bring other to base where both are there: by means and population deviations, the scale held in bounds; 1 and 0 below least pixels."""
    both = (F.col(base) > 0) & (F.col(other) > 0)
    pick = lambda c: F.when(both, F.col(c))
    g = pixels.groupBy(by).agg(F.count(F.when(both, 1)).alias("n"), F.avg(pick(base)).alias("mb"), F.avg(pick(other)).alias("mo"), F.stddev_pop(pick(base)).alias("sb"), F.stddev_pop(pick(other)).alias("so"))
    scale = F.least(F.lit(SCALE_HI), F.greatest(F.lit(SCALE_LO), F.coalesce(F.try_divide("sb", "so"), F.lit(1.0))))
    g = g.withColumn("scale", F.when(F.col("n") > least, scale).otherwise(1.0))
    return g.select(by, "n", "scale", F.when(F.col("n") > least, F.col("mb") - F.col("scale") * F.col("mo")).otherwise(0.0).alias("offset"))


def seam_place(sources: DataFrame, by: str) -> DataFrame:
    """Median row at which a column's source changes, for each raster with a change."""
    before = F.lag("source").over(Window.partitionBy(by, "col").orderBy("row"))
    turns = sources.withColumn("_b", before).where(F.col("_b").isNotNull() & (F.col("_b") != F.col("source")))
    return turns.groupBy(by).agg(F.median("row").alias("seam"), F.count("*").alias("turns"))


def difference(pairs: DataFrame, by: str, a: str, b: str, top: float = 255.0) -> DataFrame:
    """How b differs from a: mean and 99th percentile of |a-b|, root mean square, share changed, signal to noise in dB (null where equal), levels of b."""
    d = F.abs(F.col(a) - F.col(b))
    g = pairs.groupBy(by).agg(F.avg(d).alias("mean_abs"), F.percentile(d, 0.99).alias("p99_abs"), F.sqrt(F.avg(d * d)).alias("rms"), F.avg((d > 0).cast("int")).alias("changed"), F.countDistinct(b).alias("levels"))
    return g.withColumn("psnr", 20 * F.log10(top / F.nullif(F.col("rms"), F.lit(0.0))))


def detail(pixels: DataFrame, by: str) -> DataFrame:
    """Population deviation of the Laplacian over pixels with four neighbours."""
    across, down = Window.partitionBy(by, "row").orderBy("col"), Window.partitionBy(by, "col").orderBy("row")
    lap = F.lag("value").over(across) + F.lead("value").over(across) + F.lag("value").over(down) + F.lead("value").over(down) - 4 * F.col("value")
    return pixels.withColumn("_lap", lap).where(F.col("_lap").isNotNull()).groupBy(by).agg(F.stddev_pop("_lap").alias("detail"), F.count("*").alias("n"))


def profile_bins(pixels: DataFrame, by: str, green: float) -> DataFrame:
    """Of each column: pixels, share of green ones and mean value; null where three pixels or fewer are valid."""
    valid = F.col("value") > VALID_ABOVE
    g = pixels.groupBy(by, F.col("col").alias("bin")).agg(F.count(F.when(valid, 1)).alias("n"), F.avg(F.when(valid, (F.col("value") > green).cast("double"))).alias("share"), F.avg(F.when(valid, F.col("value"))).alias("mean"))
    enough = F.col("n") > 3
    return g.withColumns({"share": F.when(enough, F.col("share")), "mean": F.when(enough, F.col("mean"))})


def usable_length(bins: DataFrame, by: str, at: str, share: str, drop: float = 0.35, keep: float = 0.5) -> DataFrame:
    """(lo, hi) of each signal: first and last place above drop times the median of its middle half; the whole where that is under keep of it."""
    w = Window.partitionBy(by)
    n, lo, hi = F.count("*").over(w), F.min(at).over(w), F.max(at).over(w)
    bins = bins.withColumns({"_n": n, "_lo": lo, "_hi": hi})
    middle = F.col(at).between(F.col("_lo") + F.col("_n") / 4, F.col("_hi") - F.col("_n") / 4)
    level = bins.where(middle).groupBy(by).agg((drop * F.median(share)).alias("_level"))
    g = bins.join(level, by).groupBy(by).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min(F.when(F.col(share) >= F.col("_level"), F.col(at))).alias("a"), F.max(F.when(F.col(share) >= F.col("_level"), F.col(at))).alias("b"))
    ok = F.col("b") - F.col("a") + 1 >= keep * (F.col("_hi") - F.col("_lo") + 1)
    return g.select(by, F.when(ok, F.col("a")).otherwise(F.col("_lo")).alias("lo"), F.when(ok, F.col("b")).otherwise(F.col("_hi")).alias("hi"))


def crop_box(points: Column, w: Column, h: Column) -> Column:
    """(x0, y0, x1, y1) of points in a frame: truncated bounds, held inside it."""
    x, y = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    hold = lambda v, most: F.greatest(F.lit(0), F.least(most.cast("int"), v.cast("int")))
    return F.struct(hold(F.array_min(x), w).alias("x0"), hold(F.array_min(y), h).alias("y0"), hold(F.array_max(x), w).alias("x1"), hold(F.array_max(y), h).alias("y1"))


def linked(tiles: DataFrame, manifest: DataFrame) -> DataFrame:
    """tiles (plot_stem, x0, y0) with their box in the source photo, where the crop is an unturned copy of one frame.

    manifest: plot_stem, raw_style, frames_used, src_x0, src_y0, ord; the last
    row of a plot counts.
    """
    last = manifest.groupBy("plot_stem").agg(F.max_by(F.struct("raw_style", "frames_used", "src_x0", "src_y0"), "ord").alias("m"))
    out = tiles.join(last, "plot_stem", "left")
    plain = F.col("m.raw_style").isin("mask", "bbox", "native") & (F.col("m.frames_used") == 1) & F.col("m.src_x0").isNotNull()
    note = F.when(F.col("m").isNull(), "no manifest row").when(~F.coalesce(plain, F.lit(False)), "not a plain copy").otherwise("")
    return out.withColumns({"src_photo_x0": F.when(plain, F.col("m.src_x0") + F.col("x0")), "src_photo_y0": F.when(plain, F.col("m.src_y0") + F.col("y0")), "link_note": note}).drop("m")
