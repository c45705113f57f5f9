"""Quality checks of crops, tiles and rows; grid refit; run-wide statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the checks.
SPACING_LIMIT, SHIFT_IRREGULAR, MIN_CLEAN, FEASIBLE, TINY_PX, FULL_PCT = 0.08, 0.18, 20, 1.12, 100, 99.5


def crossed(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a table that is one row by construction (an aggregate without keys)."""
    return df.join(F.broadcast(one_row))


def mode_first_seen(df: DataFrame, value: str, ord_: str, by: list[str] | None = None) -> DataFrame:
    """The most frequent value; of equally frequent ones that seen first."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(ord_).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"))


def mode_smallest(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The most frequent value; of equally frequent ones the smallest."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("mode"))


def nearest_to_median(df: DataFrame, value: str, ord_: str) -> DataFrame:
    """median, and the actual value next to it (the first on ties): one row."""
    mid = df.agg(F.median(value).alias("median"))
    return crossed(df, mid).agg(F.first("median").alias("median"), F.min_by(value, F.struct(F.abs(F.col(value) - F.col("median")), F.col(ord_))).alias("chosen"))


def spacing_outliers(df: DataFrame, pitch: str) -> DataFrame:
    """df with ratio to the run's median pitch and whether it is off by more than the limit."""
    mid = df.where(F.col(pitch).isNotNull()).agg(F.median(pitch).alias("run_pitch"))
    ratio = F.col(pitch) / F.col("run_pitch")
    return crossed(df, mid).withColumns({"ratio": F.round(ratio, 6), "outlier": F.abs(ratio - 1) > SPACING_LIMIT})


def row_flags(report: DataFrame) -> DataFrame:
    """One flag text for each plot with something to say: not measured, odd row count, odd spacing."""
    usual = mode_first_seen(report.where("ok"), "rows_found", "ord").withColumnRenamed("mode", "usual")
    seen = crossed(spacing_outliers(report, "pitch_mm"), usual)
    flags = F.array_compact(F.array(
        F.when(~F.col("ok"), F.lit("rows not measured")),
        F.when(F.col("ok") & (F.col("rows_found") != F.col("usual")), F.concat(F.col("rows_found").cast("string"), F.lit(" rows, usually "), F.col("usual").cast("string"))),
        F.when(F.col("ok") & F.col("outlier"), F.lit("row spacing off")),
    ))
    return seen.select("plot_stem", F.array_join(flags, "; ").alias("flags")).where("flags <> ''")


def flags_of(parts: DataFrame) -> DataFrame:
    """(plot, flags) from rows (plot, seq, flag): joined by "; " in order of seq."""
    return parts.groupBy("plot").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "flag"))), lambda x: x.flag), "; ").alias("flags"))


def crop_status(manifest: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """Each crop's result by what is there: MISSING, RESAMPLED, NO SOURCE BOX, NO SOURCE or COMPARE."""
    out = manifest.join(files.select(F.col("file").alias("raw_file"), F.lit(True).alias("has_file")), "raw_file", "left")
    out = out.join(sources.select(F.col("path").alias("source_path"), F.lit(True).alias("has_source")), "source_path", "left")
    result = F.when(F.col("has_file").isNull(), "MISSING").when(F.col("raw_style") == "rectify", "RESAMPLED").when(F.col("src_x0").isNull(), "NO SOURCE BOX").when(F.col("has_source").isNull(), "NO SOURCE").otherwise("COMPARE")
    return out.withColumn("result", result).drop("has_file", "has_source")


def compare_pixels(crops: DataFrame, sources: DataFrame, boxes: DataFrame) -> DataFrame:
    """(raster_id, inside, identical, max_diff, result) of crops (raster_id, row, col, value) at their boxes (x0, y0) of sources (source_id, row, col, value).

    A pixel is inside where the crop's value is over 0; a crop with a larger
    difference than none is FAIL.
    """
    placed = crops.join(boxes, "raster_id").select("raster_id", "source_id", (F.col("row") + F.col("y0")).alias("row"), (F.col("col") + F.col("x0")).alias("col"), F.col("value").alias("crop"))
    both = placed.join(sources.select("source_id", "row", "col", "value"), ["source_id", "row", "col"], "left")
    inside = F.col("crop") > 0
    diff = F.abs(F.col("crop") - F.coalesce("value", F.lit(-65536)))
    out = both.groupBy("raster_id").agg(F.count(F.when(inside, 1)).alias("inside"), F.count(F.when(inside & (diff == 0), 1)).alias("identical"), F.max(F.when(inside, diff)).alias("max_diff"))
    return out.withColumn("result", F.when(F.col("inside") == F.col("identical"), "IDENTICAL").otherwise("FAIL"))


def usable_tiles(tiles: DataFrame, report: DataFrame) -> DataFrame:
    """tiles with in_usable_length: along the row they end within the plot's usable length, to a pixel."""
    side = report.groupBy("plot_stem").agg(F.max_by(F.struct("usable_lo", "usable_hi"), "ord").alias("u"))
    joined = tiles.join(side, "plot_stem", "left")
    ok = (F.col("y0") >= F.col("u.usable_lo") - 1) & (F.col("y0") + F.col("h") <= F.col("u.usable_hi") + 1)
    return joined.withColumn("in_usable_length", F.when(F.col("u").isNull(), F.lit(None)).otherwise(ok)).drop("u")


def block_choice(rows: DataFrame, by: str, at: str, pos: str, n: int, pitch: Column, centre: Column) -> DataFrame:
    """Start of the n adjoining rows with the most regular gaps nearest the centre: 3 mean |gap - pitch| + |middle - centre|; the first on ties."""
    w = Window.partitionBy(by).orderBy(at)
    rows = rows.withColumns({"_gap": F.abs(F.col(pos) - F.lag(pos).over(w) - pitch), "_last": F.lead(pos, n - 1).over(w)})
    rows = rows.withColumn("score", 3 * F.avg("_gap").over(w.rowsBetween(1, n - 1)) + F.abs((F.col(pos) + F.col("_last")) / 2 - centre))
    whole = rows.where(F.col("_last").isNotNull()).withColumn("score", F.round("score", 6))
    return whole.groupBy(by).agg(F.min_by(at, F.struct("score", at)).alias("start"), F.min("score").alias("score"))


def refit(measures: DataFrame, pitch: float, max_shift: float) -> DataFrame:
    """measures (plot_id, offset, gap_err, clean) with global_mm, resid_mm, shift_mm and action.

    The run's offset is the median of clean plots, 0 below MIN_CLEAN of them;
    a plot's own rest is added unless its gaps are irregular or it is large.
    """
    run = measures.where("clean").agg(F.when(F.count("*") >= MIN_CLEAN, F.median("offset")).otherwise(0.0).alias("global_mm"))
    out = crossed(measures, run).withColumn("resid_mm", F.col("offset") - F.col("global_mm"))
    action = F.when(F.col("offset").isNull(), "global_only").when(F.col("gap_err") > SHIFT_IRREGULAR * pitch, "irregular").when(F.abs("resid_mm") > max_shift * pitch, "large_residual").otherwise("shifted")
    out = out.withColumn("action", action)
    return out.withColumn("shift_mm", F.col("global_mm") + F.when(F.col("action") == "shifted", F.col("resid_mm")).otherwise(0.0))


def feasible(gap: Column, pitch: Column) -> Column:
    """Whether the gap to the neighbour leaves room to tell rows apart; else the refit refuses with code 3."""
    return F.when(gap / pitch >= FEASIBLE, 0).otherwise(3)


def affine_fit(points: DataFrame, by: str) -> DataFrame:
    """x = a col + b row + c and y = d col + e row + f for each group of points (col, row, x, y): least squares by sums.

    Centred sums make it two unknowns; groups whose points lie on a line, or
    are under three, have nulls.
    """
    mean = points.groupBy(by).agg(*[F.avg(k).alias(f"m_{k}") for k in ("col", "row", "x", "y")], F.count("*").alias("n"))
    d = points.join(mean, by)
    for k in ("col", "row", "x", "y"):
        d = d.withColumn(f"d_{k}", F.col(k) - F.col(f"m_{k}"))
    s = lambda p, q: F.sum(F.col(f"d_{p}") * F.col(f"d_{q}")).alias(f"s_{p}_{q}")
    sums = d.groupBy(by, "n", "m_col", "m_row", "m_x", "m_y").agg(s("col", "col"), s("col", "row"), s("row", "row"), s("col", "x"), s("row", "x"), s("col", "y"), s("row", "y"))
    det = F.col("s_col_col") * F.col("s_row_row") - F.col("s_col_row") * F.col("s_col_row")
    det = F.when((F.col("n") >= 3) & (F.abs(det) > 1e-9), det)
    for k, (p, q, r) in {"x": ("a", "b", "c"), "y": ("d", "e", "f")}.items():
        sums = sums.withColumns({p: (F.col(f"s_col_{k}") * F.col("s_row_row") - F.col(f"s_row_{k}") * F.col("s_col_row")) / det, q: (F.col(f"s_row_{k}") * F.col("s_col_col") - F.col(f"s_col_{k}") * F.col("s_col_row")) / det})
        sums = sums.withColumn(r, F.col(f"m_{k}") - F.col(p) * F.col("m_col") - F.col(q) * F.col("m_row"))
    return sums.select(by, "n", "a", "b", "c", "d", "e", "f")


def affine_residuals(points: DataFrame, by: str) -> DataFrame:
    """affine_fit's groups with the mean and the largest distance of their points from the fit; null where there is none."""
    fit = affine_fit(points, by)
    at = points.join(fit, by)
    off = F.hypot(F.col("a") * F.col("col") + F.col("b") * F.col("row") + F.col("c") - F.col("x"), F.col("d") * F.col("col") + F.col("e") * F.col("row") + F.col("f") - F.col("y"))
    return fit.join(at.groupBy(by).agg(F.avg(off).alias("mean_off"), F.max(off).alias("max_off")), by)


def stitch(tiles: DataFrame, by: str, row: str, col: str, value: str, ord_: str) -> DataFrame:
    """One value for each pixel: that of the last tile that covers it."""
    return tiles.groupBy(by, row, col).agg(F.max_by(value, ord_).alias(value))


def quarter_turn(pixels: DataFrame, width: int) -> DataFrame:
    """(row, col) after a turn of 90 degrees: row = width - 1 - col, col = row."""
    return pixels.withColumns({"row": F.lit(width - 1) - F.col("col"), "col": F.col("row")})


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths of before whose size or time differ, or that are gone, in after (path, length, modified)."""
    b = after.select("path", F.col("length").alias("l2"), F.col("modified").alias("m2"))
    return before.join(b, "path", "left").where(~(F.col("length").eqNullSafe(F.col("l2")) & F.col("modified").eqNullSafe(F.col("m2")))).select("path", F.col("l2").isNull().alias("gone"))


def upsert_sections(recipe: DataFrame, new: DataFrame) -> DataFrame:
    """(section, body) rows where new sections replace old ones and others stay."""
    return recipe.join(new, "section", "left_anti").unionByName(new)
