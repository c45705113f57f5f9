"""Rows of a rectified crop from the means of its columns: the strength of their period, and the box that holds them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.geometry import let
from fieldloom.tables import stored

# Darkest and brightest pixels that count, least share of a column, smoothing and distance of rows in spacings, least height and its percentile, share of green that ends a plot.
DARK, WHITE, LEAST_COLUMN, SMOOTH, APART, LEAST_HEIGHT, HEIGHT_PCT, END_SHARE, END_PCT = 12, 245, 0.2, 0.25, 0.55, 0.12, 0.55, 0.20, 0.95


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _mean(x: Column) -> Column:
    return _total(x) / F.size(x)


def percentile(x: Column, share: float) -> Column:
    """The percentile of an array, between neighbours in proportion."""
    def pick(s: Column) -> Column:
        at = share * (F.size(s) - 1)
        low = F.floor(at).cast("int")
        return F.get(s, low) + (at - low) * (F.get(s, F.least(low + 1, F.size(s) - 1)) - F.get(s, low))

    return let(F.sort_array(x), pick)


def without_trend(x: Column) -> Column:
    """x without its cubic trend: less its parts along the first four polynomials that are orthogonal on evenly spaced places."""
    return let(x, _without_trend)


def _without_trend(x: Column) -> Column:
    n = F.size(x).cast("double")
    at = lambda i: i - (n - 1) / 2
    waves = [lambda t: F.lit(1.0), lambda t: t, lambda t: t * t - (n * n - 1) / 12, lambda t: t * t * t - t * (3 * n * n - 7) / 20]
    places = F.sequence(F.lit(0), F.size(x) - 1)
    part = lambda f: _total(F.transform(x, lambda v, i: v * f(at(i)))) / _total(F.transform(places, lambda i: f(at(i)) * f(at(i))))
    return let(F.array(*[part(f) for f in waves]), lambda c: F.transform(x, lambda v, i: v - sum((F.get(c, F.lit(k)) * f(at(i)) for k, f in enumerate(waves)), F.lit(0.0))))


def magnitudes(x: Column, lo: Column, hi: Column) -> Column:
    """Magnitudes of the frequencies lo up to hi (waves in the whole), of x less its mean under a Hann window."""
    hann = lambda x, m, n: F.transform(x, lambda v, i: (v - m) * (0.5 - 0.5 * F.cos(2 * math.pi * i / (n - 1))))
    wave = lambda s, k, f: _total(F.transform(s, lambda v, i: v * f(2 * math.pi * ((k * i) % F.size(s)) / F.size(s))))
    windowed = let(x, lambda x: let(F.struct(_mean(x).alias("m"), F.size(x).alias("n")), lambda q: hann(x, q.m, q.n)))
    return let(windowed, lambda s: F.transform(F.sequence(lo, hi - 1), lambda k: F.hypot(wave(s, k, F.cos), wave(s, k, F.sin))))


def periodicity(x: Column) -> Column:
    """Strength of the strongest period of an array: the largest magnitude from a 120th to a fifth of its length, over their mean; 0 under 32 values."""
    n = F.size(x)
    lo, hi = F.greatest(F.lit(2), F.floor(n / 120).cast("int")), F.greatest(F.lit(3), F.floor(n / 5).cast("int"))
    strength = let(magnitudes(without_trend(x), lo, hi), lambda m: F.array_max(m) / (_mean(m) + 1e-9))
    return F.when(n < 32, 0.0).when(hi <= lo, 0.0).otherwise(strength)


def same_smooth(x: Column, k: Column) -> Column:
    """Sums of k values on each side and the one itself, over 2 k + 1; beyond the ends counts as zero."""
    cut = lambda x, i: F.slice(x, F.greatest(i - k, F.lit(0)) + 1, F.least(i + k + 1, F.size(x)) - F.greatest(i - k, F.lit(0)))
    return let(x, lambda x: F.when(k > 0, F.transform(x, lambda _, i: _total(cut(x, i)) / (2 * k + 1))).otherwise(x))


def column_means(pixels: DataFrame, by: str) -> DataFrame:
    """(by, w, h, lum, green, count, green_rows): means of brightness and of clipped excess green over the valid pixels of each column (0 without any), the number of these, and mean excess green of each row.

    pixels: by, row, col, r, g, b of whole crops; black and white pixels aren't valid.
    """
    lum = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    green = F.greatest(2.0 * F.col("g") - F.col("r") - F.col("b"), F.lit(0.0))
    valid = (lum > DARK) & (F.least("r", "g", "b") < WHITE)
    mean = lambda v: F.coalesce(F.avg(F.when(valid, v)), F.lit(0.0))
    cols = pixels.groupBy(by, "col").agg(mean(lum).alias("lum"), mean(green).alias("green"), F.count(F.when(valid, 1)).alias("count"), F.max("row").alias("last"))
    cols = cols.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("col", "lum", "green", "count"))).alias("c"), (F.max("last") + 1).alias("h"))
    rows = pixels.groupBy(by, "row").agg(F.avg(green).alias("green")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("row", "green"))).alias("g"))
    return cols.join(rows, by).select(by, F.size("c").alias("w"), "h", F.col("c.lum").alias("lum"), F.col("c.green").alias("green"), F.col("c.count").alias("count"), F.col("g.green").alias("green_rows"))


def greedy_rows(x: Column, least: Column, apart: Column) -> Column:
    """Places of rows from the left: at the first value of least the highest within apart, then on from apart beyond it; none nearer to the last than apart."""
    return let(F.struct(x.alias("x"), least.alias("least"), apart.alias("apart")), lambda q: _greedy_rows(q.x, q.least, q.apart))


def _greedy_rows(x: Column, least: Column, apart: Column) -> Column:
    def step(s: Column, i: Column) -> Column:
        ahead = F.slice(x, i + 1, F.least(apart, F.size(x) - i))
        top = i + F.array_position(ahead, F.array_max(ahead)).cast("int") - 1
        far = (F.size(s.found) == 0) | (top - F.element_at(s.found, -1) >= apart)
        hit = F.struct((top + apart).alias("next"), F.when(far, F.concat(s.found, F.array(top))).otherwise(s.found).alias("found"))
        return F.when((i < s.next) | (F.get(x, i) < least), s).otherwise(hit)

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), start, step, lambda s: s.found)


def fitted_rows(crops: DataFrame, by: str, rows: int = 0, mode: str = "width", buffer: float = 0.5) -> DataFrame:
    """(by, spacing, peaks, rows, x0, x1, y0, y1) of crops whose rows stand upright (column_means); no row under two rows.

    The spacing is the strongest period of the brightness less its trend; rows
    are where the smoothed green is high (the brightness where nothing is
    green).  With rows asked for, the adjoining ones nearest the middle.  mode
    width keeps the crop's middle, width_shift moves to the rows, width_length
    also trims the ends along the rows where no green lies.
    """
    if mode not in ("width", "width_shift", "width_length"):
        raise ValueError(f"mode {mode!r}: width, width_shift or width_length")
    w = F.col("w")
    part = lambda n, least: F.greatest(F.lit(least), F.floor(w / n).cast("int"))
    # Columns that are mostly without pixels take the middle brightness.
    c = crops.withColumn("_mid", percentile(F.col("lum"), 0.5)).withColumn("_lum", let(F.col("_mid"), lambda mid: F.zip_with("lum", "count", lambda v, n: F.when(n < LEAST_COLUMN * F.col("h"), mid).otherwise(v))))
    c = c.withColumn("_osc", let(F.col("_lum"), lambda v: F.zip_with(v, same_smooth(v, part(15, 3)), lambda a, b: a - b)))
    lo, hi = part(120, 2), part(5, 3)
    low_cut = part(200, 2)
    c = c.withColumn("_f", F.when(hi > lo, magnitudes(F.col("_osc"), lo, hi)))
    shown = F.transform("_f", lambda m, i: F.when(lo + i < low_cut, 0.0).otherwise(F.round(m, 9)))
    k = lo + F.array_position(shown, F.array_max(shown)).cast("int") - 1
    c = c.withColumn("spacing", F.when(F.col("_f").isNotNull(), w / k).otherwise(w / 8.0))
    c = stored(c, "row-spacings")
    near = F.greatest(F.lit(1), F.floor(F.col("spacing") * SMOOTH).cast("int"))
    c = c.withColumn("_sig", same_smooth(F.col("green"), near))
    c = c.withColumn("_sig", F.when(F.array_max("_sig") < 1e-3, same_smooth(F.transform("_osc", lambda v: F.greatest(v, F.lit(0.0))), near)).otherwise(F.col("_sig")))
    c = c.withColumn("_sign", let(F.array_max("_sig"), lambda top: F.transform("_sig", lambda v: F.round(v / (top + 1e-6), 12))))
    c = stored(c, "row-signals")  # Catalyst would write the steps above into the lambdas below, which run them for each value
    apart = F.greatest(F.lit(2), F.floor(F.col("spacing") * APART).cast("int"))
    c = c.withColumn("peaks", greedy_rows(F.col("_sign"), F.greatest(F.lit(LEAST_HEIGHT), percentile(F.col("_sign"), HEIGHT_PCT)), apart)).where(F.size("peaks") >= 2)
    score = lambda p, s: F.abs((F.get(p, s) + F.get(p, s + rows - 1)) / 2 - w / 2)
    runs = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - rows), lambda s: F.struct(score(p, s).alias("d"), s.alias("s")))
    group = lambda p: F.when((F.lit(rows) > 0) & (F.lit(rows) < F.size(p)), F.slice(p, F.array_min(runs(p))["s"] + 1, max(1, rows))).otherwise(p)
    c = c.withColumn("_g", let(F.col("peaks"), group))
    half = F.col("spacing") * buffer
    a, b = F.greatest(F.lit(0.0), F.get("_g", F.lit(0)) - half), F.least(w.cast("double"), F.element_at("_g", -1) + half)
    centred = mode == "width"
    x0, x1 = (F.greatest(F.lit(0.0), w / 2 - (b - a) / 2), F.least(w.cast("double"), w / 2 + (b - a) / 2)) if centred else (a, b)
    ends = F.lit(None).cast("array<int>")
    if mode == "width_length":
        c = c.withColumn("_ry", same_smooth(F.col("green_rows"), F.greatest(F.lit(2), F.floor(F.col("h") / 60).cast("int"))))
        on = let(percentile(F.col("_ry"), END_PCT), lambda top: F.filter(F.transform("_ry", lambda v, i: F.when(v / (top + 1e-6) > END_SHARE, i)), lambda i: i.isNotNull()))
        ends = F.when(F.size(on) > 0.3 * F.col("h"), on)
    c = c.withColumn("_on", ends)
    whole = lambda v: v.cast("int")
    return c.select(by, "spacing", F.col("_g").alias("peaks"), F.size("_g").alias("rows"), whole(x0).alias("x0"), whole(x1).alias("x1"), F.coalesce(F.array_min("_on"), F.lit(0)).alias("y0"), F.coalesce(F.array_max("_on"), F.col("h").cast("int")).alias("y1"))
