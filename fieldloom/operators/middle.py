"""Tiles on a plot's middle rows and images of whole rows, along bands that follow the rows' tilt; and control points of a part of a crop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.geometry import let
from fieldloom.operators import layout

LEAST_SIDE, LEAST_STRIP, SHORT_SPAN, SINGULAR = 8, 4, 0.6, 1e-12


def middle_band(rows: Column, pitch: Column, n: int, span_centre: Column) -> Column:
    """Struct lo, hi, first: the band of the n middle ones of a plot's rows (their places, in order), half a pitch beyond both; null where there are fewer.

    The block whose middle is nearest the middle of all rows (to a
    thousandth), then nearest the data's middle, then the first.
    """
    middle = lambda a, b: (a + b) / 2
    at = lambda k: F.get(rows, k)
    centre = middle(at(F.lit(0)), F.element_at(rows, -1))
    block = lambda k: let(middle(at(k), at(k + n - 1)), lambda c: F.struct(F.round(F.abs(c - centre), 3).alias("a"), F.round(F.abs(c - span_centre), 9).alias("b"), k.alias("k")))
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.size(rows) - n), block))["k"]
    return F.when((F.size(rows) >= n) & F.lit(n > 0), let(best, lambda k: F.struct((at(k) - pitch / 2).alias("lo"), (at(k + n - 1) + pitch / 2).alias("hi"), k.alias("first"))))


def middle_row_tiles(plots: DataFrame, n_middle: int, placing: str, tile_px: int = 0, across_px: int = 0, overlap: int = 0) -> DataFrame:
    """plots with reason and one row for each tile: tile_k, x, y, w, h; a plot without tiles has one row with a reason.

    plots: plot, w, h, across_axis (0: rows run along x), rows (places of its
    rows), pitch, angle_deg, along_centre, span_centre, u0 and u1 (the usable
    length).  placing is band (squares as wide as the band, end to end and
    centred; one where 0.6 of it fits), strict (tiles of tile_px along and
    across_px across, centred; none where the plot is smaller) or flush (the
    same, not larger than the plot, from end to end with the last at the end).
    Tiles lie across on the band's middle, which the tilt moves along the plot.
    """
    if placing not in ("band", "strict", "flush"):
        raise ValueError(f"placing {placing!r}: band, strict or flush")
    band, strict = placing == "band", placing == "strict"
    long = F.when(F.col("across_axis") == 0, F.col("w")).otherwise(F.col("h"))
    wide = F.when(F.col("across_axis") == 0, F.col("h")).otherwise(F.col("w"))
    whole = lambda v: F.bround(v).cast("int")
    p = plots.withColumns({"_band": middle_band(F.col("rows"), F.col("pitch"), n_middle, F.col("span_centre")), "_long": long.cast("int"), "_wide": wide.cast("int")})
    side = whole(F.col("_band.hi") - F.col("_band.lo")) if band else F.lit(int(tile_px))
    across = side if band else F.lit(int(across_px or tile_px))
    p = p.withColumns({"_side": side, "_across": across})
    if not strict:
        fits = lambda v: F.greatest(F.lit(LEAST_SIDE), F.least(v, F.col("_wide")))
        p = p.withColumns({"_side": fits(side), "_across": fits(across) if across_px and not band else fits(side)})
    stride = F.col("_side") if band else F.greatest(F.lit(1), F.col("_side") - max(0, overlap))
    p = p.withColumns({"_stride": stride, "_span": F.col("u1") - F.col("u0")})
    large = (F.col("_across") > F.col("_wide")) | (F.col("_side") > F.col("_long")) if strict else F.lit(False)
    if band:
        n = F.floor(F.col("_span") / F.col("_side")).cast("int")
        n = F.when((n <= 0) & (F.col("_span") >= SHORT_SPAN * F.col("_side")), 1).otherwise(n)
    else:
        n = F.when(F.col("_span") >= F.col("_side"), F.floor((F.col("_span") - F.col("_side")) / F.col("_stride")).cast("int") + 1).otherwise(0)
    p = p.withColumn("_n", n)
    first = F.col("u0") + (F.col("_span") - (F.col("_side") + (F.col("_n") - 1) * F.col("_stride"))) / 2
    none = F.array().cast("array<int>")
    even = F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: whole(first + i * F.col("_stride")))).otherwise(none)
    placed = even if placing != "flush" else F.when(F.col("_span") >= F.col("_side"), layout.starts(whole(F.col("u0")), whole(F.col("u1")), F.col("_side"), F.col("_stride"))).otherwise(none)
    p = p.withColumn("_at", F.when(F.col("_band").isNull() | large, none).otherwise(placed))
    few = F.format_string(f"only %d row(s) found, {n_middle} middle rows asked", F.size("rows"))
    reason = F.when(F.col("_band").isNull(), few).when(large, "the plot is smaller than one tile").when(F.size("_at") == 0, "usable length shorter than one tile").otherwise("")
    p = p.withColumn("reason", reason).select("*", F.posexplode_outer("_at").alias("tile_k", "_l"))
    start = F.greatest(F.lit(0), F.least(F.col("_l"), F.col("_long") - F.col("_side")))
    centre = (F.col("_band.lo") + F.col("_band.hi")) / 2 + F.tan(F.radians("angle_deg")) * (start + F.col("_side") / 2 - F.col("along_centre"))
    p = p.withColumns({"_l": start, "_a": F.greatest(F.lit(0), F.least(whole(F.round(centre - F.col("_across") / 2, 9)), F.col("_wide") - F.col("_across")))})
    along, there = F.col("across_axis") == 0, F.col("tile_k").isNotNull()
    pick = lambda a, b: F.when(there, F.when(along, a).otherwise(b))
    side, across = F.col("_side"), F.col("_across")
    return p.select("plot", "reason", "tile_k", pick(F.col("_l"), F.col("_a")).alias("x"), pick(F.col("_a"), F.col("_l")).alias("y"), pick(side, across).alias("w"), pick(across, side).alias("h"))


def row_boxes(rows: DataFrame) -> DataFrame:
    """rows with a0 and a1, the cells across that a row's band touches along the whole plot; rows with under four cells go.

    rows: plot, k, centre, pitch, angle_deg, along_centre, across_axis, w, h.
    """
    long = F.when(F.col("across_axis") == 0, F.col("w")).otherwise(F.col("h"))
    wide = F.when(F.col("across_axis") == 0, F.col("h")).otherwise(F.col("w"))
    t = F.tan(F.radians("angle_deg"))
    off = lambda along: t * (along - F.col("along_centre"))
    ends = [off(F.lit(0)), off(long - 1)]
    out = rows.withColumns({"slope": t, "a0": F.greatest(F.lit(0), F.floor(F.col("centre") - F.col("pitch") / 2 + F.least(*ends)).cast("int")), "a1": F.least(wide.cast("int"), F.ceil(F.col("centre") + F.col("pitch") / 2 + F.greatest(*ends)).cast("int"))})
    return out.where(F.col("a1") - F.col("a0") >= LEAST_STRIP)


def row_strips(pixels: DataFrame, rows: DataFrame, values: list[str]) -> DataFrame:
    """plot, k, row, col and values of the image of each row: the cells of its box, those outside its band as 0; nothing is resampled.

    pixels: plot, row, col and values; rows as for row_boxes.
    """
    box = row_boxes(rows).select("plot", "k", "centre", "pitch", "slope", "along_centre", "across_axis", "a0", "a1")
    upright = F.col("across_axis") == 0
    across, along = F.when(upright, F.col("row")).otherwise(F.col("col")), F.when(upright, F.col("col")).otherwise(F.col("row"))
    met = pixels.join(box, "plot").where((across >= F.col("a0")) & (across < F.col("a1")))
    lo = F.col("centre") - F.col("pitch") / 2 + F.col("slope") * (along - F.col("along_centre"))
    inside = (across >= lo) & (across < lo + F.col("pitch"))
    return met.select("plot", "k", F.when(upright, F.col("row") - F.col("a0")).otherwise(F.col("row")).alias("row"), F.when(upright, F.col("col")).otherwise(F.col("col") - F.col("a0")).alias("col"), *[F.when(inside, F.col(v)).otherwise(0).alias(v) for v in values])


def solved(matrix: Column, n: int) -> Column:
    """Right-hand sides of a linear system (n rows of n coefficients and the sides) after elimination with row pivots; null where it is singular."""

    def step(m: Column, i: Column) -> Column:
        pivot = F.array_max(F.transform(F.sequence(i, F.lit(n - 1)), lambda r: F.struct(F.abs(F.get(F.get(m, r), i)).alias("v"), (-r).alias("r"))))

        def swept(p: Column) -> Column:
            head = let(F.get(m, -p.r), lambda row: F.transform(row, lambda v: v / F.get(row, i)))
            rest = lambda row, r: F.when(r == -p.r, F.get(m, i)).otherwise(row)
            return let(head, lambda h: F.transform(m, lambda row, r: F.when(r == i, h).otherwise(let(rest(row, r), lambda q: F.zip_with(q, h, lambda a, b: a - F.get(q, i) * b)))))

        return let(pivot, lambda p: F.when(p.v >= SINGULAR, swept(p)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, step, lambda m: F.transform(m, lambda row: F.slice(row, n + 1, 100)))


def points_of_box(points: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Control points (structs row, col, x, y, z) of the part x0, y0 to x1, y1 of a crop: its corners, by the bilinear surface that fits points best.

    With under four points they are moved into the part; null where they fix
    no such surface (all on a line).
    """
    return let(points, lambda p: _points_of_box(p, x0, y0, x1, y1))


def _points_of_box(points: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """points_of_box of points that are bound, so that each is computed once."""
    terms = F.transform(points, lambda p: F.array(F.lit(1.0), p.row, p.col, p.row * p.col, p.x, p.y, p.z))
    sums = lambda rows, i: F.aggregate(rows, F.array_repeat(F.lit(0.0), 7), lambda a, t: F.zip_with(a, t, lambda s, v: s + v * F.get(t, F.lit(i))))
    surface = solved(let(terms, lambda rows: F.array(*[sums(rows, i) for i in range(4)])), 4)

    def corner(c: Column, row: Column, col: Column) -> Column:
        at = lambda k: sum((F.get(F.get(c, F.lit(i)), F.lit(k)) * v for i, v in enumerate((F.lit(1.0), row, col, row * col))), F.lit(0.0))
        return F.struct((row - y0).cast("double").alias("row"), (col - x0).cast("double").alias("col"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))

    moved = F.transform(points, lambda p: F.struct((p.row - y0).cast("double").alias("row"), (p.col - x0).cast("double").alias("col"), p.x.alias("x"), p.y.alias("y"), p.z.alias("z")))
    fitted = let(surface, lambda c: F.when(c.isNotNull(), F.array(*[corner(c, r.cast("double"), q.cast("double")) for r in (y0, y1) for q in (x0, x1)])))
    return F.when(F.size(points) < 4, moved).otherwise(fitted)
