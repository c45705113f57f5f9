"""Sizes of plots by their three definitions, and choices, limits and orders of plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.geometry import let

#: Kilometres from the project beyond which a grid is suspect, and kilometres in a degree.
FAR_KM, KM_LON, KM_LAT = 10.0, 111.32, 110.54


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _apart(ring: Column, a: int, b: int) -> Column:
    p, q = F.get(ring, F.lit(a)), F.get(ring, F.lit(b))
    return F.hypot(q.x - p.x, q.y - p.y)


def size_by_axes(ring: Column) -> Column:
    """Struct width, length: extents along the minor and major axis of a ring's corners (the axis of their largest spread)."""
    middle = F.struct((_total(F.transform(ring, lambda p: p.x)) / F.size(ring)).alias("x"), (_total(F.transform(ring, lambda p: p.y)) / F.size(ring)).alias("y"))

    def along(c: Column) -> Column:
        s = lambda f: _total(F.transform(ring, lambda p: f(p.x - c.x, p.y - c.y)))
        turn = 0.5 * F.atan2(2 * s(lambda x, y: x * y), s(lambda x, y: x * x) - s(lambda x, y: y * y))
        extent = lambda ux, uy: let(F.transform(ring, lambda p: (p.x - c.x) * ux + (p.y - c.y) * uy), lambda v: F.array_max(v) - F.array_min(v))
        return let(turn, lambda t: F.struct(extent(-F.sin(t), F.cos(t)).alias("width"), extent(F.cos(t), F.sin(t)).alias("length")))

    return let(middle, along)


def size_by_edges(ring: Column) -> Column:
    """Struct width, length: means of opposite edges, the first and third for the width; 0 under four corners."""
    pair = lambda a, b, c, d: F.when(F.size(ring) < 4, 0.0).otherwise((_apart(ring, a, b) + _apart(ring, c, d)) / 2)
    return F.struct(pair(0, 1, 3, 2).alias("width"), pair(0, 3, 1, 2).alias("length"))


def size_from_short_edge(ring: Column) -> Column:
    """Struct first, width, length: the corner from which the shorter pair of edges leaves, and the two edges at it."""
    sides = [_apart(ring, k, (k + 1) % 4) for k in range(4)]
    first = F.when(F.round(sides[0] + sides[2], 9) <= F.round(sides[1] + sides[3], 9), 0).otherwise(1)
    pick = lambda a, b: F.when(first == 0, a).otherwise(b)
    return F.struct(first.alias("first"), pick(sides[0], sides[1]).alias("width"), pick(sides[3], sides[0]).alias("length"))


def inside_band(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the mean of a ring's corners lies in the box between two corners, in any order; the edge counts."""
    mean = lambda k: _total(F.transform(ring, lambda p: p[k])) / F.size(ring)
    return mean("x").between(F.least(x0, x1), F.greatest(x0, x1)) & mean("y").between(F.least(y0, y1), F.greatest(y0, y1))


def crop_note(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.when((x1 <= x0) | (y1 <= y0), "degenerate crop").otherwise("")


def far_from_project(lon: Column, lat: Column, project_lon: Column, project_lat: Column) -> Column:
    """Struct km, far: distance of a place from the project's, and whether it is so large that the reference system may be wrong."""
    km = F.hypot((lon - project_lon) * KM_LON * F.cos(F.radians(project_lat)), (lat - project_lat) * KM_LAT)
    return F.struct(km.alias("km"), (km > FAR_KM).alias("far"))


def first_plots(plots: DataFrame, ord_: str, limit: int) -> DataFrame:
    """The first plots of a file's order; all where limit is 0."""
    return plots.orderBy(ord_).limit(limit) if limit > 0 else plots


def in_name_order(df: DataFrame, name: str) -> DataFrame:
    """Shorter names first, equal lengths by their letters."""
    return df.orderBy(F.length(name), name)


def retagged(points: DataFrame, target: int, known: list[int]) -> DataFrame:
    """(status, n): what re-expressing each file's control points in another system does: converted, already there, skipped (no points or no system) or failed (a system that isn't known).

    points: n_points and epsg of each file.
    """
    status = F.when((F.col("n_points") == 0) | F.col("epsg").isNull(), "skipped").when(F.col("epsg") == target, "already").when(F.col("epsg").isin(known), "converted").otherwise("failed")
    return points.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
