"""Edits of plots and rows as column updates: a new table each time, the old one stays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.geometry import centroid, let, principal_angle, radial_push

# The least side that a resize leaves, in metres, and the least scale.
LEAST_SIDE, LEAST_SCALE = 0.02, 0.05


def selected(plots: DataFrame, ids: DataFrame | None) -> DataFrame:
    """plots with _sel; no selection, or an empty one, means all."""
    if ids is None:
        return plots.withColumn("_sel", F.lit(True))
    one = ids.select("plot_id").distinct().withColumn("_hit", F.lit(True))
    some = ids.agg((F.count("*") > 0).alias("_some"))
    return plots.join(one, "plot_id", "left").join(F.broadcast(some)).withColumn("_sel", F.coalesce("_hit", ~F.col("_some"))).drop("_hit", "_some")  # _some is one row


def _update(plots: DataFrame, ids: DataFrame | None, new) -> DataFrame:
    return selected(plots, ids).withColumn("ring", F.when(F.col("_sel"), new(F.col("ring"))).otherwise(F.col("ring"))).drop("_sel")


def push(plots: DataFrame, metres: float, ids: DataFrame | None = None) -> DataFrame:
    return _update(plots, ids, lambda r: radial_push(r, metres))


def move(plots: DataFrame, dx: float, dy: float, ids: DataFrame | None = None) -> DataFrame:
    return _update(plots, ids, lambda r: F.transform(r, lambda p: F.struct((p.x + dx).alias("x"), (p.y + dy).alias("y"))))


def scale(plots: DataFrame, factor: float, ids: DataFrame | None = None) -> DataFrame:
    """Each ring about its own centroid."""
    k = max(LEAST_SCALE, factor)
    def about(r):
        c = centroid(r)
        return F.transform(r, lambda p: F.struct((c.x + (p.x - c.x) * k).alias("x"), (c.y + (p.y - c.y) * k).alias("y")))
    return _update(plots, ids, lambda ring: let(ring, about))


def _along(ring: Column, body) -> Column:
    return let(F.struct(ring.alias("r"), centroid(ring).alias("c"), principal_angle(ring).alias("t")), lambda s: body(s.r, s.c, F.cos(s.t), F.sin(s.t)))


def shift_along(plots: DataFrame, metres: float, across: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """Moved along the main axis (or across it), whose direction points to larger x, then larger y."""
    def go(r, c, ux, uy):
        ax, ay = (-uy, ux) if across else (ux, uy)
        sign = F.when((ax < -1e-12) | ((F.abs(ax) <= 1e-12) & (ay < 0)), -1.0).otherwise(1.0)
        return F.transform(r, lambda p: F.struct((p.x + sign * ax * metres).alias("x"), (p.y + sign * ay * metres).alias("y")))
    return _update(plots, ids, lambda ring: _along(ring, go))


def resize(plots: DataFrame, d_length: float = 0.0, d_width: float = 0.0, ids: DataFrame | None = None) -> DataFrame:
    """Longer and wider by so many metres along the main axis and across; a side never falls under LEAST_SIDE."""
    def grown(r, c, ux, uy):
        u = lambda p: (p.x - c.x) * ux + (p.y - c.y) * uy
        v = lambda p: -(p.x - c.x) * uy + (p.y - c.y) * ux
        side = lambda f: F.array_max(F.transform(r, f)) - F.array_min(F.transform(r, f))
        ratio = lambda n, d: F.coalesce(F.greatest(F.lit(LEAST_SIDE), n + d) / F.nullif(n, F.lit(0.0)), F.lit(1.0))
        return let(F.struct(ratio(side(u), d_length).alias("k"), ratio(side(v), d_width).alias("m")), lambda s: F.transform(r, lambda p: F.struct((c.x + u(p) * s.k * ux - v(p) * s.m * uy).alias("x"), (c.y + u(p) * s.k * uy + v(p) * s.m * ux).alias("y"))))
    return _update(plots, ids, lambda ring: _along(ring, grown))


def add_row(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows (plot_id, v, angle, source, ord) with new ones (plot_id, v), tilted as the median of their plot's rows."""
    tilt = rows.groupBy("plot_id").agg(F.median("angle").alias("angle"), F.max("ord").alias("last"))
    n = F.row_number().over(Window.partitionBy("plot_id").orderBy("v"))
    made = new.join(tilt, "plot_id", "left").select("plot_id", "v", F.coalesce("angle", F.lit(0.0)).alias("angle"), F.lit("edit").alias("source"), (F.coalesce("last", F.lit(0)) + n).alias("ord"))
    return rows.select("plot_id", "v", "angle", "source", "ord").unionByName(made)


def rows_moved(rows: DataFrame, chosen: DataFrame, dv: float) -> DataFrame:
    """rows (plot_id, row_idx, v, angle, source) with the chosen ones (plot_id, row_idx) moved or nudged across by dv, as edited; all are numbered anew across their plot."""
    marked = rows.join(chosen.select("plot_id", "row_idx", F.lit(True).alias("_on")).distinct(), ["plot_id", "row_idx"], "left")
    moved = marked.withColumns({"v": F.when(F.col("_on"), F.round(F.col("v") + dv, 4)).otherwise(F.col("v")), "source": F.when(F.col("_on"), "edit").otherwise(F.col("source"))}).drop("_on")
    return _numbered(moved)


def rows_deleted(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """rows without the chosen ones (plot_id, row_idx), numbered anew across their plot."""
    return _numbered(rows.join(chosen, ["plot_id", "row_idx"], "left_anti"))


def _numbered(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("plot_id").orderBy("v", "row_idx")
    return rows.withColumn("row_idx", F.row_number().over(order))


def carry_rows(rows: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Rows for an edited grid: where all of a grid's rows came from a count they are made anew, else all are kept."""
    only = rows.agg(F.coalesce(F.bool_and(F.col("source") == "count"), F.lit(True)).alias("_only"))
    kept = rows.join(F.broadcast(only)).where(~F.col("_only")).drop("_only")  # _only is one row
    made = regenerated.join(F.broadcast(only)).where("_only").drop("_only")
    return kept.unionByName(made, allowMissingColumns=True)


def line_of(cx: Column, cy: Column, ux: Column, uy: Column, v: Column, half: Column, angle: Column) -> Column:
    """End points of a crop row v off the middle of a plot whose long axis is (ux, uy), tilted by angle degrees."""
    t = F.tan(angle * (math.pi / 180))
    end = lambda s: F.struct((cx + s * half * ux - (v + s * half * t) * uy).alias("x"), (cy + s * half * uy + (v + s * half * t) * ux).alias("y"))
    return F.array(end(-1), end(1))
