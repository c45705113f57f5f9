"""Sizes, edits of rows, and shifts of patches on small tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import checks, edits, shift, sizes


def test_sizes_of_a_turned_rectangle(spark):
    t = 0.6
    corner = lambda u, v: (10 + math.cos(t) * u - math.sin(t) * v, 5 + math.sin(t) * u + math.cos(t) * v)
    ring = [corner(-1, -3), corner(1, -3), corner(1, 3), corner(-1, 3)]
    df = spark.createDataFrame([(1, ring), (2, ring[1:] + ring[:1]), (3, ring[:3])], "k int, ring array<struct<x:double,y:double>>")
    r = F.col("ring")
    got = {x.k: x for x in df.select("k", sizes.size_by_axes(r).alias("a"), sizes.size_by_edges(r).alias("e"), sizes.size_from_short_edge(r).alias("s")).collect()}
    assert tuple(got[1].a) == pytest.approx((2, 6)) and tuple(got[1].e) == pytest.approx((2, 6)) and tuple(got[1].s) == pytest.approx((0, 2, 6))
    assert tuple(got[2].a) == pytest.approx((2, 6)) and tuple(got[2].e) == pytest.approx((6, 2)) and tuple(got[2].s) == pytest.approx((1, 2, 6)) and tuple(got[3].e) == (0, 0)


def test_orders_and_limits(spark):
    df = spark.createDataFrame([("10", 3), ("9", 1), ("b", 2)], "name string, ord int")
    assert [r.name for r in sizes.in_name_order(df, "name").collect()] == ["9", "b", "10"]
    assert {r.name for r in sizes.first_plots(df, "ord", 2).collect()} == {"9", "b"} and sizes.first_plots(df, "ord", 0).count() == 3


def test_rows_are_moved_and_deleted(spark):
    rows = spark.createDataFrame([(1, 1, -0.5, 0.0, "count"), (1, 2, 0.0, 0.0, "count"), (1, 3, 0.5, 0.0, "count"), (2, 1, 0.0, 0.0, "detect")], "plot_id int, row_idx int, v double, angle double, source string")
    chosen = spark.createDataFrame([(1, 1), (1, 1)], "plot_id int, row_idx int")
    assert sorted((r.plot_id, r.row_idx, r.v, r.source) for r in edits.rows_moved(rows, chosen, 0.7).collect()) == [(1, 1, 0.0, "count"), (1, 2, 0.2, "edit"), (1, 3, 0.5, "count"), (2, 1, 0.0, "detect")]
    assert sorted((r.plot_id, r.row_idx, r.v) for r in edits.rows_deleted(rows, chosen).collect()) == [(1, 1, 0.0), (1, 2, 0.5), (2, 1, 0.0)]


def test_tilted_line_of_a_row(spark):
    line = spark.range(1).select(edits.line_of(F.lit(10.0), F.lit(5.0), F.lit(0.0), F.lit(1.0), F.lit(0.5), F.lit(2.0), F.lit(45.0)).alias("l")).first().l
    assert [tuple(p) for p in line] == [pytest.approx((11.5, 3.0)), pytest.approx((7.5, 7.0))]


def test_residuals(spark):
    r = np.random.default_rng(1)
    pts = [(1, float(c), float(w), float(3 * c - w + e), float(c + 2 * w - f)) for (c, w), (e, f) in zip(r.uniform(0, 50, (12, 2)), r.normal(size=(12, 2)), strict=True)] + [(2, float(i), 2.0 * i, 1.0, 1.0) for i in range(5)]
    got = {x.g: x for x in checks.affine_residuals(spark.createDataFrame(pts, "g int, col double, row double, x double, y double"), "g").collect()}
    p = np.array([q[1:] for q in pts if q[0] == 1])
    a = np.column_stack([p[:, :2], np.ones(12)])
    off = np.hypot(*(a @ np.linalg.lstsq(a, p[:, 2:], rcond=None)[0] - p[:, 2:]).T)
    assert got[1].mean_off == pytest.approx(off.mean()) and got[1].max_off == pytest.approx(off.max()) and got[2].mean_off is None


@pytest.mark.parametrize("dy,dx", [(0.0, 0.0), (3.0, -5.0), (-7.0, 2.0), (1.5, -2.5), (4.25, 0.75)])
def test_planted_shifts(dy, dx):
    noise = np.fft.fft2(np.random.default_rng(3).normal(size=(64, 64)))
    fy, fx = np.fft.fftfreq(64)[:, None], np.fft.fftfreq(64)[None, :]
    moved = np.fft.ifft2(noise * np.exp(-2j * np.pi * (fy * dy + fx * dx))).real
    got = shift.phase_shift(moved, np.fft.ifft2(noise).real)
    assert got[:2] == pytest.approx((dy, dx), abs=0.26 if dy % 1 else 1e-6) and 0 < got[2] <= 1.01
