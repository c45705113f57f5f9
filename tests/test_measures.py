"""Row combs, pixel checks and places against hand-made values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import comb, pixelcheck, placing


def signal_rows(spark, sigs, pitch):
    return spark.createDataFrame([(i, [float(x) for x in s], 0.0, 1.0, 0.0, float(len(s) - 1), pitch) for i, s in enumerate(sigs)], "id int, sig array<double>, first double, step double, lo double, hi double, pitch double")


def test_comb_finds_planted_rows(spark):
    x = np.arange(64)
    got = comb.comb_rows(signal_rows(spark, [np.cos(2 * np.pi * (x - 5) / 8), np.zeros(64)], 8.0), "id", 1.0).collect()
    rows = sorted((r.pos, r.present) for r in got if r.id == 0)
    assert [p for p, _ in rows] == [5 + 8 * i for i in range(len(rows))] and all(p for _, p in rows)
    assert all(not r.present for r in got if r.id == 1)
    assert [r.k for r in got if r.id == 1] == list(range(1, 1 + sum(r.id == 1 for r in got)))


def test_comb_of_nothing(spark):
    assert comb.comb_rows(signal_rows(spark, [np.ones(4)], 0.0), "id", 1.0).count() == 0
    assert comb.comb_rows(signal_rows(spark, [np.ones(4)], 8.0).limit(0), "id", 1.0).count() == 0


def test_greener(spark):
    a = spark.createDataFrame([(1, True, 0.1, 0.01), (2, True, 0.1, 0.2), (3, False, None, 0.0), (4, True, 0.3, 0.0), (5, True, 0.1, None)], "id int, ok boolean, green_contrast double, threshold double")
    b = spark.createDataFrame([(1, True, 0.2), (2, True, 0.9), (3, True, 0.05), (4, True, 0.2), (5, True, 0.9)], "id int, ok boolean, green_contrast double")
    got = {r.id: (r.branch, r.green_contrast) for r in comb.greener(a, b, "id").collect()}
    assert got == {1: ("green floor", 0.2), 2: ("threshold", 0.1), 3: ("green floor", 0.05), 4: ("threshold", 0.3), 5: ("threshold", 0.1)}


def test_crop_results_ladder(spark):
    cols = "id int, raw_file string, raw_style string, source_path string, src_x0 int, src_y0 int, src_x1 int, src_y1 int, bits int, developed boolean, neutral boolean"
    box = (0, 0, 1, 1)
    m = spark.createDataFrame([
        (1, "none", "bbox", "s", *box, 8, False, False), (2, "f", "rectify", "s", *box, 8, False, False), (3, "f", "bbox", "s", None, 0, 1, 1, 8, False, False), (4, "f", "bbox", "gone", *box, 8, False, False),
        (5, "f", "bbox", "s", *box, 8, False, False), (6, "f", "bbox", "s", *box, 8, True, False), (7, "f", "bbox", "s", *box, 8, True, True), (8, "f", "bbox", "s", *box, 16, True, False),
        (9, "f", "bbox", "s", *box, 8, False, False), (10, None, "bbox", None, *box, 8, False, False), (11, "f", "bbox", "s", *box, 8, False, False),
    ], cols)
    px = spark.createDataFrame([(5, 7, 7), (5, 0, 9), (6, 7, 9), (7, 7, 9), (8, 700, 1214), (9, 7, 9), (11, 7, None)], "id int, a int, b int")
    found = pixelcheck.crop_results(m, spark.createDataFrame([("f",)], "file string"), spark.createDataFrame([("s",)], "path string"), pixelcheck.pixel_counts(px, "id", "a", "b"), "id")
    want = ["MISSING", "RESAMPLED", "NO SOURCE BOX", "NO SOURCE", "IDENTICAL", "MATCH", "FAIL", "MATCH", "FAIL", "MISSING", "FAIL"]
    assert [r.result for r in found.orderBy("id").collect()] == want


def test_tile_without_pixels_is_an_error(spark):
    t = spark.createDataFrame([(1, 1, 0, 0, 2, 1, 2, 1, 8, 16), (2, 1, 0, 0, 2, 1, 3, 1, 8, 16), (3, 1, 0, 0, 2, 1, 2, 1, 8, 16), (4, 1, 0, 0, 2, 1, 2, 1, 8, 16)], "id int, source_id int, x0 int, y0 int, w int, h int, out_w int, out_h int, bits int, src_bits int")
    src = spark.createDataFrame([(1, 0, 0, 257), (1, 0, 1, 514)], "source_id int, row int, col int, value int")
    px = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 2), (4, 0, 0, 1)], "id int, row int, col int, value int")
    got = {r.id: r.pixels for r in pixelcheck.tile_results(t, px, src, "id").collect()}
    assert got == {1: "EXACT CONVERSION", 2: "RESAMPLED", 3: "ERROR", 4: "FAIL"}


def test_transforms_agree_with_points(spark):
    lit = lambda **k: F.struct(*[F.lit(float(v)).alias(n) for n, v in k.items()])
    t = lit(a=0.5, b=0.1, c=10, d=-0.2, e=-0.5, f=20)
    w = placing.tile_transform(t, F.lit(3.0), F.lit(4.0), F.lit(2.0), F.lit(1.5))
    turned = placing.turned_transform(w, F.lit(8.0))
    r = spark.range(1).select(placing.at(w, F.lit(1.0), F.lit(2.0)).alias("p"), placing.at(t, F.lit(5.0), F.lit(7.0)).alias("q"), placing.at(turned, F.lit(2.0), F.lit(7.0)).alias("s")).first()
    assert tuple(r.p) == pytest.approx(tuple(r.q)) and tuple(r.s) == pytest.approx(tuple(r.p))


def test_edge_scales_of_a_point(spark):
    q = F.array(*[F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))] * 4)
    assert tuple(spark.range(1).select(placing.edge_scales(q, q).alias("e")).first().e) == (99.0, 0.0)


def test_last_state(spark):
    log = [(1, 1, "set", "a"), (1, 2, "set", "b"), (1, 3, "undo", None), (2, 1, "undo", None), (2, 2, "set", "c"), (3, 1, "set", "d"), (3, 2, "reset", None), (4, 1, "set", "e"), (4, 2, "reset", None), (4, 3, "set", "f")]
    got = {r.id: r.value for r in placing.last_state(spark.createDataFrame(log, "id int, at int, kind string, value string"), "id", "at").collect()}
    assert got == {1: "a", 2: "c", 3: None, 4: "f"}


def test_options():
    assert placing.CropOptions(raw_values=True).check().bits == 16
    for wrong in (placing.CropOptions(extension=".jpg", bits=16), placing.CropOptions(style="rectify", raw_values=True), placing.CropOptions(bits=12), placing.TileOptions(overlap=1024)):
        with pytest.raises(ValueError):
            wrong.check()
