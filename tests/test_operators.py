"""Operators against hand-made values and independent small implementations."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom import schemas
from fieldloom.functions import geometry as geo
from fieldloom.functions import labels
from fieldloom.functions.crs import utm_forward
from fieldloom.operators import checks, edits, frames, layout, signal
from fieldloom.sources import records, vector
from fieldloom.streaming import landing


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


@pytest.mark.parametrize(
    "points, w, h, want",
    [
        ([(-5, 2), (5, 2), (5, 8), (-5, 8)], 10, 10, 0.5), ([(0, 5), (5, 0), (10, 5), (5, 10)], 10, 5, 0.5), ([(2, 2), (8, 2), (8, 8), (2, 8)], 10, 10, 1.0),
        ([(20, 20), (30, 20), (30, 30), (20, 30)], 10, 10, 0.0), ([(-4, -4), (6, -4), (6, 6), (-4, 6)], 10, 10, 0.36), ([(0, 0), (12, 3), (10, 11), (-2, 8)], 10, 10, 0.813725),
        ([(0, 0), (1, 1)], 10, 10, 0.0),
    ],
)
def test_frame_coverage(spark, points, w, h, want):
    assert value(spark, geo.frame_coverage(ring(*points), F.lit(w), F.lit(h))) == pytest.approx(want, abs=1e-6)


def test_geometry(spark):
    square = ring((0, 0), (2, 0), (2, 1), (0, 1))
    assert value(spark, geo.ring_area(square)) == 2 and value(spark, geo.signed_area(F.reverse(square))) == -2
    assert value(spark, geo.contains(square, F.lit(1.0), F.lit(0.5))) and not value(spark, geo.contains(square, F.lit(3.0), F.lit(0.5)))
    assert value(spark, geo.ring_area(geo.mitre_buffer(square, 0.5))) == pytest.approx(6.0)
    assert value(spark, geo.ring_area(geo.mitre_buffer(F.reverse(square), 0.5))) == pytest.approx(6.0)
    turned = ring(*[(x * math.cos(0.5) - y * math.sin(0.5), x * math.sin(0.5) + y * math.cos(0.5)) for x, y in ((0, 0), (4, 0), (4, 1), (0, 1))])
    f = value(spark, geo.min_area_frame(turned))
    assert sorted([round(f.hl, 6), round(f.hw, 6)]) == [0.5, 2.0]
    assert value(spark, geo.principal_angle(turned)) == pytest.approx(0.5)
    assert value(spark, geo.distance_to_segment(*map(F.lit, (0.0, 1.0, 1.0, 0.0, 3.0, 0.0)))) == pytest.approx(math.sqrt(2))
    p = value(spark, geo.bilinear(square, F.lit(0.5), F.lit(1.0)))
    assert (p.x, p.y) == (1.0, 1.0)
    assert value(spark, geo.ring_area_m2(ring((10, 60), (10.001, 60), (10.001, 60.001), (10, 60.001)))) == pytest.approx(111.32 * 0.5 * 110.54, rel=1e-3)


def test_labels(spark):
    v = lambda c: value(spark, c)
    assert [v(labels.safe_name(F.lit(x))) for x in ("a b/c", "  ", "é-1.x")] == ["a_b_c", "unnamed", "é-1.x"]
    assert v(labels.utm_epsg(F.lit(116.77), F.lit(-31.9))) == 7850 and v(labels.utm_epsg(F.lit(10.0), F.lit(50.0))) == 32632
    assert tuple(v(labels.row_spec(F.lit("5-7;2,1,2")))) == ("list", None, [1, 2, 5, 6, 7]) and tuple(v(labels.row_spec(F.lit("All")))) == ("all", None, None)
    assert tuple(v(labels.row_spec(F.lit("middle 3")))) == ("middle", 3, None)
    with pytest.raises(Exception, match="numbers from 1 on"):
        v(labels.row_spec(F.lit("0,2")))
    assert [v(labels.compress_key(F.lit(x))) for x in ("None", "LZW fast", "zip")] == ["none", "lzw", "deflate"]
    assert v(labels.epsg_of(F.lit("urn:ogc:def:crs:epsg::7850"))) == 7850 and v(labels.epsg_of(F.lit("x"))) is None
    assert v(labels.plot_label(F.lit(1), F.lit(2))) == "Rg2Rw3" and v(labels.plot_number(F.lit(1), F.lit(2))) == 2003
    assert v(labels.stem(F.lit("/a/b.c.tif"))) == "b.c" and v(labels.bits_key(F.lit("12"))) == "same"
    r = spark.range(256).select("id", labels.to_8_bit(labels.to_16_bit(F.col("id"))).alias("back")).collect()
    assert all(x.id == x.back for x in r)


def test_utm_forward(spark):
    p = value(spark, utm_forward(F.lit(15.0), F.lit(0.0), F.lit(33), F.lit(False)))
    assert (p.x, p.y) == (500000.0, 0.0)
    p = value(spark, utm_forward(F.lit(9.0), F.lit(45.0), F.lit(32), F.lit(False)))
    assert p.x == pytest.approx(500000, abs=1e-6) and p.y == pytest.approx(4982950.4, abs=0.1)


def test_layout(spark):
    s = lambda a, b, t, d: value(spark, layout.starts(F.lit(a), F.lit(b), F.lit(t), F.lit(d)))
    assert s(0, 2418, 1024, 768) == [0, 768, 1394] and s(10, 500, 1024, 1024) == [10] and s(0, 2048, 1024, 1024) == [0, 1024]
    assert [r.start for r in layout.row_tiles(spark.createDataFrame([(4350,), (900,)], "span int"), 1000, 1000).orderBy("start").collect()] == [175, 1175, 2175, 3175]
    assert value(spark, F.transform(layout.slot_edges(F.lit(3), 1.0, 0.5), lambda e: F.array(e.lo, e.hi))) == [[0, 0.25], [0.375, 0.625], [0.75, 1]]
    rows = layout.rows_from_count(spark.createDataFrame([(1.12, 5), (1.0, 0)], "width double, n int")).orderBy("v").collect()
    assert [round(r.v, 3) for r in rows] == [-0.448, -0.224, 0, 0.224, 0.448]
    lines = spark.createDataFrame([("a", 0.0, 1), ("a", 1.0, 2), ("a", 5.0, 3), ("a", 9.0, 4), ("b", 2.0, 1), ("b", 3.0, 2)], "p string, v double, o int")
    assert [r.v_even for r in layout.even_spacing(lines, "p", "v", "o").orderBy("p", "v").collect()] == [0, 3, 6, 9, 2, 3]
    picked = layout.spread_pick(spark.range(8).withColumn("g", F.lit(1)), "g", "id", 3)
    assert sorted(r.id for r in picked.collect()) == [0, 4, 7]
    chosen = [sorted(r.id for r in layout.hash_pick(spark.range(50).withColumn("g", F.lit(1)), "g", "id", 5).collect()) for _ in range(2)]
    assert chosen[0] == chosen[1] and len(chosen[0]) == 5


def test_tiles_cover_their_crop(spark):
    t = layout.tile_grid(spark.createDataFrame([(1, 2418, 1500), (2, 600, 3000), (3, 500, 3000)], "id int, w int, h int"), 1024, 768).collect()
    assert not any(r.id == 3 for r in t)  # cut below half a tile
    for crop, w, h in ((1, 2418, 1500), (2, 600, 3000)):
        seen = np.zeros((h, w), bool)
        for r in t:
            if r.id == crop:
                seen[r.y : r.y + r.th, r.x : r.x + r.tw] = True
        assert seen.all()


def test_ranking_does_not_depend_on_input_order(spark, sf):
    from fieldloom.plans import derive

    plots, cams = derive.plots(spark, sf), derive.cameras(spark, sf)
    a = frames.candidates(frames.rank_frames(frames.score(frames.box_join(plots, cams)))).orderBy("plot_id", "rank").collect()
    b = frames.candidates(frames.rank_frames(frames.score(frames.box_join(plots.orderBy(F.desc("plot_id")), cams.repartition(5))))).orderBy("plot_id", "rank").collect()
    assert a == b and all(0 <= r.cover_pct <= 100 for r in a)


def test_demoted_partial_frames_rank_last(spark):
    cols = "plot_id int, camera int, cov double, gsd double, aniso double, clear boolean, dist double, over double"
    df = spark.createDataFrame([(1, 1, 0.9, 500.0, 1.0, False, 0.1, 0.0), (1, 2, 0.4, 1000.0, 1.0, False, 0.1, 0.0)], cols)
    assert [r.camera for r in frames.rank_frames(df).orderBy("rank").collect()] == [2, 1]


def test_set_cover(spark):
    box = lambda c, r, *b: (1, r, c, *map(float, b), 0.0, 0.0, 1.0, 1.0)
    rows = [box(1, 1, -1, -1, 0.55, 2), box(2, 2, -1, -1, 0.7, 0.3), box(3, 3, 0.45, -1, 2, 2), box(4, 4, -1, -1, 0.3, 2)]
    df = spark.createDataFrame(rows, "plot_id long, rank int, camera int, fx0 double, fy0 double, fx1 double, fy1 double, x0 double, y0 double, x1 double, y1 double")
    got = frames.cover_sets(df).first()
    assert got.frames == "1,3" and got.covered == 65


def test_statistics(spark):
    df = spark.createDataFrame([(7, 1), (5, 2), (5, 3), (7, 4)], "v int, o int")
    assert checks.mode_first_seen(df, "v", "o").first().mode == 7 and checks.mode_smallest(df, "v").first().mode == 5
    assert checks.nearest_to_median(spark.createDataFrame([(0.5, 1), (0.6, 2), (0.8, 3)], "v double, o int"), "v", "o").first().chosen == 0.6
    pos = spark.createDataFrame([(1, i, float(p)) for i, p in enumerate([0, 100, 205, 300, 420])], "g int, i int, p double")
    best = checks.block_choice(pos, "g", "i", "p", 3, F.lit(100), F.lit(200)).first()
    assert (best.start, best.score) == (1, 15.0)
    assert value(spark, checks.feasible(F.lit(204.0), F.lit(216.0))) == 3
    gaps = spark.createDataFrame([(i, 10.0 + (i == 3) * 300, 60.0 if i == 5 else 1.0, True) for i in range(25)], "plot_id int, offset double, gap_err double, clean boolean")
    acts = {r.plot_id: r for r in checks.refit(gaps, 216, 0.15).collect()}
    assert acts[3].action == "large_residual" and acts[5].action == "irregular" and acts[0].shift_mm == 10.0


def test_crop_status_ladder(spark):
    m = spark.createDataFrame([("p1", "f1", "mask", 1, "s1"), ("p2", "f2", "rectify", 1, "s1"), ("p3", "f3", "mask", None, "s1"), ("p4", "f4", "mask", 1, "gone"), ("p5", "f5", "mask", 1, "s1")], "plot string, raw_file string, raw_style string, src_x0 int, source_path string")
    files = spark.createDataFrame([("f2",), ("f3",), ("f4",), ("f5",)], "file string")
    got = {r.plot: r.result for r in checks.crop_status(m, files, spark.createDataFrame([("s1",)], "path string")).collect()}
    assert got == {"p1": "MISSING", "p2": "RESAMPLED", "p3": "NO SOURCE BOX", "p4": "NO SOURCE", "p5": "COMPARE"}


def test_pixels(spark):
    px = spark.createDataFrame([(1, r, c, 10 * r + c + 1) for r in range(3) for c in range(3)], "id int, row int, col int, value int")
    turned = px
    for _ in range(4):
        turned = checks.quarter_turn(turned, 3)
    assert sorted(map(tuple, turned.collect())) == sorted(map(tuple, px.collect()))
    tiles = spark.createDataFrame([(1, 0, 0, 5, 1), (1, 0, 0, 6, 2), (1, 0, 1, 7, 1)], "id int, row int, col int, value int, o int")
    assert {(r.col, r.value) for r in checks.stitch(tiles, "id", "row", "col", "value", "o").collect()} == {(0, 6), (1, 7)}
    fit = checks.affine_fit(spark.createDataFrame([("a", float(c), float(r), 2.0 * c + r, 3.0 * r - c) for c, r in ((0, 0), (4, 1), (2, 7))] + [("b", 0.0, 0.0, 0.0, 0.0)], "g string, col double, row double, x double, y double"), "g")
    got = {r.g: r for r in fit.collect()}
    assert got["a"].a == pytest.approx(2) and got["a"].f == pytest.approx(0) and got["b"].a is None


def test_signals(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([3, 6, 9, 12])], "g int, i int, v double")
    assert [r.smooth for r in signal.moving_sum_share(df, "g", "i", "v", 3).orderBy("i").collect()] == [3, 6, 9, 7]
    wave = spark.createDataFrame([(1, i, math.sin(2 * math.pi * i / 8)) for i in range(64)], "g int, i int, v double")
    assert signal.strongest_period(wave, "g", "i", "v", [6.0, 7.0, 8.0, 9.0]).first().period == 8.0
    comb = spark.createDataFrame([(1, i, float(i % 6 == 2)) for i in range(60)], "g int, i int, v double")
    assert signal.comb_fit(comb, "g", "i", "v", 6).first().phase == 2
    two = spark.createDataFrame([(1, float(v)) for v in [0, 1, 0, 1, 9, 10, 10, 9]], "g int, v double")
    assert 1 < signal.otsu(two, "g", "v", 10).first().threshold < 9
    peaks = lambda x, d, p: sorted(r.i for r in signal.peaks_of(spark.createDataFrame([(1, i, float(a)) for i, a in enumerate(x)], "g int, i int, v double"), "g", "i", "v", d, p).collect())
    assert peaks([0, 5, 0, 4, 0, 0, 0, 3, 0.0], 3, 1.0) == [1, 7] and peaks([0, 5, 4.9, 6, 0], 1, 1.0) == [3]


def test_first_and_last_wins(spark):
    index = spark.createDataFrame([("k", "first", 1), ("k", "second", 2)], "key string, path string, ord int")
    keys = spark.createDataFrame([(1, "none", 1), (1, "k", 2), (2, "x", 1)], "id int, key string, prio int")
    assert {r.id: r.path for r in frames.by_priority(keys, index).collect()} == {1: "first", 2: None}


def test_edits(spark):
    plots = spark.createDataFrame([(1,), (2,)], "plot_id int").withColumn("ring", ring((0, 0), (1, 0), (1, 4), (0, 4)))
    one, nobody = spark.createDataFrame([(1,)], "plot_id int"), spark.createDataFrame([], "plot_id int")
    moved = {r.plot_id: r.ring[0].x for r in edits.move(plots, 2.0, 0.0, one).collect()}
    assert moved == {1: 2.0, 2: 0.0} and all(r.ring[0].x == 2.0 for r in edits.move(plots, 2.0, 0.0, nobody).collect())
    areas = [r[0] for r in edits.resize(plots, 1.0, -5.0).select(geo.ring_area("ring")).collect()]
    assert areas == pytest.approx([5 * 0.02] * 2)
    rows = spark.createDataFrame([(1, 0.0, 2.0, "count", 1)], "plot_id int, v double, angle double, source string, ord int")
    assert edits.carry_rows(rows, rows.withColumn("v", F.lit(9.0))).first().v == 9.0
    assert edits.carry_rows(rows.withColumn("source", F.lit("edit")), rows.withColumn("v", F.lit(9.0))).first().v == 0.0


def test_recipe_and_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "section string, body string")
    assert sorted(map(tuple, checks.upsert_sections(old, spark.createDataFrame([("b", "3")], "section string, body string")).collect())) == [("a", "1"), ("b", "3")]
    before = spark.createDataFrame([("x", 1, 1), ("y", 1, None), ("z", 1, 1)], "path string, length int, modified int")
    after = spark.createDataFrame([("x", 1, 1), ("y", 1, None)], "path string, length int, modified int")
    assert [tuple(r) for r in checks.changed_files(before, after).collect()] == [("z", True)]
    assert value(spark, records.recipe_section(F.lit('{"t":{"gui":{"k":1}}}'), "t")) == {"k": "1"} and value(spark, records.recipe_section(F.lit("junk"), "t")) == {}


def test_geojson(spark, tmp_path):
    square, hole = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]], [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 0.5]]
    big = [[0, 0], [9, 0], [9, 9], [0, 0]]
    import json

    features = [
        {"type": "Feature", "properties": {"Plot_ID": 7, "n": None}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}},
        {"type": "Feature", "properties": None, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [big]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::7850"}}, "features": features}))
    got = vector.read_geojson(spark, str(tmp_path / "g.json")).orderBy("ord").collect()
    assert [(r.plot_id, len(r.ring), r.epsg) for r in got] == [("7", 4, 7850), ("2", 3, 7850)] and got[1].ring[1].x == 9
    assert vector.pick_id_field(["x", "ID", "PlotID"]) == "PlotID"


def test_shapefile(spark, tmp_path):
    rings = [[(0.0, 0.0), (0.0, 2.0), (3.0, 2.0)], [(5.0, 5.0), (5.0, 6.0), (6.0, 6.0), (6.0, 5.0)]]
    (tmp_path / "g.shp").write_bytes(vector.shp_bytes(rings))
    (tmp_path / "g.dbf").write_bytes(vector.dbf_bytes([{"Plot": "a é", "k": "1"}, {"Plot": "b", "k": ""}]))
    got = vector.read_shapefile(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.plot_id, [(p.x, p.y) for p in r.ring]) for r in got] == [("a é", rings[0]), ("b", rings[1])] and got[0].props["k"] == "1"


def test_tables_and_files(spark, tmp_path):
    path = str(tmp_path / "t")
    assert records.read_table(spark, path, schemas.QA_FLAGS).count() == 0
    records.write_table(spark.createDataFrame([("p", 1)], "plot string, extra int"), path, schemas.QA_FLAGS)
    assert [tuple(r) for r in records.read_table(spark, path, schemas.QA_FLAGS).collect()] == [("p", None)]
    pics = tmp_path / "pics"
    pics.mkdir()
    (pics / "A.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 30, 20, 8, 2, 0, 0, 0))
    tags = [(256, 4, 1, 640), (257, 4, 1, 480), (258, 3, 1, 16)]
    (pics / "b.tif").write_bytes(b"II*\0" + struct.pack("<IH", 8, 3) + b"".join(struct.pack("<HHII", *t) for t in tags))
    sizes = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.bits) for r in records.image_sizes(spark, str(pics)).collect()}
    assert sizes == {"A.png": (30, 20, 8), "b.tif": (640, 480, 16)}
    keys = {r.key for r in records.photo_index(records.list_files(spark, str(pics))).collect()}
    assert keys == {"a", "a.png", "b", "b.tif"}


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in/e"))
    q = landing.tumbling_counts(landing.read_stream(spark, str(tmp_path / "in/e"), schema)).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = landing.tumbling_counts(spark.read.parquet(f"{sf}/events.parquet"))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, want.collect()))
    jobs = spark.createDataFrame([("a",), ("b",)], "stem string")
    files = spark.createDataFrame([("a", "/x/a.tif")], "stem string, path string")
    assert {r.stem: r.result for r in landing.classified(jobs, files).collect()} == {"a": "LANDED", "b": "MISSING"}


def test_least_rectangle_computes_each_side_once(spark, sf):
    from fieldloom.functions import geometry as geo
    from fieldloom.plans import catalog

    # Once to leave out sides without a length, once for the direction.
    assert str(geo.min_area_frame(F.col("ring"))).lower().count("hypot") == 2
    assert catalog.QUERIES["plot_frame_minrect"](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
