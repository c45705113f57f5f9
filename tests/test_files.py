"""Files that are written: what is read back, what an aborted job leaves, and what broken rows do; projects and headers."""

from __future__ import annotations

import datetime
import math
import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import georef, ortho, placing
from fieldloom.plans import catalog
from fieldloom.sources import geotiff, records, shapefiles, vector
from fieldloom.sources.tiff import Tiff

RING = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]


@pytest.fixture
def sink(spark):
    spark.dataSource.register(shapefiles.ShapefileSink)
    spark.dataSource.register(geotiff.GeoTiffSink)
    return spark


def test_fields_of_shapefiles(sink, tmp_path):
    kind = "ring array<struct<x:double,y:double>>, plot_id string, a_long_name int, a_long_name_too double, ok boolean, day date"
    rows = [(RING, "é1", 7, 0.1, True, datetime.date(2024, 2, 3)), (None, None, None, None, None, None), (RING[:2], "two", -3, math.inf, False, None), (RING[::-1], "p4", 0, -1.7976931348623157e308, None, None)]
    sink.createDataFrame(rows, kind).coalesce(1).write.format("shapefiles").option("epsg", 32756).mode("append").save(str(tmp_path / "out"))
    got = {r.ord: r for r in vector.read_shapefile(sink, str(tmp_path / "out")).collect()}
    assert sorted(got) == [0, 3] and {r.epsg for r in got.values()} == {32756}
    assert [(p.x, p.y) for p in got[0].ring] == RING[::-1] and vector.pick_id_field(["PLOT_ID"]) == "PLOT_ID"
    assert got[0].props == {"plot_id": "é1", "a_long_nam": "7", "a_long_n_1": "0.1", "ok": "T", "day": "20240203"}
    assert float(got[3].props["a_long_n_1"]) == -1.7976931348623157e308 and got[3].props["ok"] == ""
    assert sorted(n.rsplit(".", 1)[1] for n in os.listdir(tmp_path / "out") if not n.startswith((".", "_"))) == ["cpg", "dbf", "prj", "shp", "shx"]
    shp = next((tmp_path / "out").glob("*.shp")).read_bytes()
    assert struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) and struct.unpack("<4d", shp[36:68]) == (0.0, 0.0, 4.0, 3.0)


def test_files_are_cut_and_never_replaced(sink, tmp_path):
    rows = sink.range(25).select(F.col("id").alias("plot"), F.expr("array(named_struct('x', id * 1.0D, 'y', 0D), named_struct('x', id + 1D, 'y', 0D), named_struct('x', id + 1D, 'y', 1D))").alias("ring")).coalesce(2)
    save = lambda mode: rows.write.format("shapefiles").option("rows", 4).mode(mode).save(str(tmp_path / "o"))
    count = lambda: vector.read_shapefile(sink, str(tmp_path / "o")).select("plot_id").distinct().count(), len(list((tmp_path / "o").glob("*.shp")))
    save("append")
    many = len(list((tmp_path / "o").glob("*.shp")))
    assert many >= 7 and vector.read_shapefile(sink, str(tmp_path / "o")).count() == 25
    save("append")
    assert vector.read_shapefile(sink, str(tmp_path / "o")).count() == 50
    save("overwrite")
    assert len(list((tmp_path / "o").glob("*.shp"))) == many and not (tmp_path / "o" / "_temporary").exists()


def test_a_failed_job_leaves_no_file(sink, tmp_path):
    bad = sink.range(40).select(F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 1D, 'y', 1D))").alias("ring"), F.when(F.col("id") == 39, F.repeat(F.lit("x"), 255)).otherwise("x").alias("plot")).repartition(4)
    with pytest.raises(Exception, match="254 bytes"):
        bad.write.format("shapefiles").option("rows", 2).mode("append").save(str(tmp_path / "o"))
    assert not list(tmp_path.rglob("*.shp"))
    with pytest.raises(Exception, match="ring"):
        sink.range(1).write.format("shapefiles").mode("append").save(str(tmp_path / "o"))


def test_systems(spark):
    for epsg in (4326, 7844, 32631, 32701, 32660, 7850):
        assert spark.range(1).select(shapefiles.epsg_of_prj(F.lit(shapefiles.prj_text(epsg)))).first()[0] == epsg
    other = 'PROJCS["OSGB36",GEOGCS["x",AUTHORITY["EPSG","4277"]],AUTHORITY["EPSG","27700"]]'
    assert spark.range(1).select(shapefiles.epsg_of_prj(F.lit(other)), shapefiles.epsg_of_prj(F.lit("LOCAL"))).first()[:] == (27700, None)
    with pytest.raises(ValueError):
        shapefiles.prj_text(27700)


def _image(spark, name, px, bits):
    h, w, n = px.shape
    rows = [(name, y, x, *map(int, px[y, x])) for y in range(h) for x in range(w)]
    bands = [f"b{k}" for k in range(n)]
    df = spark.createDataFrame(rows, "name string, row int, col int, " + ", ".join(f"{b} int" for b in bands))
    return geotiff.strips_of(df, "name", bands, 5).select("name", "y0", F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(bits).alias("bits"), "bands")


@pytest.mark.parametrize("compression", ["deflate", "none"])
@pytest.mark.parametrize("bits,bands", [(8, 3), (16, 1), (16, 4)])
def test_geotiffs_read_back(sink, tmp_path, compression, bits, bands):
    px = np.random.default_rng(bits + bands).integers(0, 1 << bits, (17, 9, bands))
    gcps = [(0.0, 1.0, 500.25, 4e6, 0.0), (3.5, 2.0, -7.5, 1e-9, 4.0)]
    strips = _image(sink, "a", px, bits).withColumn("gcps", F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("row", "col", "x", "y", "z"), p, strict=True)]) for p in gcps])).withColumns({"epsg": F.lit(4326), "projected": F.lit(False), "tags": F.create_map(F.lit("k"), F.lit("<&é>"))})
    geotiff.write_geotiffs(strips, str(tmp_path / "o"), compression)
    image = Tiff(str(tmp_path / "o" / "a.tif"))
    for part in image.parts((0, 0, 100, 100)):
        for k, band in enumerate(image.bands(part)):
            assert (band.reshape(part.h, part.w) == px[part.y0 : part.y0 + part.h, :, k]).all()
    got = geotiff.read_places(sink, str(tmp_path / "o")).first()
    assert (got.name, got.width, got.height, got.bits, got.epsg, got.transform, got.tags) == ("a", 9, 17, bits, 4326, None, {"k": "<&é>"})
    assert [tuple(p) for p in got.gcps] == gcps
    with pytest.raises(Exception, match="already"):
        geotiff.write_geotiffs(strips, str(tmp_path / "o"), compression)
    assert len(list((tmp_path / "o").glob("*.tif"))) == 1


def test_broken_strips_are_errors(sink, tmp_path):
    strips = _image(sink, "a", np.zeros((17, 4, 3), int), 8)
    for bad, said in ((strips.where("y0 <> 5"), "should be at 5"), (strips.where("y0 < 15"), "15 of 17 rows"), (strips.union(strips), "should be at"), (strips.withColumn("bands", F.transform("bands", lambda b: F.transform(b, lambda v: v + 256))), "8 bits")):
        with pytest.raises(Exception, match=said):
            geotiff.write_geotiffs(bad, str(tmp_path / "o"))
    assert not list(tmp_path.rglob("*.tif"))
    geotiff.write_geotiffs(strips.where("false"), str(tmp_path / "o"))
    assert not list(tmp_path.rglob("*.tif"))


def test_north_up_and_turned_transforms(sink, tmp_path):
    one = _image(sink, "n", np.zeros((5, 4, 1), int), 8)
    for name, t in (("n", [0.5, 0.0, 100.0, 0.0, -0.25, 200.0]), ("t", [0.5, 0.1, 100.0, -0.1, 0.5, 200.0])):
        geotiff.write_geotiffs(one.withColumns({"name": F.lit(name), "transform": F.array(*map(F.lit, t)), "epsg": F.lit(32631), "projected": F.lit(True)}), str(tmp_path / "o"))
        got = geotiff.read_places(sink, str(tmp_path / "o")).where(F.col("name") == name).first()
        assert (got.transform, got.epsg, got.gcps) == (t, 32631, None)


def test_headers_without_pixels(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x03x\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 300, 401) + b"\x01\x01\x11\x00\xff\xda"
    (tmp_path / "a.jpg").write_bytes(jpeg)
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8nonsense..")
    (tmp_path / "c.tif").write_bytes(b"II*\0\x08\0\0\0")
    (tmp_path / "d.txt").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.bits) for r in records.image_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": (401, 300, 8), "b.jpg": (None,) * 3, "c.tif": (None,) * 3, "d.txt": (None,) * 3}


def test_projects(spark, tmp_path):
    def put(path, doc):
        path.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("doc.xml", doc)

    put(tmp_path / "p.files" / "project.zip", '<d><chunks active_id="2"><chunk id="0" path="0/chunk.zip"/><chunk id="2" path="2/chunk.zip"/><chunk id="5" path="5/chunk.zip"/></chunks></d>')
    put(tmp_path / "p.files" / "0" / "chunk.zip", '<chunk label=""/>')
    put(tmp_path / "p.files" / "2" / "chunk.zip", '<chunk label="Süd 2"/>')
    (tmp_path / "p.files" / "5").mkdir()
    (tmp_path / "p.files" / "5" / "chunk.zip").write_bytes(b"broken")
    (tmp_path / "q.files").mkdir()
    (tmp_path / "q.files" / "project.zip").write_bytes(b"broken")
    got = records.read_projects(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.project.rsplit("/", 1)[1], r.chunk_id, r.label, r.active) for r in got] == [("p", 0, "chunk 0", False), ("p", 2, "Süd 2", True), ("p", 5, "chunk 5", False)]


def test_undo_depth(spark):
    r = np.random.default_rng(3)
    log = [(g, k, "set" if r.random() < 0.6 else "undo", f"{g}-{k}") for g in range(6) for k in range(150)]
    for depth in (1, 3, 40):
        want = {}
        for g in range(6):
            now, past = None, []
            for _, _, kind, value in log[150 * g : 150 * g + 150]:
                if kind == "set":
                    past = [*past, now][-depth:]
                    now = value
                elif past:
                    now = past.pop()
            want[g] = now
        got = placing.last_state(spark.createDataFrame(log, "g int, k int, kind string, value string"), "g", "k", depth).collect()
        assert {x.g: x.value for x in got} == want


def test_footprint_guards(spark):
    base = dict(camera=1, x=10.0, y=50.0, z=30.0, rotation=[1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0], f=1000.0, sw=1000, sh=800, cx=0.0, cy=0.0, k1=-3.0, k2=0.0, out_w=500, out_h=400, ground_z=0.0, geographic=False)
    kind = "camera int, x double, y double, z double, rotation array<double>, f double, sw int, sh int, cx double, cy double, k1 double, k2 double, out_w int, out_h int, ground_z double, geographic boolean"
    frame = lambda **k: spark.createDataFrame([tuple({**base, **k}.values())], kind)
    near = georef.frame_footprints(frame()).collect()
    # Distortion folds far points back into the picture; none of those is taken.
    assert near and all(abs(p.x - 10) <= 1.05 * 15 and abs(p.y - 50) <= 1.05 * 12 for p in near)
    assert not georef.frame_footprints(frame(ground_z=60.0)).collect()
    wide = georef.frame_footprints(frame(geographic=True, k1=0.0)).collect()
    flat = georef.frame_footprints(frame(k1=0.0)).collect()
    assert sorted((round(p.row, 6), round(p.col, 6)) for p in wide) == sorted((round(p.row, 6), round(p.col, 6)) for p in flat)
    high = spark.createDataFrame([(10, 50, math.nan), (10, 49, None), (9, 50, 3.0)], "gx long, gy long, height double")
    assert {p.z for p in georef.frame_footprints(frame(), high, 1.0).collect()} <= {0.0, 3.0}


def test_ortho_blocks_of_one_band(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 2, [[240, 5, 0, 30]])], "k int, x0 int, y0 int, w int, bands array<array<int>>")
    got = ortho.blackened_blocks(blocks, 1).first()
    assert (got.bands, got.n_cells, got.n_valid, got.n_black) == ([[0, 5, 0, 30]], 4, 2, 3)
    ring = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 2.0), (0.0, 2.0)])], "k int, ring array<struct<x:double,y:double>>")
    got = ortho.masked_blocks(blocks, ring, "k", 1).first()
    assert (got.bands, got.n_inside, got.n_valid) == ([[240, 0, 0, 0]], 2, 1)


@pytest.mark.parametrize("n", [23, 37])
def test_mosaics_with_gaps(spark, tmp_path, sf, n):
    import duckdb

    from fieldloom.plans import files

    # The last mosaic lacks vectors, so that its last row of patches isn't full.
    spark.read.parquet(f"{sf}/embeddings.parquet").where(F.col("vec_id") < n).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = files.geotiffs_of_mosaics(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(catalog.ORACLES["geotiffs_of_mosaics"]).fetchall()
    assert len(want) == n * 64 and sorted(map(tuple, got)) == sorted(want)


def test_shapefiles_are_read_in_pieces(sink, tmp_path):
    rows = sink.range(25).select(F.col("id").alias("plot"), F.expr("array(named_struct('x', id * 1.0D, 'y', 0D), named_struct('x', id + 1D, 'y', 0D), named_struct('x', id + 1D, 'y', 1D))").alias("ring")).coalesce(1)
    rows.write.format("shapefiles").mode("append").save(str(tmp_path / "o"))
    pieces = list(vector.shapefile_pieces(str(next((tmp_path / "o").glob("*.shp"))), 10))
    assert [len(p) for p in pieces] == [10, 10, 5] and [r[1] for p in pieces for r in p] == [str(i) for i in range(25)]
