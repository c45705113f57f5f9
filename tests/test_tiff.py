"""Windows of TIFF files: values, and how many bytes are read for them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from fieldloom.sources.tiff import Tiff, TiffSource


def written(path, px, tile=None, rows=16, deflate=False, predictor=1, planar=False, order="<"):
    """A small TIFF of px (h, w, bands); strips of some rows, or square tiles."""
    h, w, n = px.shape
    bits = px.dtype.itemsize * 8
    pw, ph = (tile, tile) if tile else (w, rows)
    chunks = []
    for plane in range(n) if planar else [slice(None)]:
        for y in range(0, h, ph):
            for x in range(0, w, pw):
                part = px[y : y + ph, x : x + pw, plane].reshape(min(ph, h - y), min(pw, w - x), -1)
                if tile:
                    part = np.pad(part, ((0, ph - part.shape[0]), (0, pw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
                chunks.append(zlib.compress(raw) if deflate else raw)
    at, body = 8, b""
    offsets = []
    for c in chunks:
        offsets.append(at + len(body))
        body += c
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [bits] * n), (259, 3, [8 if deflate else 1]), (277, 3, [n]), (284, 3, [2 if planar else 1]), (317, 3, [predictor])]
    tags += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, offsets), (325, 4, [len(c) for c in chunks])] if tile else [(273, 4, offsets), (278, 4, [rows]), (279, 4, [len(c) for c in chunks])]
    extra_at = at + len(body) + 2 + 12 * len(tags) + 4
    ifd, extra = struct.pack(order + "H", len(tags)), b""
    for tag, kind, values in sorted(tags):
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            ifd += struct.pack(order + "HHII", tag, kind, len(values), extra_at + len(extra))
            extra += raw
        else:
            ifd += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    path.write_bytes((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at + len(body)) + body + ifd + struct.pack(order + "I", 0) + extra)
    return path.stat().st_size


@pytest.mark.parametrize("kind,options", [(np.uint8, {}), (np.uint16, {"deflate": True, "predictor": 2}), (np.uint8, {"tile": 32, "deflate": True}), (np.uint16, {"tile": 16, "planar": True, "order": ">"}), (np.uint8, {"planar": True, "rows": 7})])
def test_windows_of_tiffs(spark, tmp_path, kind, options):
    r = np.random.default_rng(1)
    px = r.integers(0, np.iinfo(kind).max, (90, 70, 3)).astype(kind)
    written(tmp_path / "a.tif", px, **options)
    spark.dataSource.register(TiffSource)
    shown = lambda rows: {(x.y0 + k // x.w, x.x0 + k % x.w): tuple(b[k] for b in x.bands) for x in rows for k in range(x.w * x.h)}
    whole = spark.read.format("tiff_blocks").option("partitions", 2).load(str(tmp_path)).collect()
    assert shown(whole) == {(y, x): tuple(map(int, px[y, x])) for y in range(90) for x in range(70)} and {(x.width, x.height, x.bits) for x in whole} == {(70, 90, px.dtype.itemsize * 8)}
    some = spark.read.format("tiff_blocks").option("box", "40,20,50,30").load(str(tmp_path / "a.tif")).collect()
    got = shown(some)
    assert all(got[y, x] == tuple(map(int, px[y, x])) for y in range(20, 30) for x in range(40, 50)) and len(some) < len(whole)
    assert spark.read.format("tiff_blocks").option("box", "70,0,80,9").load(str(tmp_path / "a.tif")).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("tiff_blocks").option("filters", "true").load(str(tmp_path / "a.tif")).where("y0 >= 32 and y0 < 80")
        assert {(x.y0, x.x0) for x in pushed.collect()} == {(x.y0, x.x0) for x in whole if 32 <= x.y0 < 80}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bytes_read_are_bounded_by_the_box(tmp_path):
    px = np.random.default_rng(2).integers(0, 255, (512, 512, 3)).astype(np.uint8)
    size = written(tmp_path / "a.tif", px, tile=64)
    image = Tiff(str(tmp_path / "a.tif"))
    parts = list(image.parts((100, 100, 120, 120)))
    header = image.read
    assert len(parts) == 1 and header < 2000
    image.bands(parts[0])
    assert image.read - header == 64 * 64 * 3 and image.read < size / 40


def test_other_files_are_errors(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"GIF89a, not a TIFF file at all")
    with pytest.raises(ValueError, match="no TIFF"):
        Tiff(str(tmp_path / "x.tif"))
