"""Crops as GeoTIFF files: a sink that takes strips of rows, and the places that such files name.

    write_geotiffs(strips_of(pixels, "name", ["r", "g", "b"]).join(places, "name"), folder)
    read_places(spark, folder)
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter

from fieldloom.sources import tiff
from fieldloom.sources.records import list_files
from fieldloom.sources.staged import StagedWriter, Written

# Numbers of the tags that place an image, and of their keys.
SCALE, TIE, MATRIX, KEYS, METADATA, PHOTOMETRIC, EXTRA = 33550, 33922, 34264, 34735, 42112, 262, 338
MODEL_KEY, RASTER_KEY, GEOGRAPHIC_KEY, PROJECTED_KEY = 1024, 1025, 2048, 3072
LARGEST = (1 << 32) - 1
POINTS = "array<struct<row:double,col:double,x:double,y:double,z:double>>"


def strips_of(pixels: DataFrame, by: str, bands: list[str], rows: int = 64) -> DataFrame:
    """(by, y0, bands): strips of whole image rows of pixels (by, row, col and bands), each band an array row by row.

    A group is one strip, so no row holds a whole image.
    """
    at = F.floor(F.col("row") / rows).cast("long") * rows
    strip = pixels.groupBy(by, at.alias("y0")).agg(F.sort_array(F.collect_list(F.struct("row", "col", *bands))).alias("_px"))
    band = lambda b: F.transform("_px", lambda p: p[b].cast("int"))
    return strip.select(by, "y0", F.array(*map(band, bands)).alias("bands"))


def filled(pixels: DataFrame, sizes: DataFrame, by: str, bands: list[str]) -> DataFrame:
    """The pixels (by, row, col, bands, alpha) of whole images of sizes (by, width, height, bits): those that are missing are 0 in all bands.

    alpha is the bits' largest value where a pixel is there, and 0 where it is missing.
    """
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    full = sizes.select(by, "width", F.expr("shiftleft(1, bits)").alias("_levels"), upto("height").alias("row")).select(by, "_levels", "row", upto("width").alias("col"))
    met = full.join(pixels.withColumn("_there", F.lit(True)), [by, "row", "col"], "left")
    return met.select(by, "row", "col", *[F.coalesce(b, F.lit(0)).alias(b) for b in bands], F.when(F.col("_there"), F.col("_levels") - 1).otherwise(0).alias("alpha"))


def write_geotiffs(strips: DataFrame, path: str, compression: str = "deflate", mode: str = "append") -> None:
    """strips (name, y0, width, height, bits, bands; and transform, epsg, projected, gcps, tags where they are known) as one file for each name.

    An image's strips meet in one task, in order; what a task holds is one
    image's compressed strips.
    """
    strips.sparkSession.dataSource.register(GeoTiffSink)
    placed = strips.repartition("name").sortWithinPartitions("name", "y0")
    placed.write.format("geotiffs").option("compression", compression).mode(mode).save(path)


def _entries(row: T.Row, n_bands: int, bits: int, rows: int, counts: list[int], compression: int) -> dict[int, tuple[int, list]]:
    """Tags of an image as (type, values); the strips' places are filled in later."""
    said = lambda k: row[k] if k in row else None
    tags = {
        tiff.WIDTH: (4, [row["width"]]), tiff.HEIGHT: (4, [row["height"]]), tiff.BITS: (3, [bits] * n_bands), tiff.COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if n_bands in (3, 4) else 1]),
        tiff.STRIP_AT: (4, [0] * len(counts)), tiff.SAMPLES: (3, [n_bands]), tiff.STRIP_ROWS: (4, [rows]), tiff.STRIP_BYTES: (4, counts), tiff.PLANAR: (3, [1]), tiff.PREDICTOR: (3, [1 if compression == tiff.NONE else 2]),
    }
    if n_bands == 4:
        tags[EXTRA] = (3, [2])  # the fourth band is alpha, which changes no other
    if said("transform"):
        a, b, c, d, e, f = said("transform")
        if b == 0 and d == 0 and a > 0 > e:
            tags |= {SCALE: (12, [a, -e, 0.0]), TIE: (12, [0.0, 0.0, 0.0, c, f, 0.0])}
        else:
            tags[MATRIX] = (12, [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])
    elif said("gcps"):
        tags[TIE] = (12, [v for p in said("gcps") for v in (p["col"], p["row"], 0.0, p["x"], p["y"], p["z"] or 0.0)])
    if said("epsg") is not None and (TIE in tags or MATRIX in tags):
        model, key = (1, PROJECTED_KEY) if said("projected") else (2, GEOGRAPHIC_KEY)
        tags[KEYS] = (3, [1, 1, 0, 3, MODEL_KEY, 0, 1, model, RASTER_KEY, 0, 1, 1, key, 0, 1, said("epsg")])
    if said("tags"):
        items = "".join(f"<Item name={quoteattr(k)}>{escape(v)}</Item>" for k, v in sorted(said("tags").items()) if v is not None)
        tags[METADATA] = (2, [f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0"])
    return tags


def tiff_parts(row: T.Row, n_bands: int, bits: int, rows: int, strips: list[bytes], compression: int) -> list[bytes]:
    """A file of compressed strips, its directory last."""
    tags = _entries(row, n_bands, bits, rows, [len(s) for s in strips], compression)
    starts = list(np.cumsum([8, *(len(s) for s in strips)]).tolist())
    tags[tiff.STRIP_AT] = (4, starts[:-1])
    at = starts[-1] + starts[-1] % 2
    codes = {2: "s", 3: "H", 4: "I", 12: "d"}
    directory, extra, extra_at = struct.pack("<H", len(tags)), b"", at + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in sorted(tags.items()):
        raw = values[0] if kind == 2 else struct.pack(f"<{len(values)}{codes[kind]}", *values)
        directory += struct.pack("<HHI", tag, kind, len(raw) if kind == 2 else len(values))
        if len(raw) > 4:
            directory += struct.pack("<I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            directory += raw.ljust(4, b"\0")
    if extra_at + len(extra) > LARGEST:
        raise ValueError(f"{row['name']}: a file of over 4 GB needs the large form, which isn't written")
    return [struct.pack("<2sHI", b"II", 42, at), *strips, b"\0" * (starts[-1] % 2), directory + struct.pack("<I", 0) + extra]


class GeoTiffWriter(StagedWriter):
    endings = (".tif", ".tiff")

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        super().__init__(options["path"], overwrite)
        lacking = [c for c in ("name", "y0", "width", "height", "bits", "bands") if c not in schema.names]
        if lacking:
            raise ValueError(f"a GeoTIFF's strips need columns {lacking}")
        label = options.get("compression", "deflate")
        if label not in ("deflate", "none"):
            raise ValueError(f"compression {label}: deflate or none")
        self.compression = tiff.NONE if label == "none" else tiff.DEFLATE[0]

    def write(self, iterator: Iterator[T.Row]) -> Written:
        system, made, _ = self.attempt()
        first, strips, next_row, rows = None, [], 0, 0

        def finish() -> None:
            if first is not None:
                if next_row != first["height"]:
                    raise ValueError(f"{first['name']}: {next_row} of {first['height']} rows are there")
                self.put(system, made, f"{first['name']}.tif", tiff_parts(first, len(first["bands"]), first["bits"], rows, strips, self.compression))

        for row in iterator:
            if first is None or row["name"] != first["name"]:
                finish()
                first, strips, next_row, rows = row, [], 0, len(row["bands"][0]) // row["width"]
            raw, n = self._strip(row, first)
            if row["y0"] != next_row or (n != rows and next_row + n != first["height"]):
                raise ValueError(f"{first['name']}: the strip at row {row['y0']} should be at {next_row} and have {rows} rows")
            next_row += n
            strips.append(raw)
        finish()
        return made

    def _strip(self, row: T.Row, first: T.Row) -> tuple[bytes, int]:
        """A strip's bytes, and its rows."""
        if row["bits"] not in (8, 16):
            raise ValueError(f"{row['name']}: 8 or 16 bits")
        bands = [np.asarray(b, np.int64) for b in row["bands"]]
        if len(bands) != len(first["bands"]) or any(len(b) != len(bands[0]) or len(b) % row["width"] for b in bands):
            raise ValueError(f"{row['name']}: the strip at row {row['y0']} isn't whole")
        px = np.stack(bands, 1).reshape(-1, row["width"], len(bands))
        if px.size and not 0 <= px.min() <= px.max() < 1 << row["bits"]:
            raise ValueError(f"{row['name']}: values of {row['bits']} bits")
        px = px.astype(f"<u{row['bits'] // 8}")
        if self.compression == tiff.NONE:
            return px.tobytes(), len(px)
        return zlib.compress(np.diff(px, axis=1, prepend=np.zeros_like(px[:, :1])).tobytes()), len(px)


class GeoTiffSink(DataSource):
    """One TIFF file for each name, from strips of rows that come in order within their task (see write_geotiffs).

    Option compression: deflate (with differences along rows) or none.  A
    transform is written as such, control points only where there is none; a
    name's first strip says where it lies.  Missing, repeated or broken strips,
    and values beyond the bits, are errors.  Pixels are unchanged.  Three bands
    are red, green and blue, a fourth after them is alpha (see filled).
    """

    @classmethod
    def name(cls) -> str:
        return "geotiffs"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return GeoTiffWriter(self.options, schema, overwrite)


def place_of(image: tiff.Tiff) -> tuple[list[float] | None, int | None, list[tuple] | None, dict[str, str]]:
    """(transform, epsg, control points as row, col, x, y, z, tags) of an open file."""
    got = lambda k: image._all(k) if k in image.tags else None
    transform, points, tie, keys, matrix, scale = None, None, got(TIE), got(KEYS), got(MATRIX), got(SCALE)
    if matrix:
        transform = [matrix[k] for k in (0, 1, 3, 4, 5, 7)]
    elif scale and tie:
        transform = [scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1]]
    elif tie:
        points = [(tie[k + 1], tie[k], tie[k + 3], tie[k + 4], tie[k + 5]) for k in range(0, len(tie), 6)]
    known = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4)} if keys else {}
    text = got(METADATA)
    items = ET.fromstring(text[0].rstrip(b"\0").decode()).iter("Item") if text else []
    return transform, known.get(PROJECTED_KEY, known.get(GEOGRAPHIC_KEY)), points, {i.get("name"): i.text or "" for i in items}


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """path, name (without its ending), width, height, bits, transform, epsg, gcps, tags of the TIFF files under path; of each file only its directory is read."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                image = tiff.Tiff(p, pixels=False)
                transform, epsg, points, tags = place_of(image)
                gcps = None if points is None else [dict(zip(("row", "col", "x", "y", "z"), q, strict=True)) for q in points]
                out.append((p, p.rsplit("/", 1)[1].rsplit(".", 1)[0], image.width, image.height, image.bits, transform, epsg, gcps, tags))
            got = pd.DataFrame(out, columns=["path", "name", "width", "height", "bits", "transform", "epsg", "gcps", "tags"])
            yield got.assign(epsg=got["epsg"].astype("Int32"))

    files = list_files(spark, path).where(F.col("name").rlike(r"\.tiff?$")).select("path")
    return files.mapInPandas(rows, f"path string, name string, width int, height int, bits int, transform array<double>, epsg int, gcps {POINTS}, tags map<string,string>")
