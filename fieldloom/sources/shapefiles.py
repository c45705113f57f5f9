"""Shapefiles as a sink for plots and crop rows, and crop rows read from them.

    spark.dataSource.register(ShapefileSink)
    plots.write.format("shapefiles").option("epsg", 32631).mode("append").save(folder)
"""

from __future__ import annotations

import datetime
import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter

from fieldloom.sources.records import list_files
from fieldloom.sources.staged import StagedWriter, Written, content_of
from fieldloom.sources.vector import PIECE_ROWS, RING, dbf_records

# Numbers of the format, and the text of reference systems.
NULL_SHAPE, LINE, POLYGON, LINES = 0, 3, 5, (3, 13, 23)
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
GDA2020 = 'GEOGCS["GDA2020",DATUM["GDA2020",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
MERCATOR = 'PROJCS["{name}",{base},PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",{north}],PARAMETER["Central_Meridian",{meridian}],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
#: Rows and bytes of points after which a task begins another file.
FILE_ROWS, FILE_BYTES = 100_000, 64 << 20
MAX_TEXT, MAX_NAME = 254, 10


def prj_text(epsg: int) -> str:
    """Text of a reference system: degrees (4326, 7844), UTM zones (326xx, 327xx) and the Australian grid (7846 to 7859); an error for others."""
    zone = epsg % 100
    if epsg in (4326, 7844):
        return WGS84 if epsg == 4326 else GDA2020
    if epsg // 100 in (326, 327) and 1 <= zone <= 60:
        south = epsg // 100 == 327
        return MERCATOR.format(name=f"WGS_1984_UTM_Zone_{zone}{'S' if south else 'N'}", base=WGS84, north=10000000.0 if south else 0.0, meridian=zone * 6.0 - 183)
    if 7846 <= epsg <= 7859:
        return MERCATOR.format(name=f"GDA2020_MGA_Zone_{zone}", base=GDA2020, north=10000000.0, meridian=zone * 6.0 - 183)
    raise ValueError(f"no text is known for EPSG:{epsg}; give it as option prj")


def epsg_of_prj(text: Column) -> Column:
    """The code of a reference system's text: by its name, or by the authority named last; null for others."""
    part = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    utm = r'^\s*PROJCS\["WGS[ _](?:19)?84[ _/]+UTM[ _]Zone[ _](\d+)([NS])"'
    zone = part("(?i)" + utm, 1).cast("int") + F.when(F.upper(part("(?i)" + utm, 2)) == "S", 32700).otherwise(32600)
    grid = part(r'(?i)^\s*PROJCS\["GDA2020[ _/]+MGA[ _]Zone[ _](\d+)"', 1).cast("int") + 7800
    degrees = F.when(text.rlike(r'^\s*GEOGCS\["(GCS_WGS_1984|WGS 84)"'), 4326).when(text.rlike(r'^\s*GEOGCS\["GDA2020"'), 7844)
    named = part(r'(?s).*AUTHORITY\["EPSG","?(\d+)"?\]', 1).cast("int")
    return F.coalesce(zone, grid, degrees, named)


def _names(fields: list[str]) -> list[str]:
    """Field names of at most ten bytes, each once."""
    out: list[str] = []
    for f in fields:
        name, k = f.encode()[:MAX_NAME].decode("utf-8", "ignore"), 0
        while name.lower() in (o.lower() for o in out):
            k += 1
            name = f.encode()[: MAX_NAME - 1 - len(str(k))].decode("utf-8", "ignore") + f"_{k}"
        out.append(name)
    return out


def _text(value, field: T.StructField) -> bytes:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return b""
    if isinstance(value, bool):
        return b"T" if value else b"F"
    if isinstance(value, datetime.date) and isinstance(field.dataType, T.DateType):
        return value.strftime("%Y%m%d").encode()
    text = repr(value).encode() if isinstance(value, float) else str(value).encode()
    if len(text) > MAX_TEXT:
        raise ValueError(f"column {field.name}: a field of a shapefile holds {MAX_TEXT} bytes, a value has {len(text)}")
    return text


def dbf_parts(fields: list[T.StructField], rows: list[list[bytes]]) -> list[bytes]:
    """A .dbf file of encoded values; texts are as wide as the longest."""
    kinds = [{T.BooleanType: b"L", T.DateType: b"D", T.DoubleType: b"F", T.FloatType: b"F"}.get(type(f.dataType), b"N" if isinstance(f.dataType, T.IntegralType) else b"C") for f in fields]
    widths = [8 if k == b"D" else max([1, *(len(r[i]) for r in rows)]) for i, k in enumerate(kinds)]
    head = b"".join(n.encode().ljust(11, b"\0") + k + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in zip(_names([f.name for f in fields]), kinds, widths, strict=True))
    start = struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(rows), 32 + len(head) + 1, 1 + sum(widths))
    pad = lambda v, k, w: v.rjust(w) if k in b"NF" else v.ljust(w)
    body = [b" " + b"".join(pad(v, k, w) for v, k, w in zip(r, kinds, widths, strict=True)) for r in rows]
    return [start + head + b"\x0d", *body, b"\x1a"]


def shp_parts(shapes: list[bytes], kind: int, box: list[float]) -> tuple[list[bytes], list[bytes]]:
    """The .shp and .shx files of encoded shapes."""
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii4d4d", 1000, kind, *box, 0, 0, 0, 0)
    index, records, at = [], [], 100
    for i, s in enumerate(shapes):
        index.append(struct.pack(">ii", at // 2, len(s) // 2))
        records += [struct.pack(">ii", i + 1, len(s) // 2), s]
        at += 8 + len(s)
    return [head(at), *records], [head(100 + 8 * len(shapes)), *index]


def encoded(points: list[tuple[float, float]] | None, kind: int) -> bytes:
    """One shape: a line, or a polygon's exterior ring, which is closed and turned clockwise; too few points are a null shape."""
    if not points or len(points) < (2 if kind == LINE else 3):
        return struct.pack("<i", NULL_SHAPE)
    if kind == POLYGON:
        points = points[:-1] if points[0] == points[-1] else points
        turn = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True))
        points = points[::-1] if turn > 0 else points
        points = [*points, points[0]]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return struct.pack("<i4diii", kind, min(xs), min(ys), max(xs), max(ys), 1, len(points), 0) + struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p])


class ShapefileWriter(StagedWriter):
    endings = (".shp", ".shx", ".dbf", ".prj", ".cpg")

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        super().__init__(options["path"], overwrite)
        self.shape = next((n for n in ("ring", "line") if n in schema.names), None)
        if self.shape is None:
            raise ValueError("a shapefile needs a column ring (polygons) or line (lines)")
        self.fields = [f for f in schema.fields if f.name != self.shape]
        nested = [f.name for f in self.fields if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType | T.NullType)]
        if nested or not self.fields:
            raise ValueError(f"a shapefile's fields are plain values: {nested}" if nested else "a shapefile needs at least one field")
        self.kind = POLYGON if self.shape == "ring" else LINE
        self.prj = options.get("prj") or (prj_text(int(options["epsg"])) if "epsg" in options else None)
        self.rows = int(options.get("rows", FILE_ROWS))

    def write(self, iterator: Iterator[T.Row]) -> Written:
        system, made, partition = self.attempt()
        shapes: list[bytes] = []
        rows: list[list[bytes]] = []
        box, size = [math.inf, math.inf, -math.inf, -math.inf], 0
        for row in iterator:
            points = None if row[self.shape] is None else [(p["x"], p["y"]) for p in row[self.shape]]
            shape = encoded(points, self.kind)
            if len(shape) > 4:
                b = struct.unpack("<4d", shape[4:36])
                box = [min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3])]
            shapes.append(shape)
            rows.append([_text(row[f.name], f) for f in self.fields])
            size += len(shape)
            if len(rows) >= self.rows or size >= FILE_BYTES:
                self._file(system, made, partition, shapes, rows, box)
                shapes, rows, box, size = [], [], [math.inf, math.inf, -math.inf, -math.inf], 0
        if rows:
            self._file(system, made, partition, shapes, rows, box)
        return made

    def _file(self, system, made: Written, partition: int, shapes: list[bytes], rows: list[list[bytes]], box: list[float]) -> None:
        # The .shp comes last, so that whoever sees it finds its companions.
        stem = f"part-{partition:05d}-{sum(n.endswith('.shp') for n in made.names):03d}-{self.job[:12]}"
        shp, shx = shp_parts(shapes, self.kind, box if box[0] <= box[2] else [0.0] * 4)
        if self.prj:
            self.put(system, made, f"{stem}.prj", [self.prj.encode()])
        self.put(system, made, f"{stem}.cpg", [b"UTF-8"])
        self.put(system, made, f"{stem}.dbf", dbf_parts(self.fields, rows))
        self.put(system, made, f"{stem}.shx", shx)
        self.put(system, made, f"{stem}.shp", shp)


class ShapefileSink(DataSource):
    """Plots (ring) or crop rows (line), with plain columns as fields, as one or more shapefiles for each task.

    Options: epsg or prj (the .prj's text), rows (of one file; 64 MB of points
    are the other limit).  Rings are closed and clockwise.  Names are cut to
    ten bytes, equal ones are numbered.  Nulls and numbers that aren't finite
    are blank, so an empty text reads as a null would.  A ring of under three
    points or a line of one is a null shape, which keeps its fields.  Texts of
    over 254 bytes and nested columns are errors.  An empty table writes none.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefiles"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return ShapefileWriter(self.options, schema, overwrite)


def companion(path: str, ending: str) -> bytes | None:
    """The bytes of the file beside a .shp that has another ending, in small or capital letters."""
    base = path[: path.rfind(".")]
    return next((c for e in (ending, ending.upper()) if (c := content_of(base + e)) is not None), None)


def parse_lines(content: bytes) -> Iterator[tuple[int, list[tuple[float, float]]]]:
    """(record from 0, points) of the line records of a .shp file."""
    at = 100
    while at + 8 <= len(content):
        number, words = struct.unpack(">ii", content[at : at + 8])
        body = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if len(body) >= 44 and struct.unpack("<i", body[:4])[0] in LINES:
            n_parts, n = struct.unpack("<ii", body[36:44])
            flat = struct.unpack(f"<{2 * n}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n])
            yield number - 1, list(zip(flat[::2], flat[1::2], strict=True))


def read_row_lines(spark: SparkSession, path: str) -> DataFrame:
    """Crop rows of the line shapefiles under path: plot_id, row_idx, v_off_m, length_m, angle_deg, source, contrast and line, its first and last point.

    Lines of under two points are left out; a missing source is "edit",
    missing numbers are 0, a missing contrast is NaN.  One task for each file.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In Arrow, since pandas would make a NaN a null.
        kinds = [("plot_id", pa.string()), ("row_idx", pa.int32()), *((k, pa.float64()) for k in ("v_off_m", "length_m", "angle_deg")), ("source", pa.string()), ("contrast", pa.float64()), ("line", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, (_, kind) in enumerate(kinds)], schema=pa.schema(kinds))
        for batch in batches:
            for p in batch.column(0).to_pylist():
                n, record = dbf_records(companion(p, ".dbf") or b"\0" * 32 + b"\x0d")
                out = []
                for i, points in parse_lines(content_of(p)):
                    if len(points) >= 2:
                        r = {k.lower(): v for k, v in record(i).items()} if i < n else {}
                        number = lambda k, kind, none, r=r: kind(float(r[k])) if r.get(k) else none
                        out.append((r.get("plot_id", ""), number("row_idx", int, 0), *(number(k, float, 0.0) for k in ("v_off_m", "length_m", "angle_deg")), r.get("source") or "edit", number("contrast", float, math.nan), [{"x": x, "y": y} for x, y in (points[0], points[-1])]))
                    if len(out) >= PIECE_ROWS:
                        yield batch_of(out)
                        out = []
                yield batch_of(out)

    files = list_files(spark, path).where(F.col("name").endswith(".shp")).select("path")
    return files.mapInArrow(rows, f"plot_id string, row_idx int, v_off_m double, length_m double, angle_deg double, source string, contrast double, line {RING}")
