"""Plots from GeoJSON and shapefiles, and back."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.geometry import ring_area, signed_area
from fieldloom.functions.labels import epsg_of

RING = "array<struct<x:double,y:double>>"
# Names of the id field, the first that is there wins.
ID_FIELDS = ("plot_id", "plotid", "plot", "id")


def pick_id_field(fields: list[str]) -> str | None:
    low = {f.lower(): f for f in reversed(fields)}
    return next((low[n] for n in ID_FIELDS if n in low), None)


def _points(coords: Column) -> Column:
    """Points of an exterior ring, without the closing one."""
    ring = F.transform(coords, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    closed = (F.size(coords) > 1) & (coords[0] == F.element_at(coords, -1))
    return F.when(closed, F.slice(ring, F.lit(1), F.size(coords) - 1)).otherwise(ring)


def polygon_of(geometry: Column) -> Column:
    """Exterior ring of a GeoJSON geometry's text: the polygon's, or that of a multipolygon's largest part; null for others."""
    kind = F.get_json_object(geometry, "$.type")
    coords = F.get_json_object(geometry, "$.coordinates")
    one = _points(F.from_json(coords, "array<array<array<double>>>")[0])
    parts = F.transform(F.from_json(coords, "array<array<array<array<double>>>>"), lambda p: _points(p[0]))
    many = F.array_max(F.transform(parts, lambda r: F.struct(ring_area(r).alias("area"), r.alias("ring")))).ring
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """ord, plot_id, ring, props, epsg of the polygons of feature collections; features of other kinds are left out.

    A collection is one JSON text, so it is parsed in one task; many files are
    many tasks.  Ids are those of the id field, else 1, 2, ....
    """
    text = spark.read.text(path, wholetext=True)
    head = text.select(epsg_of(F.get_json_object("value", "$.crs.properties.name")).alias("epsg"), F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("ord", "feature"))
    props = F.from_json(F.get_json_object("feature", "$.properties"), "map<string,string>")
    rows = head.select("ord", polygon_of(F.get_json_object("feature", "$.geometry")).alias("ring"), props.alias("props"), F.coalesce("epsg", F.lit(4326)).alias("epsg")).where("ring is not null")
    lower = F.transform_keys(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    named = F.coalesce(*[lower[n] for n in ID_FIELDS], (F.col("ord") + 1).cast("string"))
    return rows.select("ord", named.alias("plot_id"), "ring", "props", "epsg")


def geojson_feature(ring: Column, props: Column) -> Column:
    """A feature's text, with the ring closed."""
    coords = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(p.x, p.y))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(coords).alias("coordinates")).alias("geometry"), props.alias("properties")))


def clockwise(ring: Column) -> Column:
    """The ring in the direction that shapefiles ask for."""
    return F.when(signed_area(ring) > 0, F.reverse(ring)).otherwise(ring)


def parse_shp(content: bytes) -> Iterator[tuple[int, list[tuple[float, float]]]]:
    """(record from 0, exterior ring of the largest part) of the polygon records of a .shp file."""
    at = 100
    while at + 8 <= len(content):
        number, words = struct.unpack(">ii", content[at : at + 8])
        body = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if len(body) < 44 or struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
            continue
        n_parts, n_points = struct.unpack("<ii", body[36:44])
        parts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
        flat = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
        points = list(zip(flat[::2], flat[1::2], strict=True))
        rings = [points[a:b] for a, b in zip(parts, parts[1:], strict=False)]
        area = lambda r: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1], strict=True)))
        ring = max(rings, key=area)
        yield number - 1, ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def dbf_records(content: bytes) -> tuple[int, Callable[[int], dict[str, str]]]:
    """The number of records of a .dbf file, and a function that gives one as text by field."""
    n, head, size = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), content[at + 16]))
        at += 32

    def record(i: int) -> dict[str, str]:
        x, row = head + i * size + 1, {}
        for name, width in fields:
            row[name] = content[x : x + width].decode("utf-8", "replace").strip()
            x += width
        return row

    return n, record


def parse_dbf(content: bytes) -> list[dict[str, str]]:
    """The records of a .dbf file as text by field."""
    n, record = dbf_records(content)
    return [record(i) for i in range(n)]


#: Rows and points after which a reader hands on what it has of a file.
PIECE_ROWS, PIECE_POINTS = 2_000, 50_000


def shapefile_pieces(path: str, rows: int = PIECE_ROWS) -> Iterator[list[tuple]]:
    """(ord, plot_id, ring, props, prj) of a polygon shapefile, some rows at a time: beyond the files' bytes a task holds one piece."""
    from fieldloom.sources.shapefiles import companion
    from fieldloom.sources.staged import content_of

    fields, system = companion(path, ".dbf"), companion(path, ".prj")
    n, record = dbf_records(fields) if fields is not None else (0, None)
    prj = system.decode("utf-8", "replace") if system else None
    out, points = [], 0
    for i, ring in parse_shp(content_of(path)):
        props = record(i) if i < n else {}
        field = pick_id_field(list(props))
        out.append((i, props[field] if field else str(i + 1), [{"x": x, "y": y} for x, y in ring], props, prj))
        points += len(ring)
        if len(out) >= rows or points >= PIECE_POINTS:
            yield out
            out, points = [], 0
    if out:
        yield out


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """ord, plot_id, ring, props, epsg of polygon shapefiles under path (.shp with its .dbf and .prj beside it); one task for each file.

    Only names are listed and shuffled; a task opens a file and its
    companions.  epsg is null where there is no .prj, or one of a system that
    isn't known.
    """
    from fieldloom.sources.records import list_files
    from fieldloom.sources.shapefiles import epsg_of_prj

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["path"]:
                for piece in shapefile_pieces(p):
                    yield pd.DataFrame(piece, columns=["ord", "plot_id", "ring", "props", "prj"])

    files = list_files(spark, path).where(F.col("name").endswith(".shp")).select("path")
    found = files.mapInPandas(rows, f"ord int, plot_id string, ring {RING}, props map<string,string>, prj string")
    return found.select("ord", "plot_id", "ring", "props", epsg_of_prj(F.col("prj")).alias("epsg"))


def shp_bytes(rings: list[list[tuple[float, float]]]) -> bytes:
    """A polygon .shp file of closed clockwise rings."""
    records = b""
    for i, ring in enumerate(rings):
        r = [*ring, ring[0]]
        xs, ys = [p[0] for p in r], [p[1] for p in r]
        body = struct.pack("<i4d", 5, min(xs), min(ys), max(xs), max(ys)) + struct.pack("<iii", 1, len(r), 0) + b"".join(struct.pack("<dd", *p) for p in r)
        records += struct.pack(">ii", i + 1, len(body) // 2) + body
    every = [p for r in rings for p in r] or [(0.0, 0.0)]
    box = (min(p[0] for p in every), min(p[1] for p in every), max(p[0] for p in every), max(p[1] for p in every))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<ii4d4d", 1000, 5, *box, 0, 0, 0, 0) + records


def dbf_bytes(rows: list[dict[str, str]], width: int = 80) -> bytes:
    """A .dbf file of text fields."""
    names = list(rows[0]) if rows else ["id"]
    head = b"".join(n.encode("latin-1")[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15 for n in names)
    start = struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(rows), 32 + len(head) + 1, 1 + width * len(names))
    return start + head + b"\x0d" + b"".join(b" " + b"".join(str(r.get(n, "")).encode()[:width].ljust(width) for n in names) for r in rows) + b"\x1a"
