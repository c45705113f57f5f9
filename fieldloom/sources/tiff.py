"""TIFF images as blocks: a data source that reads a file's header and the strips or tiles that are asked for, and nothing else.

    spark.dataSource.register(TiffSource)
    spark.read.format("tiff_blocks").option("box", "0,0,512,512").load(path)

Files may be anywhere that pyarrow's file systems reach.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from fieldloom.sources.staged import located

# Numbers of tags and types of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_BYTES = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}
NONE, DEFLATE = 1, (8, 32946)

SCHEMA = "path string, by long, bx long, x0 long, y0 long, w long, h long, width long, height long, bits int, bands array<array<int>>"
ARROW = pa.schema([("path", pa.string()), *[(n, pa.int64()) for n in ("by", "bx", "x0", "y0", "w", "h", "width", "height")], ("bits", pa.int32()), ("bands", pa.list_(pa.list_(pa.int32())))])


class Part(NamedTuple):
    """A strip or tile: its place among the blocks, its cells inside the image, and where its bytes lie for each plane."""

    by: int
    bx: int
    x0: int
    y0: int
    w: int
    h: int
    chunks: list[tuple[int, int]]


class Tiff:
    """The first image of a TIFF file, open for reading parts of it; read counts the bytes that were read.

    Without pixels any compression is taken, since only the directory is asked for.
    """

    def __init__(self, path: str, pixels: bool = True) -> None:
        system, inner = located(path)
        self.file, self.read = system.open_input_file(inner), 0
        head = self._bytes(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if not self.order or struct.unpack(self.order + "H", head[2:4])[0] not in (42, 43):
            raise ValueError(f"{path} is no TIFF file")
        big = struct.unpack(self.order + "H", head[2:4])[0] == 43
        at = struct.unpack(self.order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        wide, form, count = (20, "HHQ", "Q") if big else (12, "HHI", "H")
        n = struct.unpack(self.order + count, self._bytes(at, struct.calcsize(count)))[0]
        raw = self._bytes(at + struct.calcsize(count), n * wide)
        self.tags = {}
        for k in range(n):
            entry = raw[k * wide : (k + 1) * wide]
            tag, kind, size = struct.unpack(self.order + form, entry[: struct.calcsize("<" + form)])
            self.tags[tag] = (kind, size, entry[struct.calcsize("<" + form) :])
        self.path, self.width, self.height = path, self._one(WIDTH), self._one(HEIGHT)
        self.samples, self.bits = self._one(SAMPLES, 1), self._one(BITS, 1)
        self.compression, self.predictor, self.planes = self._one(COMPRESSION, 1), self._one(PREDICTOR, 1), self.samples if self._one(PLANAR, 1) == 2 else 1
        if not pixels:
            return
        if self.compression != NONE and self.compression not in DEFLATE:
            raise ValueError(f"{path}: compression {self.compression} isn't supported, only none and deflate")
        if self.bits not in (8, 16) or self.predictor not in (1, 2):
            raise ValueError(f"{path}: samples of 8 or 16 bits, without or with differences, are supported")

    def _bytes(self, at: int, n: int) -> bytes:
        self.read += n
        self.file.seek(at)
        return self.file.read(n)

    def _all(self, tag: int) -> tuple[int, ...]:
        kind, n, value = self.tags[tag]
        size = struct.calcsize("<" + TYPES[kind]) * n
        raw = value[:size] if size <= len(value) else self._bytes(struct.unpack(self.order + ("Q" if len(value) == 8 else "I"), value)[0], size)
        return struct.unpack(f"{self.order}{n}{TYPES[kind]}", raw)

    def _one(self, tag: int, default: int | None = None) -> int:
        if tag not in self.tags:
            if default is None:
                raise ValueError(f"{self.path if hasattr(self, 'path') else 'a TIFF file'} has no tag {tag}")
            return default
        return self._all(tag)[0]

    def parts(self, box: tuple[int, int, int, int]) -> Iterator[Part]:
        """The strips or tiles that overlap a box x0, y0, x1, y1 (ends excluded), in order."""
        tiled = TILE_AT in self.tags
        pw, ph = (self._one(TILE_W), self._one(TILE_H)) if tiled else (self.width, min(self.height, self._one(STRIP_ROWS, self.height)))
        at, size = (self._all(TILE_AT), self._all(TILE_BYTES)) if tiled else (self._all(STRIP_AT), self._all(STRIP_BYTES))
        across, down = -(-self.width // pw), -(-self.height // ph)
        x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), min(self.width, box[2]), min(self.height, box[3])
        if x0 >= x1 or y0 >= y1:
            return
        for by in range(y0 // ph, (y1 - 1) // ph + 1):
            for bx in range(x0 // pw, (x1 - 1) // pw + 1):
                chunks = [(at[p * across * down + by * across + bx], size[p * across * down + by * across + bx]) for p in range(self.planes)]
                yield Part(by, bx, bx * pw, by * ph, min(pw, self.width - bx * pw), min(ph, self.height - by * ph), chunks)

    def bands(self, part: Part) -> list[np.ndarray]:
        """The part's samples, one array for each band, row by row."""
        tiled = TILE_AT in self.tags
        wide, per = self._one(TILE_W) if tiled else self.width, self.samples // self.planes
        out = []
        for at, size in part.chunks:
            raw = self._bytes(at, size)
            raw = zlib.decompress(raw) if self.compression in DEFLATE else raw
            cells = np.frombuffer(raw, np.dtype(f"u{self.bits // 8}").newbyteorder(self.order))
            cells = cells[: len(cells) // (wide * per) * wide * per].reshape(-1, wide, per)[: part.h]
            if self.predictor == 2:
                cells = np.cumsum(cells, axis=1, dtype=f"u{self.bits // 8}")
            out += [cells[:, : part.w, k].astype(np.int32).ravel() for k in range(per)]
        return out


class _Files(InputPartition):
    def __init__(self, path: str, share: int) -> None:
        self.path, self.share = path, share


class TiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.shares = options["path"], int(options.get("partitions", 1))
        self.box = [int(v) for v in options.get("box", "0,0,2147483647,2147483647").split(",")]

    def partitions(self) -> list[InputPartition]:
        system, inner = located(self.path)
        found = system.get_file_info(inner)
        base = self.path[: len(self.path) - len(inner)] if "://" in self.path else ""
        files = [f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith((".tif", ".tiff"))] if found.type == fs.FileType.Directory else [inner]
        return [_Files(base + f, k) for f in sorted(files) for k in range(self.shares)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        image = Tiff(partition.path)
        for n, part in enumerate(image.parts(tuple(self.box))):
            if n % self.shares == partition.share:
                row = [partition.path, part.by, part.bx, part.x0, part.y0, part.w, part.h, image.width, image.height, image.bits]
                yield pa.RecordBatch.from_arrays([*[pa.array([v], f.type) for v, f in zip(row, ARROW, strict=False)], pa.array([image.bands(part)], ARROW.field("bands").type)], schema=ARROW)


class PushedTiffReader(TiffReader):
    """A reader that takes filters; Spark has one only where spark.sql.python.filterPushdown.enabled is true."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Limits of x0 and y0 keep parts out; all filters stay with Spark too, since a part may be cut by a limit."""
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in ("x0", "y0") and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                k, v = (0 if f.attribute[0] == "x0" else 1), int(f.value)
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.box[k] = max(self.box[k], v)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.box[k + 2] = min(self.box[k + 2], v + (not isinstance(f, LessThan)))
            yield f


class TiffSource(DataSource):
    """Blocks of the TIFF files at a path (a file, or a folder with its subfolders): uncompressed or deflated, 8 or 16 bits, strips or tiles.

    Options: box (x0,y0,x1,y1; only strips and tiles that overlap it are
    read), partitions (tasks among which each file's parts are dealt), and
    filters (true: filters on x0 and y0 keep parts out as well, which needs
    spark.sql.python.filterPushdown.enabled).  A file that isn't such a TIFF
    is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushedTiffReader if self.options.get("filters", "false").lower() == "true" else TiffReader)(self.options)
