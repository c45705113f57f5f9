"""Frames warped onto plots: a mesh of cells, each a bilinear quad in the source, sampled from raster blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that bicubic sampling needs beyond a place, on each side.
REACH = 2


def mesh_quads(meshes: DataFrame) -> DataFrame:
    """One row for each usable cell of meshes: plot, raster, x0, y0, x1, y1 (its box in the plot) and quad (its corners in the source: upper left, upper right, lower left, lower right).

    meshes: plot, raster, nx, ny (cells), w, h (the plot's pixels) and nodes
    (array of points x, y in the source, row by row, null where a place has
    none).  A cell with a null node is left out, and so is one without pixels.
    """
    edge = lambda pixels, k, n: F.bround(pixels * k / n.cast("double")).cast("int")
    each = meshes.select("*", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("j")).select("*", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("i"))
    node = lambda di, dj: F.get("nodes", (F.col("j") + dj) * (F.col("nx") + 1) + F.col("i") + di)
    cells = each.select(
        "plot", "raster", edge(F.col("w"), F.col("i"), F.col("nx")).alias("x0"), edge(F.col("h"), F.col("j"), F.col("ny")).alias("y0"), edge(F.col("w"), F.col("i") + 1, F.col("nx")).alias("x1"), edge(F.col("h"), F.col("j") + 1, F.col("ny")).alias("y1"),
        F.array(node(0, 0), node(1, 0), node(0, 1), node(1, 1)).alias("quad"),
    )
    return cells.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & F.forall("quad", lambda p: p.isNotNull() & p.x.isNotNull() & p.y.isNotNull()))


def places(x0: int, y0: int, x1: int, y1: int, quad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Source x and y of the middles of a box's pixels, bilinear between the quad's corners."""
    u = (np.arange(x1 - x0) + 0.5) / (x1 - x0)
    v = ((np.arange(y1 - y0) + 0.5) / (y1 - y0))[:, None]
    a, b, c, d = quad
    return tuple(a[k] + (b[k] - a[k]) * u + (c[k] - a[k]) * v + (d[k] - b[k] - c[k] + a[k]) * u * v for k in (0, 1))


def weights(d: np.ndarray) -> list[np.ndarray]:
    """Weights of the four neighbours of a place d beyond the second, by the sharp cubic."""
    return [-d + 2 * d**2 - d**3, 1 - 2 * d**2 + d**3, d + d**2 - d**3, -(d**2) + d**3]


def bicubic(patch: np.ndarray, px: int, py: int, x: np.ndarray, y: np.ndarray, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """(values of each band, whether the place is inside the source) at x, y; patch begins at (px, py) of a source of w by h cells, whose edge cells repeat beyond it."""
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    cx, cy = np.floor(x - 0.5).astype(int), np.floor(y - 0.5).astype(int)
    wx, wy = weights(x - 0.5 - cx), weights(y - 0.5 - cy)
    total = np.zeros((len(patch), *x.shape))
    for m in range(4):
        row = np.clip(np.clip(cy + m - 1, 0, h - 1) - py, 0, patch.shape[1] - 1)
        line = np.zeros_like(total)
        for k in range(4):
            col = np.clip(np.clip(cx + k - 1, 0, w - 1) - px, 0, patch.shape[2] - 1)
            line += wx[k] * patch[:, row, col]
        total += wy[m] * line
    return np.where(inside, np.floor(np.clip(total, 0, 255) + 1e-9), 0).astype(np.int32), inside


def warped(quads: DataFrame, rasters: DataFrame, blocks: DataFrame, size: int, n_bands: int = 3) -> DataFrame:
    """quads' boxes with bands (values of 0 to 255, row by row) and valid (whether the pixel's place is inside the source).

    rasters has raster, width and height; blocks is as in operators.windows.
    Each block gives a cell the part that it samples; the parts of one cell,
    which is as small as the mesh makes it, meet in one group.  Cells that no
    block has are 0.
    """
    xs, ys = F.transform("quad", lambda p: p.x), F.transform("quad", lambda p: p.y)
    low = lambda v: F.floor(F.array_min(v) - 0.5) - REACH + 1
    high = lambda v: F.floor(F.array_max(v) - 0.5) + REACH
    hold = lambda v, most: F.greatest(F.lit(0).cast("long"), F.least(most.cast("long") - 1, v))
    q = quads.join(rasters.select("raster", "width", "height"), "raster")
    q = q.withColumns({"sx0": hold(low(xs), F.col("width")), "sx1": hold(high(xs), F.col("width")) + 1, "sy0": hold(low(ys), F.col("height")), "sy1": hold(high(ys), F.col("height")) + 1})
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size)))
    keyed = q.select("*", span("sx0", "sx1").alias("bx")).select("*", span("sy0", "sy1").alias("by"))
    box = ["plot", "x0", "y0", "x1", "y1", "quad", "width", "height", "sx0", "sx1", "sy0", "sy1"]
    named = blocks.select("raster", "by", "bx", F.col("x0").alias("px"), F.col("y0").alias("py"), F.col("w").alias("pw"), F.col("h").alias("ph"), "bands")
    met = keyed.join(named, ["raster", "by", "bx"], "left").select(*box, "px", "py", "pw", "ph", "bands")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["sx0", "sx1", "sy0", "sy1", "px", "py", "pw", "ph"]).to_pylist()
            out = []
            for r, bands in zip(rows, batch.column("bands"), strict=True):
                if not bands.is_valid:
                    out.append((0, 0, 0, []))
                    continue
                x0, x1, y0, y1 = max(r["sx0"], r["px"]), min(r["sx1"], r["px"] + r["pw"]), max(r["sy0"], r["py"]), min(r["sy1"], r["py"] + r["ph"])
                part = [np.asarray(b.values).reshape(r["ph"], r["pw"])[y0 - r["py"] : y1 - r["py"], x0 - r["px"] : x1 - r["px"]].ravel() for b in bands]
                out.append((x0, y0, x1 - x0, part))
            made = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
            kept = [batch.column(c) for c in box]
            yield pa.RecordBatch.from_arrays([*kept, *made, pa.array([o[3] for o in out], pa.list_(pa.list_(pa.int32())))], names=[*box, "px", "py", "pw", "bands"])

    long = T.LongType()
    schema = T.StructType([*met.select(*box).schema.fields, T.StructField("px", long), T.StructField("py", long), T.StructField("pw", long), T.StructField("bands", T.ArrayType(T.ArrayType(T.IntegerType())))])
    pieces = met.mapInArrow(cut, schema)
    parts = pieces.groupBy(*box).agg(F.collect_list(F.struct("px", "py", "pw", "bands")).alias("parts"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, valid = [], []
            for r in batch.to_pylist():
                patch = np.zeros((n_bands, r["sy1"] - r["sy0"], r["sx1"] - r["sx0"]))
                for p in r["parts"]:
                    for k, band in enumerate(p["bands"]):
                        piece = np.array(band).reshape(-1, p["pw"])
                        patch[k, p["py"] - r["sy0"] : p["py"] - r["sy0"] + len(piece), p["px"] - r["sx0"] : p["px"] - r["sx0"] + p["pw"]] = piece
                quad = np.array([(c["x"], c["y"]) for c in r["quad"]])
                found, inside = bicubic(patch, r["sx0"], r["sy0"], *places(r["x0"], r["y0"], r["x1"], r["y1"], quad), r["width"], r["height"])
                values.append([b.ravel() for b in found])
                valid.append(inside.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in box[:5]), pa.array(values, pa.list_(pa.list_(pa.int32()))), pa.array(valid, pa.list_(pa.bool_()))], names=[*box[:5], "bands", "valid"])

    out = T.StructType([*parts.select(*box[:5]).schema.fields, T.StructField("bands", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("valid", T.ArrayType(T.BooleanType()))])
    return parts.mapInArrow(sample, out)


def pixels(boxes: DataFrame, names: list[str]) -> DataFrame:
    """plot, row, col, valid and a column for each band of every pixel of warped's boxes."""
    zipped = F.posexplode(F.arrays_zip("valid", *[F.get("bands", F.lit(k)).alias(n) for k, n in enumerate(names)])).alias("at", "p")
    each = boxes.select("plot", "x0", "y0", "x1", zipped)
    wide: Column = F.col("x1") - F.col("x0")
    return each.select("plot", (F.col("y0") + F.floor(F.col("at") / wide)).cast("int").alias("row"), (F.col("x0") + F.col("at") % wide).cast("int").alias("col"), "p.valid", *[F.col(f"p.{n}").alias(n) for n in names])
