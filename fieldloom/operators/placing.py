"""Where crops and tiles lie: transforms (a, b, c, d, e, f), scales, frames of plots, control points and lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.checks import crossed

# Metres of a degree, the largest side of a rectified crop, the share of a tile that may leave its crop.
DEGREE_X, DEGREE_Y, MOST_PX, OFF_CROP = 111320.0, 110540.0, 20000, 0.25


def _transform(a, b, c, d, e, f) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), e.alias("e"), f.alias("f"))


def at(t: Column, x: Column, y: Column) -> Column:
    """The ground point of a pixel."""
    return F.struct((t.a * x + t.b * y + t.c).alias("x"), (t.d * x + t.e * y + t.f).alias("y"))


def tile_transform(t: Column, x: Column, y: Column, sx: Column, sy: Column) -> Column:
    """The transform of a window at (x, y) whose pixels are sx by sy pixels of the crop."""
    return _transform(t.a * sx, t.b * sy, t.a * x + t.b * y + t.c, t.d * sx, t.e * sy, t.d * x + t.e * y + t.f)


def turned_transform(t: Column, width: Column) -> Column:
    """The transform after a quarter turn to the left of a tile that was width pixels wide: turned (x, y) was (width - y, x)."""
    return _transform(t.b, -t.a, t.a * width + t.c, t.e, -t.d, t.d * width + t.f)


def moved_points(points: Column, x: Column, y: Column, sx: Column, sy: Column) -> Column:
    """Control points (col, row, and others) of a crop as those of its window."""
    return F.transform(points, lambda p: p.withField("col", (p.col - x) / sx).withField("row", (p.row - y) / sy))


def mm_per_pixel(t: Column, width: Column, height: Column, geographic: Column, unit_m: Column) -> Column:
    """Ground millimetres of a pixel of a transform; degrees count at the middle's latitude; null where it has no area."""
    px = F.sqrt(F.abs(t.a * t.e - t.b * t.d))
    lat = F.radians(at(t, width / 2, height / 2)["y"])
    metres = F.when(geographic, px * F.sqrt(DEGREE_X * F.cos(lat) * DEGREE_Y)).otherwise(px * F.coalesce(F.nullif(unit_m, F.lit(0.0)), F.lit(1.0)))
    return F.when(px > 0, metres * 1000)


def place_check(crop: Column, tile: Column, x0: Column, y0: Column, w: Column, h: Column, tw: Column, th: Column) -> Column:
    """OK where a tile's middle lies where its window's does, to a hundredth of a pixel's width; else WRONG with the distance; "" without a transform, or a note where only the tile has one."""
    want = tile_transform(crop, x0, y0, w / tw, h / th)
    g, m = at(want, tw / 2, th / 2), at(tile, tw / 2, th / 2)
    off = F.hypot(g["x"] - m["x"], g["y"] - m["y"])
    wrong = F.format_string("WRONG by %.4f map units", off)
    return F.when(tile.isNull(), "").when(crop.isNull(), "tile georeferenced, crop not").when(off < 1e-6 + F.abs(want["a"]) * 0.01, "OK").otherwise(wrong)


def edge_scales(pixels: Column, ground: Column) -> Column:
    """(aniso, gsd) of a quad in pixels and in metres: largest over least edge scale, and the upper median; 99 and 0 without an edge of length."""
    length = lambda q, i: F.hypot(F.get(q, F.lit((i + 1) % 4))["x"] - F.get(q, F.lit(i))["x"], F.get(q, F.lit((i + 1) % 4))["y"] - F.get(q, F.lit(i))["y"])
    each = F.array_sort(F.array_compact(F.array(*[F.when(length(ground, i) > 1e-9, length(pixels, i) / length(ground, i)) for i in range(4)])))
    some = F.size(each) > 0
    return F.struct(
        F.when(some, F.array_max(each) / F.greatest(F.array_min(each), F.lit(1e-9))).otherwise(99.0).alias("aniso"),
        F.when(some, F.get(each, F.floor(F.size(each) / 2).cast("int"))).otherwise(0.0).alias("gsd"),
    )


def short_edges_pushed(quad: Column, metres: float) -> Column:
    """A quad of degrees, longer by metres at both ends of its short edges (the first pair where both are as long)."""
    p = [F.get(quad, F.lit(i)) for i in range(4)]
    mx, my = DEGREE_X * F.cos(F.radians((p[0].y + p[1].y + p[2].y + p[3].y) / 4)), F.lit(DEGREE_Y)
    long = lambda i, j: F.hypot((p[j].x - p[i].x) * mx, (p[j].y - p[i].y) * my)
    first = long(0, 1) + long(2, 3) <= long(1, 2) + long(3, 0)

    def out(i: int, j: int) -> Column:
        """Corner i, away from corner j."""
        d = long(i, j)
        d = F.when(d == 0, 1.0).otherwise(d)
        return F.struct((p[i].x - (p[j].x - p[i].x) * metres / d).alias("x"), (p[i].y - (p[j].y - p[i].y) * metres / d).alias("y"))

    return F.when(first, F.array(out(0, 1), out(1, 0), out(2, 3), out(3, 2))).otherwise(F.array(out(0, 3), out(1, 2), out(2, 1), out(3, 0)))


def rectified_size(ground_w: Column, ground_l: Column, gsd: Column, quad: Column) -> Column:
    """(w, h) in pixels of an upright crop: the ground's size at its scale, else the mean of opposite edges; 1 to MOST_PX."""
    p = [F.get(quad, F.lit(i)) for i in range(4)]
    edge = lambda i, j: F.hypot(p[i].x - p[j].x, p[i].y - p[j].y)
    known = F.coalesce((ground_w > 0) & (ground_l > 0) & (gsd > 1e-9), F.lit(False))
    hold = lambda v: F.least(F.lit(MOST_PX), F.greatest(F.lit(1), F.bround(v).cast("int")))
    return F.struct(hold(F.when(known, ground_w * gsd).otherwise((edge(0, 1) + edge(3, 2)) / 2)).alias("w"), hold(F.when(known, ground_l * gsd).otherwise((edge(0, 3) + edge(1, 2)) / 2)).alias("h"))


def points_on_crop(points: Column, w: Column, h: Column) -> Column:
    """Control points (col, row) on a crop, to half a pixel."""
    return F.filter(points, lambda p: p.col.between(-0.5, w + 0.5) & p.row.between(-0.5, h + 0.5))


def lines_in_frame(lines: DataFrame, frames: DataFrame, by: str) -> DataFrame:
    """lines (by, x0, y0, x1, y1) with v_off_m and angle_deg in their plot's frame (cx, cy, ux, uy, vx, vy); lines without a plot go."""
    out = lines.join(frames, by)
    mid_x, mid_y = (F.col("x0") + F.col("x1")) / 2 - F.col("cx"), (F.col("y0") + F.col("y1")) / 2 - F.col("cy")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    along, aside = dx * F.col("ux") + dy * F.col("uy"), dx * F.col("vx") + dy * F.col("vy")
    sign = F.when(along < 0, -1).otherwise(1)
    out = out.withColumns({"v_off_m": F.round(mid_x * F.col("vx") + mid_y * F.col("vy"), 4), "angle_deg": F.round(F.degrees(F.atan2(sign * aside, sign * along)), 3)})
    return out.drop("cx", "cy", "ux", "uy", "vx", "vy")


def frames_one_way(frames: DataFrame, ord_: str) -> DataFrame:
    """frames (ux, uy, vx, vy) turned so that all point as the first one does; its direction is one row."""
    first = frames.agg(F.min_by(F.struct("ux", "uy"), ord_).alias("_u"))
    out = crossed(frames, first)
    sign = F.when(F.col("ux") * F.col("_u.ux") + F.col("uy") * F.col("_u.uy") < 0, -1.0).otherwise(1.0)
    return out.withColumns({k: sign * F.col(k) for k in ("ux", "uy", "vx", "vy")}).drop("_u")


def on_crop(tiles: DataFrame, start: str, size: str, across: str) -> DataFrame:
    """tiles whose place across the rows was held inside the crop, without those that moved by over a quarter of their size."""
    held = F.greatest(F.lit(0), F.least(F.col(start), F.col(across) - F.col(size)))
    return tiles.withColumn("_held", held).where(F.abs(F.col("_held") - F.col(start)) <= OFF_CROP * F.col(size)).withColumn(start, F.col("_held")).drop("_held")


def margins_of(crops: DataFrame, manifest: DataFrame) -> DataFrame:
    """crops with margin_m of their file's last manifest row (raw_file, margin_m, ord) that has a number or none at all; 0 without one."""
    number = F.expr("try_cast(coalesce(nullif(trim(margin_m), ''), '0') as double)")
    last = manifest.withColumn("_m", number).where("_m is not null").groupBy("raw_file").agg(F.max_by("_m", "ord").alias("margin_m"))
    return crops.join(last, "raw_file", "left").withColumn("margin_m", F.coalesce("margin_m", F.lit(0.0)))


def chosen_chunks(chunks: DataFrame, by: str, last_label: bool = False) -> DataFrame:
    """(by, ord, rule) of the chunk that each project's run takes.

    chunks: by, ord (from 0), label, active, want (the chunk asked for; "",
    "active", "(active)" and "auto" ask for none).  By label (the first, or the last
    with last_label), then by place (not with last_label), then the active
    one, then the first.  A chunk asked for but not there leaves no row, or
    with last_label falls back to the active one.
    """
    want = F.trim(F.coalesce("want", F.lit("")))
    asked = ~F.lower(want).isin("", "active", "(active)", "auto")
    named = asked & (F.trim(F.coalesce("label", F.lit(""))) == want)
    placed = asked & (F.expr("try_cast(trim(want) as int)") == F.col("ord"))
    g = chunks.groupBy(by).agg(
        (F.max if last_label else F.min)(F.when(named, F.col("ord"))).alias("label"), F.min(F.when(placed, F.col("ord"))).alias("place"),
        F.min(F.when(F.col("active"), F.col("ord"))).alias("active"), F.min("ord").alias("first"), F.max(asked).alias("asked"),
    )
    rules = ["label", "active", "first"] if last_label else ["label", "place", "active", "first"]
    open_to = lambda r: F.lit(True) if last_label or r in ("label", "place") else ~F.col("asked")
    picks = [F.when(open_to(r), F.col(r)) for r in rules]
    rule = F.coalesce(*[F.when(open_to(r) & F.col(r).isNotNull(), F.lit(r)) for r in rules])
    return g.select(by, F.coalesce(*picks).alias("ord"), rule.alias("rule")).where("ord is not null")


def cameras_by_stem(files: DataFrame, cameras: DataFrame) -> DataFrame:
    """files (file, stem) with the aligned camera of that label or photo stem, in any case; the last entry of a name counts, a camera's photo after its label; null without one.

    cameras: camera, label, photo_stem, posed, ord.
    """
    names = F.explode(F.array(F.struct(F.lower("label").alias("stem"), F.struct("ord", F.lit(0).alias("k")).alias("at")), F.struct(F.lower("photo_stem").alias("stem"), F.struct("ord", F.lit(1).alias("k")).alias("at"))))
    index = cameras.where("posed").select("camera", names.alias("n")).groupBy(F.col("n.stem").alias("stem")).agg(F.max_by("camera", "n.at").alias("camera"))
    return files.withColumn("stem", F.lower("stem")).join(index, "stem", "left")


def upstream_sections(folders: DataFrame, recipes: DataFrame) -> DataFrame:
    """folders (path, parent) with the section of the recipe (path, section) above them, else of their own; null without either."""
    above = recipes.select(F.col("path").alias("parent"), F.col("section").alias("_above"))
    own = recipes.select("path", F.col("section").alias("_own"))
    return folders.join(above, "parent", "left").join(own, "path", "left").withColumn("section", F.coalesce(F.nullif("_above", F.lit("")), F.nullif("_own", F.lit("")))).drop("_above", "_own")


def last_state(edits: DataFrame, by: str, ord_: str, depth: int | None = None) -> DataFrame:
    """(by, value) after a log of edits (kind set, undo or reset, with value): an undo takes the newest set that still stands, a reset all of them; null where none is left.

    With a depth (40 in an editor) only so many steps can be undone: older
    states, the empty one included, are forgotten as new ones come, and an
    undo beyond them does nothing.
    """
    w = Window.partitionBy(by).orderBy(ord_)
    rounds = edits.withColumn("_round", F.sum((F.col("kind") == "reset").cast("int")).over(w))
    rounds = rounds.withColumn("_last", F.max("_round").over(Window.partitionBy(by))).where("_round = _last and kind <> 'reset'")
    log = rounds.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), "kind", "value"))).alias("_log"))
    # The state before all edits is the first of the stack; the newest is its last.
    none = F.expr("array(cast(null as string))")
    held = lambda s: s if depth is None else F.when(F.size(s) > depth + 1, F.slice(s, -(depth + 1), depth + 1)).otherwise(s)
    stack = F.aggregate("_log", none, lambda s, e: F.when(e.kind == "set", held(F.concat(s, F.array(e.value.cast("string"))))).when(F.size(s) > 1, F.slice(s, 1, F.size(s) - 1)).otherwise(s))
    return edits.select(by).distinct().join(log.select(by, stack.alias("_s")), by, "left").select(by, F.try_element_at("_s", F.lit(-1)).alias("value"))


@dataclass(frozen=True)
class CropOptions:
    """Options of a crop run; check() raises ValueError where they contradict each other."""

    extension: str = ".tif"
    style: str = "bbox"
    bits: int = 8
    raw_values: bool = False

    def check(self) -> CropOptions:
        deep = self.raw_values or self.bits == 16
        if self.bits not in (8, 16):
            raise ValueError("bits: 8 or 16")
        if deep and self.extension == ".jpg":
            raise ValueError("JPEG holds 8 bits: take GeoTIFF, TIFF or PNG for 16 bits or raw values")
        if deep and self.style not in ("mask", "bbox"):
            raise ValueError("16 bits and raw values need the style mask or bbox: a rectified crop is resampled")
        return CropOptions(self.extension, self.style, 16 if deep else 8, self.raw_values)


@dataclass(frozen=True)
class TileOptions:
    """Options of a tile run; check() raises ValueError where they contradict each other."""

    tile: int = 1024
    overlap: int = 256

    def check(self) -> TileOptions:
        if self.tile < 1 or self.overlap < 0:
            raise ValueError("tile: 1 or more; overlap: 0 or more")
        if self.overlap >= self.tile:
            raise ValueError("overlap must be smaller than the tile")
        return self
