"""Sets of ids, lookups and summaries that the reports of a run are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_ids(key: str, *tables: DataFrame) -> DataFrame:
    """The ids that any of the tables has, each once."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.union(t.select(key))
    return out.distinct()


def in_one_only(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids of one selection that the other lacks: a second click on a plot takes it out again."""
    a, b = a.select(key).distinct(), b.select(key).distinct()
    return a.join(b, key, "left_anti").union(b.join(a, key, "left_anti"))


def rows_not_there(wanted: Column, there: Column) -> Column:
    """Row numbers that were asked for and aren't there, in order."""
    return F.array_sort(F.array_except(wanted, there))


def mask_counts(pixels: DataFrame, by: str, a: Column, b: Column) -> DataFrame:
    """Pixels in either of two masks, in both, and in the first alone."""
    n = lambda c: F.count(F.when(c, 1))
    return pixels.groupBy(by).agg(n(a | b).alias("n_any"), n(a & b).alias("n_both"), n(a & ~b).alias("n_first"))


def gathered(*tables: DataFrame) -> DataFrame:
    """Rows of reports with different columns as one table: all columns, null where a report lacks one."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def with_lookups(ids: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """ids with the columns of each table by key; the last row of an id wins (tables have ord)."""
    for t in tables:
        names = [c for c in t.columns if c not in (key, "ord")]
        last = t.groupBy(key).agg(F.max_by(F.struct(*names), "ord").alias("_r"))
        ids = ids.join(last, key, "left").select(*ids.columns, *[F.col(f"_r.{c}").alias(c) for c in names])
    return ids


def matched_lines(lines: DataFrame, plots: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(lines of known plots, one row with the number of those that have none)."""
    known = plots.select(key).distinct()
    return lines.join(known, key), lines.join(known, key, "left_anti").agg(F.count("*").alias("unmatched"))


def zipped(a: DataFrame, b: DataFrame, by: str, ord_a: str, ord_b: str) -> DataFrame:
    """Rows of a and b of the same place in their group's order, side by side; those without a partner go."""
    place = lambda df, o: df.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(o)))
    return place(a, ord_a).join(place(b, ord_b), [by, "_place"]).withColumnRenamed("_place", "place")


def height_or(points: DataFrame, cells: DataFrame, key: str, z: str, fallback: float) -> DataFrame:
    """points with the height of their cell; where there is none, or not a number, the fallback."""
    found = points.join(cells.select(key, F.nanvl(F.col(z), F.lit(None).cast("double")).alias("_z")), key, "left")
    return found.withColumn("z", F.coalesce("_z", F.lit(fallback))).drop("_z")


def nearest_corner(ring: Column, x: Column, y: Column) -> Column:
    """Index (from 0) of the corner that is nearest to a point; the first on ties (to nine digits of the squared distance)."""
    near = F.transform(ring, lambda p, i: F.struct(F.round((p.x - x) * (p.x - x) + (p.y - y) * (p.y - y), 9).alias("d"), i.alias("i")))
    return F.array_min(near)["i"]


def gap_medians(lines: DataFrame, by: str, v: str, pitch: float, low: float = 0.55, high: float = 1.8) -> DataFrame:
    """Median gap between neighbouring lines of each plot, of gaps between low and high pitches."""
    gap = F.col(v) - F.lag(v).over(Window.partitionBy(by).orderBy(v))
    gaps = lines.select(by, gap.alias("gap")).where((F.col("gap") > low * pitch) & (F.col("gap") < high * pitch))
    return gaps.groupBy(by).agg(F.median("gap").alias("gap_med"), F.count("*").alias("n_gaps"))


def run_pitch(gaps: DataFrame, least: int = 10) -> DataFrame:
    """One row: the median of the plots' gap medians, or null and stop = true where fewer than least were measured."""
    n = F.count("gap_med")
    return gaps.agg(n.alias("measured"), F.when(n >= least, F.median("gap_med")).alias("pitch"), (n < least).alias("stop"))


def upper_median(x: Column) -> Column:
    """The middle value of an array, the upper one of two."""
    return F.get(F.array_sort(x), F.floor(F.size(x) / 2).cast("int"))


def usual_count(counts: DataFrame, n: str) -> DataFrame:
    """One row: the most frequent count; of equally frequent ones the smallest."""
    return counts.groupBy(n).agg(F.count("*").alias("_k")).agg(F.max_by(n, F.struct("_k", -F.col(n))).alias("usual"))


def size_uniformity(tiles: DataFrame, by: str) -> DataFrame:
    """For each group its sizes as text, in order, and whether there is one only."""
    size = F.concat_ws("x", F.col("w").cast("int"), F.col("h").cast("int"))
    return tiles.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(size)), " ").alias("sizes"), (F.count_distinct(size) == 1).alias("uniform"))


def cover_summary(tiles: DataFrame, by: str, pct: str, bare: float = 0.5) -> DataFrame:
    """Median cover of each group, and the share of tiles below bare."""
    return tiles.groupBy(by).agg(F.median(pct).alias("median_pct"), F.avg((F.col(pct) < bare).cast("double")).alias("bare_share"))


def block_near_middle(peaks: Column, n: Column, width: Column) -> Column:
    """First of the n neighbouring peaks whose middle is nearest the middle of the width; 0 where there are n or fewer."""
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(peaks) - n))
    score = lambda s: F.abs((F.get(peaks, s) + F.get(peaks, s + n - 1)) / 2 - width / 2)
    best = F.array_min(F.transform(at, lambda s: F.struct(score(s).alias("d"), s.alias("s"))))["s"]
    return F.when((n > 0) & (n < F.size(peaks)), best).otherwise(F.lit(0))


def unwrapped(df: DataFrame, by: str, at: str, phase: str, period: float) -> DataFrame:
    """unwrapped: the phase without jumps; each step is the shortest way round from the last phase."""
    w = Window.partitionBy(by).orderBy(at)
    step = F.col(phase) - F.lag(phase).over(w)
    short = F.coalesce(F.pmod(step + period / 2, F.lit(float(period))) - period / 2, F.lit(0.0))
    first = F.first(phase).over(w)
    return df.withColumns({"_s": short, "_f": first}).withColumn("unwrapped", F.col("_f") + F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s", "_f")


def tilt_from_vertical(dx: Column, dy: Column) -> Column:
    """Acute angle, 0 to 90 degrees, between an edge and the vertical."""
    a = F.abs(F.degrees(F.atan2(dx, dy))) % 180
    return F.least(a, 180 - a)


def mesh_cells(pixels: Column, step: float = 96.0, most: int = 512) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(most), F.ceil(pixels / step).cast("int")))


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres of a degree of longitude and of latitude, at a latitude held within 89.5."""
    held = F.greatest(F.lit(-89.5), F.least(F.lit(89.5), lat))
    return 111320.0 * F.cos(F.radians(held)), F.lit(110540.0)


def across_size(report: DataFrame, pitch_mm: str, rows: int, buffer_m: float) -> DataFrame:
    """One row: metres that the given rows take across, at the run's median spacing, with a buffer on both sides."""
    return report.agg(F.round(rows * F.median(pitch_mm) / 1000 + 2 * max(0.0, buffer_m), 3).alias("across_m"))


def resized_pct(side: Column, pct: Column) -> Column:
    """A side longer by pct of itself; as it was where pct is -90 or less."""
    return F.when(pct > -90, side * (1 + pct / 100)).otherwise(side)


def in_oriented_frame(dx: Column, dy: Column, ux: Column, uy: Column, half_length: Column, half_width: Column) -> Column:
    """Whether a point lies in a frame with the unit axis (ux, uy), both from its centre; the edge counts."""
    return (F.abs(dx * ux + dy * uy) <= half_length) & (F.abs(dy * ux - dx * uy) <= half_width)


def output_unsafe(source: Column, out: Column) -> Column:
    """Whether an output folder is the source folder or lies in it."""
    norm = lambda p: F.regexp_replace(F.lower(F.translate(p, "\\", "/")), "/+$", "")
    return F.startswith(F.concat(norm(out), F.lit("/")), F.concat(norm(source), F.lit("/")))


def preset(label: Column, known: dict[str, str], default: str) -> Column:
    """The value of a label, or the default's."""
    pairs = F.create_map(*[F.lit(x) for p in known.items() for x in p])
    return F.coalesce(F.try_element_at(pairs, label), F.lit(known[default]))
