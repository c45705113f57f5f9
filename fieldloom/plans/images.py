"""Queries of windows of rasters, with their SQL: mosaics of 32 by 32 cells are made of 16 embeddings each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import handover, rowfind, warp, windows
from fieldloom.plans.catalog import query
from fieldloom.plans.derive import table
from fieldloom.tables import stored

_CELLS = """cells AS (SELECT raster, (k // 4) * 8 + i // 8 AS row, (k % 4) * 8 + i % 8 AS col, CASE WHEN v8 % 13 = 0 THEN 0 ELSE v8 END AS r, CASE WHEN v8 % 13 = 0 THEN 0 ELSE (v8 * 3) % 251 END AS g, CASE WHEN v8 % 13 = 0 THEN 0 ELSE (v8 * 5) % 241 END AS b
  FROM (SELECT vec_id // 16 AS raster, vec_id % 16 AS k, i, floor((v + 1) * 127 + 0.5)::int AS v8 FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::double AS v FROM embeddings)))"""
_RASTERS = "rasters AS (SELECT DISTINCT vec_id // 16 AS raster, 0.05::double + 0.001::double * (vec_id // 16 % 3) AS a, 0.002::double AS b, 100.0::double + vec_id // 16 AS c, 0.001::double AS d, -0.05::double AS e, 200.0::double AS f FROM embeddings)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    v8 = F.floor((F.col("v").cast("double") + 1) * 127 + 0.5).cast("int")
    k = F.col("vec_id") % 16
    e = e.select(F.expr("vec_id div 16").alias("raster"), (F.floor(k / 4) * 8 + F.floor(F.col("i") / 8)).alias("row"), (k % 4 * 8 + F.col("i") % 8).alias("col"), v8.alias("v8"))
    band = lambda x: F.when(F.col("v8") % 13 == 0, 0).otherwise(x)
    return e.select("raster", "row", "col", band(F.col("v8")).alias("r"), band(F.col("v8") * 3 % 251).alias("g"), band(F.col("v8") * 5 % 241).alias("b"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 16").alias("raster")).distinct()
    g = F.col("raster")
    t = F.struct((0.05 + 0.001 * (g % 3)).alias("a"), F.lit(0.002).alias("b"), (100.0 + g).alias("c"), F.lit(0.001).alias("d"), F.lit(-0.05).alias("e"), F.lit(200.0).alias("f"))
    return n.select("raster", t.alias("t"), F.lit(32).alias("width"), F.lit(32).alias("height"))


def _turned_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, t = F.col("raster"), F.col("t")
    col, row, turn = 14.3 + g % 5, F.lit(15.7), 0.3 + 0.37 * g
    return rasters(spark, sf_dir).select(
        g.alias("plot"), "raster", (t.a * col + t.b * row + t.c).alias("cx"), (t.d * col + t.e * row + t.f).alias("cy"), F.cos(turn).alias("ux"), F.sin(turn).alias("uy"), (-F.sin(turn)).alias("vx"), F.cos(turn).alias("vy"),
        (0.5 + 0.07 * (g % 4)).alias("hl"), (0.25 + 0.02 * (g % 3)).alias("hw"),
    )


_ORIENTED = f"""WITH {_CELLS}, {_RASTERS},
p AS (SELECT *, a * (14.3::double + raster % 5) + b * 15.7::double + c AS cx, d * (14.3::double + raster % 5) + e * 15.7::double + f AS cy, 0.3::double + 0.37::double * raster AS turn, 0.5::double + 0.07::double * (raster % 4) AS hl, 0.25::double + 0.02::double * (raster % 3) AS hw FROM rasters),
n AS (SELECT *, greatest(8, round_even(2 * hl / 0.021::double, 0)::int) AS n_i, greatest(8, round_even(2 * (hw + 0.3::double * hw) / 0.021::double, 0)::int) AS n_j FROM p),
s AS (SELECT *, unnest(range(n_i)) AS i FROM n), q AS (SELECT *, unnest(range(n_j)) AS j FROM s),
w AS (SELECT *, -hl + (i + 0.5::double) * (2 * hl / n_i) AS u, -1.3::double * hw + (j + 0.5::double) * 0.021::double AS v FROM q),
xy AS (SELECT *, cx + cos(turn) * u - sin(turn) * v - c AS x, cy + sin(turn) * u + cos(turn) * v - f AS y, a * e - b * d AS det FROM w),
places AS (SELECT raster, i::int AS i, j::int AS j, greatest(0, least(31, floor((e * x - b * y) / det))) AS col, greatest(0, least(31, floor((a * y - d * x) / det))) AS row FROM xy)
"""


@query(f"{_ORIENTED} SELECT raster AS plot, i, j, r, g, cells.b AS b FROM places JOIN cells USING (raster, row, col)")
def ortho_windows(spark, sf_dir):
    blocks = windows.to_blocks(cells(spark, sf_dir), "raster", 8, ["r", "g", "b"])
    plans = windows.oriented_windows(_turned_plots(spark, sf_dir), rasters(spark, sf_dir), 0.021)
    return windows.samples(windows.sampled(plans, blocks, 8), ["r", "g", "b"]).select("plot", "i", "j", "r", "g", "b")


_PROFILES = f"""WITH {_CELLS}, {_RASTERS},
p AS (SELECT *, 12.2::double + raster % 7 AS x0, 9.4::double + raster % 3 AS y0 FROM rasters),
s AS (SELECT *, unnest(range(40)) AS i FROM p), q AS (SELECT *, unnest(range(25)) AS j FROM s),
st AS (SELECT *, -0.45::double + i * (1.9::double / 39) AS s, 0.06::double + j * (0.88::double / 24) AS t FROM q),
places AS (SELECT raster, i::int AS i, greatest(0, least(31, floor(x0 + s * 7.3::double + t * -2.1::double + s * t * 1.7::double))) AS col, greatest(0, least(31, floor(y0 + s * 1.9::double + t * 15.2::double + s * t * -1.2::double))) AS row FROM st),
g AS (SELECT raster, i, coalesce(avg(2 * g - r - cells.b) FILTER (greatest(r, g, cells.b) > 4), 0) AS v, count(*) FILTER (greatest(r, g, cells.b) > 4) AS n FROM places JOIN cells USING (raster, row, col) GROUP BY 1, 2),
ok AS (SELECT raster, sum(n) >= 500 AS ok FROM g GROUP BY 1)"""


def _skewed_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads that are no parallelograms, over block borders and the raster's edge; their short edge comes first."""
    g, t = F.col("raster"), F.col("t")
    x0, y0 = 12.2 + g % 7, 9.4 + g % 3
    point = lambda x, y: F.struct((t.a * x + t.b * y + t.c).alias("x"), (t.d * x + t.e * y + t.f).alias("y"))
    return rasters(spark, sf_dir).select(g.alias("plot"), "raster", F.array(point(x0, y0), point(x0 + 7.3, y0 + 1.9), point(x0 + 7.3 - 2.1 + 1.7, y0 + 1.9 + 15.2 - 1.2), point(x0 - 2.1, y0 + 15.2)).alias("ring"))


@query(f"{_PROFILES} SELECT raster AS plot, i, round(v, 6) AS v FROM g JOIN ok USING (raster) WHERE ok")
def ortho_profiles(spark, sf_dir):
    blocks = windows.to_blocks(cells(spark, sf_dir), "raster", 8, ["r", "g", "b"])
    plans = windows.profile_windows(_skewed_plots(spark, sf_dir), rasters(spark, sf_dir), 0.45, 40, 25)
    found = windows.greenness_profiles(windows.samples(windows.sampled(plans, blocks, 8), ["r", "g", "b"]), plans)
    return found.select("plot", F.posexplode("profile").alias("i", "v")).select("plot", "i", F.round("v", 6).alias("v"))


# ---------------------------------------------------------------- rows in windows

_SEGMENTS = """segs AS (SELECT vec_id // 8 AS plot, vec_id % 8 AS seg, list_transform(embedding, lambda x: x::double) AS sig FROM embeddings)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight signals of 64 steps for each plot."""
    sig = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("plot"), F.struct((F.col("vec_id") % 8).alias("seg"), sig.alias("sig")).alias("s"))
    return e.groupBy("plot").agg(F.sort_array(F.collect_list("s")).alias("s"))


@query(f"""WITH {_SEGMENTS}, x AS (SELECT plot, seg, unnest(range(64)) AS i, unnest(sig) AS v FROM segs), h AS (SELECT plot, seg, i, v * (0.5::double - 0.5::double * cos(2 * pi() * i / 63)) AS v FROM x),
f AS (SELECT unnest(range(74, 205)) AS k), w AS (SELECT plot, seg, k, sum(v * cos(2 * pi() * k * i / 1024)) AS c, sum(v * sin(2 * pi() * k * i / 1024)) AS s FROM h, f GROUP BY 1, 2, 3),
p AS (SELECT plot, k, sum(c * c + s * s) AS power FROM w GROUP BY 1, 2)
SELECT plot, round(1024.0::double / arg_max(k, (round(power, 6), -k)), 6) AS pitch, round(max(power) / sum(power), 6) AS share FROM p GROUP BY 1""")
def segment_spectra(spark, sf_dir):
    found = _segments(spark, sf_dir).select("plot", rowfind.strongest_pitch(F.lit(5.0), F.lit(14.0), F.col("s.sig"), 1024).alias("p"))
    return found.select("plot", F.round("p.pitch", 6).alias("pitch"), F.round("p.share", 6).alias("share"))


def _tilt_sql() -> str:
    rounds = "w0 AS (SELECT plot, l, pu, amp, amp AS w FROM u)"
    for k in range(4):
        rounds += f""", n{k} AS (SELECT plot, sum(w) AS sw, sum(w * l) / sum(w) AS ml, sum(w * pu) / sum(w) AS mp, count(*) FILTER (w > 0) AS live FROM w{k} GROUP BY 1),
b{k} AS (SELECT plot, any_value(live) AS live, any_value(ml) AS ml, any_value(mp) AS mp, coalesce(sum(w * (l - ml) * (pu - mp)) / nullif(sum(w * (l - ml) * (l - ml)), 0), 0) AS b FROM w{k} JOIN n{k} USING (plot) GROUP BY 1),
r{k} AS (SELECT plot, l, pu, amp, w, abs(pu - mp - b * (l - ml)) AS r, b FROM w{k} JOIN b{k} USING (plot)),
t{k} AS (SELECT plot, greatest(9.3::double / 8, 2.5::double * median(r) FILTER (w > 0)) AS tol FROM r{k} GROUP BY 1),
w{k + 1} AS (SELECT plot, l, pu, amp, CASE WHEN r < tol THEN amp ELSE 0 END AS w FROM r{k} JOIN t{k} USING (plot))"""
    return rounds


@query(f"""WITH {_SEGMENTS}, x AS (SELECT plot, seg, unnest(range(64)) AS i, unnest(sig) AS v FROM segs),
z AS (SELECT plot, seg, sum(v * cos(2 * pi() * (i + 0.5::double) / 9.3::double)) AS c, -sum(v * sin(2 * pi() * (i + 0.5::double) / 9.3::double)) AS s FROM x GROUP BY 1, 2),
q AS (SELECT plot, seg, sqrt(c * c + s * s) / 64 AS amp, -atan2(s, c) / (2 * pi()) * 9.3::double AS p0 FROM z), p AS (SELECT plot, seg, amp, p0 - 9.3::double * floor(p0 / 9.3::double) AS pos FROM q),
d AS (SELECT *, pos - lag(pos) OVER (PARTITION BY plot ORDER BY seg) + 4.65::double AS d FROM p),
u AS (SELECT plot, 20.0::double * seg AS l, amp, first_value(pos) OVER o + sum(coalesce(d - 9.3::double * floor(d / 9.3::double) - 4.65::double, 0)) OVER o AS pu FROM d WINDOW o AS (PARTITION BY plot ORDER BY seg)),
{_tilt_sql()}, a AS (SELECT plot, degrees(atan(b)) AS a FROM b3 WHERE plot IN (SELECT plot FROM n0 WHERE live >= 3))
SELECT plot, round(CASE WHEN abs(a) > 8 THEN 0 ELSE a END, 5) AS angle_deg FROM a""")
def segment_tilts(spark, sf_dir):
    z = _segments(spark, sf_dir).where(F.size("s") >= 3).withColumn("z", rowfind.phases(F.col("s.sig"), F.lit(9.3)))
    along = F.transform("s", lambda x: 20.0 * x.seg)
    return z.select("plot", F.round(rowfind.tilt_of(along, rowfind.unwrapped(F.col("z.pos"), F.lit(9.3)), F.col("z.amp"), F.lit(9.3)), 5).alias("angle_deg"))


@query()
def rows_in_ortho(spark, sf_dir):
    """Rows of the turned plots found in their windows: SQL has no spectra of padded segments; the tests hold it against plain numpy."""
    step = 0.021
    blocks = windows.to_blocks(cells(spark, sf_dir), "raster", 8, ["r", "g", "b"])
    plots = _turned_plots(spark, sf_dir)
    plans = windows.oriented_windows(plots, rasters(spark, sf_dir), step)
    parts = stored(windows.sampled(plans, blocks, 8), "windows")
    found = rowfind.detect(windows.samples(parts, ["r", "g", "b"]), 1000 * step)
    return rowfind.report(found, plans, step)


# ---------------------------------------------------------------- frames warped and handed over

_MESH = """nodes AS (SELECT raster, n % 4 AS i, n // 4 AS j, 1.0::double + (n % 4) * 9.7::double + 0.3::double * (raster % 5) + 0.8::double * (n // 4) AS x, -0.4::double + (n // 4) * 15.9::double - 0.5::double * (n % 4) + 0.2::double * (raster % 3) AS y FROM (SELECT DISTINCT raster, unnest(range(12)) AS n FROM rasters) WHERE NOT (raster % 6 = 5 AND n = 5)),
quads AS (SELECT raster, a.i, a.j, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, d.x AS dx, d.y AS dy FROM nodes a JOIN nodes b USING (raster) JOIN nodes c USING (raster) JOIN nodes d USING (raster)
  WHERE a.i < 3 AND a.j < 2 AND b.i = a.i + 1 AND b.j = a.j AND c.i = a.i AND c.j = a.j + 1 AND d.i = a.i + 1 AND d.j = a.j + 1),
boxes AS (SELECT *, round_even(22 * i / 3.0::double, 0)::int AS x0, round_even(22 * (i + 1) / 3.0::double, 0)::int AS x1, round_even(17 * j / 2.0::double, 0)::int AS y0, round_even(17 * (j + 1) / 2.0::double, 0)::int AS y1 FROM quads),
px AS (SELECT *, unnest(range(x0, x1)) AS col FROM boxes), py AS (SELECT *, unnest(range(y0, y1)) AS row FROM px),
uv AS (SELECT *, (col - x0 + 0.5::double) / (x1 - x0) AS u, (row - y0 + 0.5::double) / (y1 - y0) AS v FROM py),
src AS (SELECT raster, row, col, ax + (bx - ax) * u + (cx - ax) * v + (dx - bx - cx + ax) * u * v AS x, ay + (by_ - ay) * u + (cy - ay) * v + (dy - by_ - cy + ay) * u * v AS y FROM uv),
f AS (SELECT *, floor(x - 0.5::double)::int AS fx, floor(y - 0.5::double)::int AS fy, x >= 0 AND x < 32 AND y >= 0 AND y < 32 AS valid FROM src),
t AS (SELECT *, unnest(range(4)) AS m, x - 0.5::double - fx AS dx, y - 0.5::double - fy AS dy FROM f), k AS (SELECT *, unnest(range(4)) AS n FROM t),
w AS (SELECT raster, row, col, valid, greatest(0, least(31, fx + n - 1)) AS cx, greatest(0, least(31, fy + m - 1)) AS cy,
  CASE n WHEN 0 THEN -dx + 2 * dx ** 2 - dx ** 3 WHEN 1 THEN 1 - 2 * dx ** 2 + dx ** 3 WHEN 2 THEN dx + dx ** 2 - dx ** 3 ELSE dx ** 3 - dx ** 2 END * CASE m WHEN 0 THEN -dy + 2 * dy ** 2 - dy ** 3 WHEN 1 THEN 1 - 2 * dy ** 2 + dy ** 3 WHEN 2 THEN dy + dy ** 2 - dy ** 3 ELSE dy ** 3 - dy ** 2 END AS weight FROM k)"""


def _meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meshes of 3 by 2 cells, skewed, over the raster's edge; one node in six meshes is missing."""
    g = F.col("raster")
    x = lambda n: 1.0 + n % 4 * 9.7 + 0.3 * (g % 5) + 0.8 * F.floor(n / 4)
    y = lambda n: -0.4 + F.floor(n / 4) * 15.9 - 0.5 * (n % 4) + 0.2 * (g % 3)
    node = lambda n: F.when(~((g % 6 == 5) & (n == 5)), F.struct(x(n).alias("x"), y(n).alias("y")))
    return rasters(spark, sf_dir).select(g.alias("plot"), "raster", F.lit(3).alias("nx"), F.lit(2).alias("ny"), F.lit(22).alias("w"), F.lit(17).alias("h"), F.transform(F.sequence(F.lit(0), F.lit(11)), node).alias("nodes"))


@query(f"""WITH {_CELLS}, {_RASTERS}, {_MESH}, s AS (SELECT raster, w.row, w.col, any_value(valid) AS valid, sum(weight * coalesce(r, 0)) AS r, sum(weight * coalesce(g, 0)) AS g, sum(weight * coalesce(c.b, 0)) AS b
  FROM w LEFT JOIN cells c ON c.raster = w.raster AND c.row = w.cy AND c.col = w.cx GROUP BY w.raster, w.row, w.col)
SELECT raster AS plot, row::int AS row, col::int AS col, valid, {", ".join(f"CASE WHEN valid THEN floor(greatest(0, least(255, {k})) + 1e-9::double)::int ELSE 0 END AS {k}" for k in "rgb")} FROM s""".replace("SELECT raster, w.row", "SELECT w.raster, w.row"))
def frames_warped(spark, sf_dir):
    blocks = windows.to_blocks(cells(spark, sf_dir), "raster", 8, ["r", "g", "b"])
    boxes = warp.warped(warp.mesh_quads(_meshes(spark, sf_dir)), rasters(spark, sf_dir), blocks, 8)
    return warp.pixels(boxes, ["r", "g", "b"])


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring mosaics as a composite and a new frame, which overlap in a ragged band, beside or above each other."""
    px = cells(spark, sf_dir).withColumn("n", F.col("row") * 32 + F.col("col"))
    bands = F.array(*[F.expr(f"transform(p, x -> x.{c})") for c in "rgb"])
    whole = px.groupBy("raster").agg(F.sort_array(F.collect_list(F.struct("n", "r", "g", "b"))).alias("p")).where(F.size("p") == 1024).select("raster", bands.alias("bands"))
    a = whole.where("raster % 2 = 0").select(F.expr("raster div 2").alias("key"), F.col("bands").alias("old"))
    b = whole.where("raster % 2 = 1").select(F.expr("raster div 2").alias("key"), F.col("bands").alias("new"))
    at = lambda f: F.transform(F.sequence(F.lit(0), F.lit(1023)), f)
    turned = F.col("key") % 2 == 1
    across = lambda n: F.when(turned, n % 32).otherwise(F.floor(n / 32))
    along = lambda n: F.when(turned, F.floor(n / 32)).otherwise(n % 32)
    flip = lambda v: F.when(F.col("key") % 4 >= 2, 31 - v).otherwise(v)
    filled, valid = at(lambda n: flip(across(n)) < 22 + F.floor(along(n) / 9) % 3), at(lambda n: flip(across(n)) >= 9 + F.floor(along(n) / 8) % 3)
    return a.join(b, "key").select("key", F.lit(32).alias("h"), F.lit(32).alias("w"), "old", "new", filled.alias("filled"), valid.alias("valid"))


@query()
def min_error_seam(spark, sf_dir):
    """Seams of the strips and the pixels on both sides: SQL has no dynamic programming; the tests hold it against brute force."""
    out = handover.handed_over(strips(spark, sf_dir), slack=8, least=200, fade=10, half=6)
    return out.select("key", "turned", "below", F.array_join("path", " ").alias("path"), F.size(F.filter("take", lambda t: t)).alias("taken"), F.aggregate(F.flatten("bands"), F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))
