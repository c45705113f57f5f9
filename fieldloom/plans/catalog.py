"""The registered queries and the SQL that DuckDB checks them with.

Plots, frames, tiles and profiles are views over the given tables (derive.py);
each query is the package's operator on such a view, over all its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geometry as geo
from fieldloom.functions import labels
from fieldloom.functions.crs import utm_forward
from fieldloom.operators import checks, edits, frames, layout, raster, rows, signal
from fieldloom.plans import derive
from fieldloom.plans.derive import table, with_views
from fieldloom.sources import records, vector
from fieldloom.streaming import landing

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- frame selection

_SCORED = """
pairs AS (SELECT * FROM plots JOIN cameras ON x0 < fx1 AND fx0 < x1 AND y0 < fy1 AND fy0 < y1),
uv AS (SELECT *, (fx1 - fx0) * gsd AS w, (fy1 - fy0) * gsd AS h, (x1 - x0) * (y1 - y0) AS area,
  (least(x1, fx1) - greatest(x0, fx0)) * (least(y1, fy1) - greatest(y0, fy0)) / ((x1 - x0) * (y1 - y0)) AS cov,
  (x0 - fx0) * gsd AS u0, (x1 - fx0) * gsd AS u1, (y0 - fy0) * gsd AS v0, (y1 - fy0) * gsd AS v1, 0.1::double * gsd AS m FROM pairs),
scored AS (SELECT *,
  (u0 >= 0 AND u0 < w)::int * (v0 >= 0 AND v0 < h)::int + (u0 >= 0 AND u0 < w)::int * (v1 >= 0 AND v1 < h)::int
    + (u1 >= 0 AND u1 < w)::int * (v0 >= 0 AND v0 < h)::int + (u1 >= 0 AND u1 < w)::int * (v1 >= 0 AND v1 < h)::int AS corners,
  u0 - m >= 8 AND u1 + m <= w - 8 AND v0 - m >= 8 AND v1 + m <= h - 8 AS clear,
  round(greatest(-u0, u1 - w, -v0, v1 - h, 0), 3) AS over,
  round(sqrt(((u0 + u1) / 2 - w / 2) ** 2 + ((v0 + v1) / 2 - h / 2) ** 2) / (sqrt(w * w + h * h) / 2), 4) AS dist,
  CASE WHEN aniso <= 1.06 THEN 0 WHEN aniso <= 1.2 THEN 1 WHEN aniso <= 1.5 THEN 2 ELSE 3 END AS atier,
  gsd < 0.7::double * coalesce(nullif(max(CASE WHEN aniso <= 1.5 THEN gsd END) OVER (PARTITION BY plot_id), 0),
        max(CASE WHEN cov >= 0.5 THEN gsd END) OVER (PARTITION BY plot_id), 0) AS low FROM uv),
ranked AS (SELECT *, row_number() OVER (PARTITION BY plot_id ORDER BY CASE WHEN cov >= 0.999 THEN 0 ELSE 1 END,
  CASE WHEN cov >= 0.999 THEN atier ELSE -round(cov, 4) END + low::int, CASE WHEN cov >= 0.999 THEN -clear::int ELSE atier END,
  dist, over, camera) AS rank FROM scored),
best AS (SELECT *, row_number() OVER (PARTITION BY plot_id ORDER BY -round(cov, 4), round(aniso, 3), round(dist, 3), camera) AS rank FROM scored),
tiered AS (SELECT *, row_number() OVER (PARTITION BY plot_id ORDER BY
  atier + CASE WHEN cov >= 0.75 THEN 0 WHEN cov >= 0.5 THEN 1 ELSE 2 END + low::int, -round(cov, 4), -clear::int, dist, over, camera) AS rank FROM scored)
"""
_CAND = "SELECT plot_id, rank::int AS rank, camera, round(100 * cov, 1) AS cover_pct, round(cov * area, 3) AS cover_m2, corners AS corners_in_frame, round(aniso, 3) AS aniso, round(1000 / gsd, 3) AS mm_per_px, rank = 1 AS used FROM {t} WHERE rank <= {n}"


def _frames_sql(body: str) -> str:
    return with_views("plots", "cameras", body="") .rstrip() + "," + _SCORED + body


def ranked(spark: SparkSession, sf_dir: str, mode: str = "whole_first") -> DataFrame:
    return frames.rank_frames(frames.score(frames.box_join(derive.plots(spark, sf_dir), derive.cameras(spark, sf_dir))), mode)


@query(_frames_sql(_CAND.format(t="ranked", n=12)))
def frame_select_candidates(spark, sf_dir):
    return frames.candidates(ranked(spark, sf_dir))


@query(_frames_sql("""SELECT p.plot_id, round((p.x1 - p.x0) * (p.y1 - p.y0), 3) AS plot_area_m2, coalesce(n, 0) AS cand_frames, one.camera AS raw_image,
  one.corners AS corners_in_frame, round(100 * one.cov, 1) AS raw_covered_pct, b.camera AS best_frame, round(100 * b.cov, 1) AS best_cover_pct,
  CASE WHEN n IS NULL THEN 'no covering raw image' ELSE '' END AS note
  FROM plots p LEFT JOIN (SELECT plot_id, count(*) AS n FROM ranked GROUP BY 1) c USING (plot_id) LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) one USING (plot_id)
  LEFT JOIN (SELECT plot_id, camera, cov FROM (SELECT *, row_number() OVER (PARTITION BY plot_id ORDER BY cov DESC, rank) AS k FROM ranked) WHERE k = 1) b USING (plot_id)"""))
def frame_select_manifest(spark, sf_dir):
    return frames.manifest(derive.plots(spark, sf_dir), ranked(spark, sf_dir))


@query(_frames_sql(_CAND.format(t="best", n=1)))
def frame_best_single(spark, sf_dir):
    return frames.candidates(ranked(spark, sf_dir, "best"), 1)


@query(_frames_sql(_CAND.format(t="tiered", n=12)))
def frame_tiered(spark, sf_dir):
    return frames.candidates(ranked(spark, sf_dir, "tiered"))


@query(with_views("plots", "cameras", body="""SELECT plot_id, 'no covering raw image' AS note FROM plots p WHERE NOT EXISTS (SELECT 1 FROM cameras
  WHERE x0 < fx1 - 2.5::double AND fx0 + 2.5::double < x1 AND y0 < fy1 - 4.0::double AND fy0 + 4.0::double < y1)"""))
def plots_uncovered(spark, sf_dir):
    seen = frames.box_join(derive.plots(spark, sf_dir), derive.narrow_cameras(spark, sf_dir)).select("plot_id").distinct()
    return derive.plots(spark, sf_dir).join(seen, "plot_id", "left_anti").select("plot_id", F.lit("no covering raw image").alias("note"))


@query(_frames_sql("""SELECT sum(n)::bigint AS pairs, count(*) AS plots, sum((c >= 0.999)::int)::bigint AS whole, sum((c < 0.999)::int)::bigint AS partial
  FROM (SELECT plot_id, count(*) AS n, max(cov) AS c FROM scored GROUP BY 1)"""))
def frame_run_totals(spark, sf_dir):
    per = ranked(spark, sf_dir).groupBy("plot_id").agg(F.count("*").alias("n"), F.max("cov").alias("c"))
    return per.agg(F.sum("n").alias("pairs"), F.count("*").alias("plots"), F.count(F.when(F.col("c") >= 0.999, 1)).alias("whole"), F.count(F.when(F.col("c") < 0.999, 1)).alias("partial"))


_COVER = """, pool AS (
  SELECT plot_id, rank, camera, list_reduce(list_transform(range(65), lambda k: CASE WHEN x0 + (x1 - x0) * ((k % 5) / 4.0::double) >= fx0 AND x0 + (x1 - x0) * ((k % 5) / 4.0::double) < fx1
    AND y0 + (y1 - y0) * ((k // 5) / 12.0::double) >= fy0 AND y0 + (y1 - y0) * ((k // 5) / 12.0::double) < fy1 THEN 1::hugeint << k::int ELSE 0::hugeint END), lambda a, b: a | b) AS m FROM ranked WHERE rank <= 16),
cover AS (SELECT plot_id, 1 AS step, m AS have, camera::varchar AS used FROM pool WHERE rank = 1 UNION ALL
  SELECT plot_id, step + 1, have | m, used || ',' || camera FROM (
    SELECT c.plot_id, c.step, c.have, c.used, p.m, p.camera, bit_count(p.m & ~c.have) AS gain, row_number() OVER (PARTITION BY c.plot_id ORDER BY bit_count(p.m & ~c.have) DESC, p.rank) AS place
    FROM cover c JOIN pool p USING (plot_id) WHERE c.step < 8) WHERE place = 1 AND gain > 0)
SELECT plot_id, arg_max(used, step) AS frames, max(bit_count(have))::int AS covered FROM cover GROUP BY plot_id"""


@query("WITH RECURSIVE " + _frames_sql(_COVER).removeprefix("WITH "))
def set_cover(spark, sf_dir):
    return frames.cover_sets(ranked(spark, sf_dir))


# ---------------------------------------------------------------- geometry


@query(with_views("plots", body="SELECT plot_id, round((x1 - x0) * (y1 - y0), 6) AS area FROM plots"))
def plot_area_shoelace(spark, sf_dir):
    return derive.rings(derive.plots(spark, sf_dir)).select("plot_id", F.round(geo.ring_area(F.col("ring")), 6).alias("area"))


@query(_frames_sql("SELECT plot_id, camera, round(cov, 6) AS coverage FROM scored"))
def coverage_by_clipping(spark, sf_dir):
    pairs = frames.box_join(derive.plots(spark, sf_dir), derive.cameras(spark, sf_dir))
    boxes = pairs.withColumns({"a": F.col("x0") - F.col("fx0"), "b": F.col("y0") - F.col("fy0"), "c": F.col("x1") - F.col("fx0"), "d": F.col("y1") - F.col("fy0")})
    r = derive.rings(boxes, ("a", "b", "c", "d"))
    return r.select("plot_id", "camera", F.round(geo.frame_coverage(F.col("ring"), F.col("fx1") - F.col("fx0"), F.col("fy1") - F.col("fy0")), 6).alias("coverage"))


@query(with_views("plots", body="""SELECT plot_id, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(least(x1 - x0, y1 - y0) / 2, 6) AS short, round(greatest(x1 - x0, y1 - y0) / 2, 6) AS long FROM plots"""))
def plot_frame_minrect(spark, sf_dir):
    f = derive.rings(derive.plots(spark, sf_dir)).select("plot_id", geo.min_area_frame(F.col("ring")).alias("f"))
    r = lambda c: F.round(c, 6)
    return f.select("plot_id", r(F.col("f.cx")).alias("cx"), r(F.col("f.cy")).alias("cy"), r(F.least("f.hl", "f.hw")).alias("short"), r(F.greatest("f.hl", "f.hw")).alias("long"))


@query(with_views("plots", "cameras", body="""SELECT camera, count(*) AS plots FROM cameras JOIN plots
  ON (x0 + x1) / 2 >= fx0 AND (x0 + x1) / 2 < fx1 AND (y0 + y1) / 2 >= fy0 AND (y0 + y1) / 2 < fy1 GROUP BY camera"""))
def ring_pip(spark, sf_dir):
    pairs = frames.box_join(derive.plots(spark, sf_dir), derive.cameras(spark, sf_dir))
    r = derive.rings(pairs, ("fx0", "fy0", "fx1", "fy1"))
    inside = geo.contains(F.col("ring"), (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    return r.where(inside).groupBy("camera").agg(F.count("*").alias("plots"))


@query(with_views("plots", body="SELECT plot_id, round((x1 - x0 + 0.2::double) * (y1 - y0 + 0.2::double), 6) AS area FROM plots"))
def plot_margin_mitre(spark, sf_dir):
    return derive.rings(derive.plots(spark, sf_dir)).select("plot_id", F.round(geo.ring_area(geo.mitre_buffer(F.col("ring"), 0.1)), 6).alias("area"))


@query(with_views("plots", body="""SELECT plot_id, round((x1 - x0) * (y1 - y0) * (1 + 0.1::double / (sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 2)) ** 2, 6) AS area FROM plots"""))
def plot_margin_radial(spark, sf_dir):
    return derive.rings(derive.plots(spark, sf_dir)).select("plot_id", F.round(geo.ring_area(geo.radial_push(F.col("ring"), 0.1)), 6).alias("area"))


@query(with_views("plots", body="""SELECT plot_id, i, j, round(x0 + (x1 - x0) * i / 4.0::double, 6) AS x, round(y0 + (y1 - y0) * j / 4.0::double, 6) AS y
  FROM plots, range(5) a(i), range(5) b(j)"""))
def mesh_nodes(spark, sf_dir):
    grid = derive.rings(derive.plots(spark, sf_dir)).select("plot_id", "ring", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    p = grid.select("plot_id", "i", "j", geo.bilinear(F.col("ring"), F.col("i") / 4, F.col("j") / 4).alias("p"))
    return p.select("plot_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("SELECT c_custkey, round(c_acctbal / 60 - 90, 6) AS lon, CASE WHEN lon >= 112 AND lon <= 154 AND lat >= -44 AND lat <= -9 THEN 7800 + z WHEN lat >= 0 THEN 32600 + z ELSE 32700 + z END AS epsg FROM (SELECT *, (floor((lon + 180) / 6) + 1)::int AS z FROM (SELECT c_custkey, c_acctbal, c_acctbal / 60 - 90 AS lon, c_nationkey * 6.0::double - 70 AS lat FROM customer))")
def utm_zone(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    lon, lat = F.col("c_acctbal") / 60 - 90, F.col("c_nationkey") * 6.0 - 70
    return t.select("c_custkey", F.round(lon, 6).alias("lon"), labels.utm_epsg(lon, lat).alias("epsg"))


@query("""WITH p AS (SELECT o_custkey AS g, o_orderkey % 97 AS col, o_orderkey % 89 AS row FROM orders),
q AS (SELECT *, 2.5::double * col - 0.5::double * row + 10 AS x, 0.25::double * col + 3.0::double * row - 7 AS y FROM p),
n AS (SELECT g, count(*) AS n, count(*) * sum(col * col) - sum(col) * sum(col) AS cc, count(*) * sum(row * row) - sum(row) * sum(row) AS rr, count(*) * sum(col * row) - sum(col) * sum(row) AS cr FROM q GROUP BY g)
SELECT g, n, 2.5::double AS a, -0.5::double AS b, 10.0::double AS c, 0.25::double AS d, 3.0::double AS e, -7.0::double AS f FROM n WHERE n >= 3 AND cc * rr - cr * cr > 1e-3""")
def affine_fit(spark, sf_dir):
    col, row = F.col("o_orderkey") % 97, F.col("o_orderkey") % 89
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), col.alias("col"), row.alias("row"), (2.5 * col - 0.5 * row + 10).alias("x"), (0.25 * col + 3.0 * row - 7).alias("y"))
    fit = checks.affine_fit(p, "g").where("a is not null")
    return fit.select("g", "n", *[F.round(k, 6).alias(k) for k in "abcdef"])


# ---------------------------------------------------------------- grids, rows, tiles

_BANKS = "banks AS (SELECT s_suppkey AS b, 3 + s_nationkey AS n FROM supplier)"


def _banks(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), (3 + F.col("s_nationkey")).alias("n"))


@query(f"""WITH {_BANKS} SELECT (b + 1) * 1000 + r + 1 AS Plot_ID, 'Rg' || (b + 1) || 'Rw' || (r + 1) AS label, round(r * 1.5::double, 6) AS x0, round(b * 4.8::double, 6) AS y0,
  round(r * 1.5::double + 1.2::double, 6) AS x1, round(b * 4.8::double + 4.2::double, 6) AS y1 FROM banks, LATERAL (SELECT unnest(range(n)) AS r)""")
def grid_generate_exact(spark, sf_dir):
    g = layout.grid_of(_banks(spark, sf_dir), 1.2, 4.2, 0.3, 0.6)
    r = lambda c: F.round(c, 6).alias(c)
    return g.select(labels.plot_number(F.col("b"), F.col("r")).alias("Plot_ID"), labels.plot_label(F.col("b"), F.col("r").cast("long")).alias("label"), r("x0"), r("y0"), r("x1"), r("y1"))


@query(f"""WITH {_BANKS} SELECT b, r, round(r * 1.5::double / (n + (n - 1) * 0.5::double), 9) AS lo, round((r * 1.5::double + 1) / (n + (n - 1) * 0.5::double), 9) AS hi
  FROM banks, LATERAL (SELECT unnest(range(n)) AS r)""")
def grid_generate_fit(spark, sf_dir):
    s = _banks(spark, sf_dir).select("b", F.posexplode(layout.slot_edges(F.col("n").cast("int"), 1.0, 0.5)).alias("r", "s"))
    return s.select("b", F.col("r").cast("long").alias("r"), F.round("s.lo", 9).alias("lo"), F.round("s.hi", 9).alias("hi"))


@query(with_views("plots", body="SELECT plot_id, k + 1 AS row_idx, round((k - (n - 1) / 2.0::double) * (x1 - x0) / n, 6) AS v FROM (SELECT *, 3 + plot_id % 5 AS n FROM plots), LATERAL (SELECT unnest(range(n)) AS k)"))
def rows_from_count(spark, sf_dir):
    p = derive.plots(spark, sf_dir).select("plot_id", (F.col("x1") - F.col("x0")).alias("width"), (3 + F.col("plot_id") % 5).alias("n"))
    return layout.rows_from_count(p).select("plot_id", F.col("row_idx").cast("long").alias("row_idx"), F.round("v", 6).alias("v"))


_LINES = "lines AS (SELECT o_custkey AS plot_id, o_orderkey AS ord, round(o_totalprice % 1000, 2) AS v FROM orders)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plot_id"), F.col("o_orderkey").alias("ord"), F.round(F.col("o_totalprice") % 1000, 2).alias("v"))


@query(f"WITH {_LINES} SELECT plot_id, ord, v, (row_number() OVER (PARTITION BY plot_id ORDER BY v, ord))::int AS row_idx FROM lines")
def rows_renumber(spark, sf_dir):
    return layout.renumber(_lines(spark, sf_dir), "plot_id", "v", "ord")


@query(f"""WITH {_LINES} SELECT plot_id, ord, round(CASE WHEN n < 3 THEN v ELSE lo + (hi - lo) * k / (n - 1) END, 6) AS v_even FROM (
  SELECT *, row_number() OVER (PARTITION BY plot_id ORDER BY v, ord) - 1 AS k, count(*) OVER (PARTITION BY plot_id) AS n, min(v) OVER (PARTITION BY plot_id) AS lo, max(v) OVER (PARTITION BY plot_id) AS hi FROM lines)""")
def rows_even_spacing(spark, sf_dir):
    return layout.even_spacing(_lines(spark, sf_dir), "plot_id", "v", "ord").select("plot_id", "ord", F.round("v_even", 6).alias("v_even"))


@query(f"""WITH {_LINES}, d AS (SELECT *, v - lag(v) OVER (PARTITION BY plot_id ORDER BY v, ord) AS gap FROM lines)
  SELECT plot_id, count(*) AS n_rows, round(median(gap), 6) AS spacing, string_agg(v::decimal(12,2)::varchar, ' ' ORDER BY v, ord) AS rows_v FROM d GROUP BY plot_id""")
def rows_summary(spark, sf_dir):
    from pyspark.sql import Window

    gap = F.col("v") - F.lag("v").over(Window.partitionBy("plot_id").orderBy("v", "ord"))
    d = _lines(spark, sf_dir).withColumn("gap", gap)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("v", "ord"))), lambda x: x.v.cast("decimal(12,2)").cast("string"))
    return d.groupBy("plot_id").agg(F.count("*").alias("n_rows"), F.round(F.median("gap"), 6).alias("spacing"), F.array_join(texts, " ").alias("rows_v"))


_CROPS = "crops AS (SELECT s_suppkey AS id, 300 + 97 * s_nationkey AS w, 900 + 61 * (s_suppkey % 37) AS h FROM supplier)"


def _crops(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (300 + 97 * F.col("s_nationkey")).cast("int").alias("w"), (900 + 61 * (F.col("s_suppkey") % 37)).cast("int").alias("h"))


_STARTS = "list_distinct(list_append(list_filter(range(0, greatest({n} - 1024, 0) + 1, 768), lambda s: s = 0 OR s <= {n} - 1024), greatest({n} - 1024, 0)))"


@query(f"""WITH {_CROPS}, xs AS (SELECT *, unnest(list_sort({_STARTS.format(n="w")})) AS x FROM crops), ys AS (SELECT *, unnest(list_sort({_STARTS.format(n="h")})) AS y FROM xs)
  SELECT id, dense_rank() OVER (PARTITION BY id ORDER BY x) - 1 AS col, dense_rank() OVER (PARTITION BY id ORDER BY y) - 1 AS row, x, y, least(1024, w - x) AS tw, least(1024, h - y) AS th FROM ys WHERE least(1024, w - x) >= 512 AND least(1024, h - y) >= 512""")
def tiles_plain_grid(spark, sf_dir):
    t = layout.tile_grid(_crops(spark, sf_dir), 1024, 768)
    return t.select("id", *[F.col(c).cast("long").alias(c) for c in ("col", "row", "x", "y", "tw", "th")])


@query("""WITH s AS (SELECT s_suppkey AS id, 800 + 300 * s_nationkey AS span FROM supplier), n AS (SELECT *, (span - 1000) // 750 + 1 AS n FROM s WHERE span >= 1000)
  SELECT id, k AS tile_k, (span - ((n - 1) * 750 + 1000)) // 2 + k * 750 AS start FROM n, LATERAL (SELECT unnest(range(n)) AS k)""")
def row_tiles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (800 + 300 * F.col("s_nationkey")).alias("span"))
    return layout.row_tiles(s, 1000, 750).select("id", F.col("tile_k").cast("long").alias("tile_k"), F.col("start").cast("long").alias("start"))


@query("""WITH c AS (SELECT p_partkey AS id, 0.5::double + p_size / 100.0::double AS mm FROM part), m AS (SELECT median(mm) AS med FROM c),
  o AS (SELECT mm AS scale FROM c, m ORDER BY abs(mm - med), id LIMIT 1)
  SELECT id, round(mm, 6) AS src_mm_px, round(scale, 6) AS out_mm_px, floor(1000 / scale + 0.5)::bigint AS out_px, round(floor(1000 / scale + 0.5) * scale / mm, 6) AS window_px, mm <> scale AS resampled FROM c, o""")
def tiles_ground(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (0.5 + F.col("p_size") / 100.0).alias("mm"))
    out = checks.crossed(c, checks.nearest_to_median(c, "mm", "id"))
    px = F.floor(1000 / F.col("chosen") + 0.5)
    return out.select("id", F.round("mm", 6).alias("src_mm_px"), F.round("chosen", 6).alias("out_mm_px"), px.cast("long").alias("out_px"), F.round(px * F.col("chosen") / F.col("mm"), 6).alias("window_px"), (F.col("mm") != F.col("chosen")).alias("resampled"))


@query("""WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  k AS (SELECT *, unnest(range(6)) AS j FROM c) SELECT DISTINCT user_id, event_id FROM k
  WHERE n <= 6 OR i = CASE WHEN (j * (n - 1)) % 5 * 2 = 5 THEN 2 * round((j * (n - 1)) / 10.0) ELSE round(j * (n - 1) / 5.0) END""")
def tiles_pick_spread(spark, sf_dir):
    return layout.spread_pick(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 6)


@query()
def tiles_pick_hash(spark, sf_dir):
    return layout.hash_pick(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 6)


# ---------------------------------------------------------------- run-wide statistics


@query("WITH c AS (SELECT p_partkey AS id, p_retailprice AS v FROM part), m AS (SELECT median(v) AS med FROM c) SELECT round(med, 6) AS median, (SELECT v FROM c, m ORDER BY abs(v - med), id LIMIT 1) AS chosen FROM m")
def output_scale_nearest_median(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    return checks.nearest_to_median(c, "v", "id").select(F.round("median", 6).alias("median"), "chosen")


@query(with_views("rows_report", body="SELECT round(median(pitch_mm), 6) AS pitch, round(min(pitch_mm), 6) AS lo, round(max(pitch_mm), 6) AS hi, round(stddev_pop(pitch_mm), 4) AS sd, count(*) AS n FROM rows_report WHERE ok"))
def pitch_median(spark, sf_dir):
    p = derive.rows_report(spark, sf_dir).where("ok")
    return p.agg(F.round(F.median("pitch_mm"), 6).alias("pitch"), F.round(F.min("pitch_mm"), 6).alias("lo"), F.round(F.max("pitch_mm"), 6).alias("hi"), F.round(F.stddev_pop("pitch_mm"), 4).alias("sd"), F.count("*").alias("n"))


@query("""SELECT o_custkey, rows_found AS mode FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) AS k FROM (
  SELECT o_custkey, 3 + o_orderkey % 5 AS rows_found, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2)) WHERE k = 1""")
def rows_mode_first_seen(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_custkey", (3 + F.col("o_orderkey") % 5).alias("rows_found"), "o_orderkey")
    return checks.mode_first_seen(t, "rows_found", "o_orderkey", ["o_custkey"])


@query("""SELECT o_custkey, rows_found AS mode FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, rows_found) AS k FROM (
  SELECT o_custkey, 3 + o_orderkey % 5 AS rows_found, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE k = 1""")
def rows_mode_smallest(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_custkey", (3 + F.col("o_orderkey") % 5).alias("rows_found"))
    return checks.mode_smallest(t, "rows_found", ["o_custkey"])


@query(with_views("rows_report", body="SELECT plot_stem, round(pitch_mm / m, 6) AS ratio, abs(pitch_mm / m - 1) > 0.08 AS outlier FROM rows_report, (SELECT median(pitch_mm) AS m FROM rows_report)"))
def row_spacing_outliers(spark, sf_dir):
    return checks.spacing_outliers(derive.rows_report(spark, sf_dir), "pitch_mm").select("plot_stem", "ratio", "outlier")


@query(with_views("rows_report", body="""SELECT plot_stem, flags FROM (SELECT plot_stem, concat_ws('; ', CASE WHEN NOT ok THEN 'rows not measured' END,
  CASE WHEN ok AND rows_found <> usual THEN rows_found || ' rows, usually ' || usual END, CASE WHEN ok AND abs(pitch_mm / m - 1) > 0.08 THEN 'row spacing off' END) AS flags
  FROM rows_report, (SELECT median(pitch_mm) AS m FROM rows_report), (SELECT rows_found AS usual FROM rows_report WHERE ok GROUP BY 1 ORDER BY count(*) DESC, min(ord) LIMIT 1)) WHERE flags <> ''"""))
def qa_rows_flags(spark, sf_dir):
    return checks.row_flags(derive.rows_report(spark, sf_dir))


@query("""WITH g AS (SELECT o_custkey AS plot_id, (o_totalprice % 90) - 45 AS off, o_orderkey % 60 AS err, o_orderstatus <> 'P' AS clean FROM orders),
  r AS (SELECT CASE WHEN count(*) >= 20 THEN median(off) ELSE 0 END AS gl FROM g WHERE clean)
  SELECT plot_id, round(off, 4) AS off, round(gl, 4) AS global_mm, round(off - gl, 4) AS resid_mm, a AS action, round(gl + CASE WHEN a = 'shifted' THEN off - gl ELSE 0 END, 4) AS shift_mm
  FROM (SELECT *, CASE WHEN err > 0.18::double * 216 THEN 'irregular' WHEN abs(off - gl) > 0.15::double * 216 THEN 'large_residual' ELSE 'shifted' END AS a FROM g, r)""")
def refit_offsets(spark, sf_dir):
    g = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plot_id"), (F.col("o_totalprice") % 90 - 45).alias("offset"), (F.col("o_orderkey") % 60).alias("gap_err"), (F.col("o_orderstatus") != "P").alias("clean"))
    r = lambda c, n: F.round(c, 4).alias(n)
    return checks.refit(g, 216, 0.15).select("plot_id", r("offset", "off"), r("global_mm", "global_mm"), r("resid_mm", "resid_mm"), "action", r("shift_mm", "shift_mm"))


# ---------------------------------------------------------------- checks


@query(with_views("tiles", "rows_report", body="""SELECT t.plot_stem, tile_k, t.x0, t.y0, h, ok, rows_found, CASE WHEN lo IS NULL THEN NULL ELSE y0 >= lo - 1 AND y0 + h <= hi + 1 END AS in_usable_length
  FROM tiles t LEFT JOIN (SELECT plot_stem, ok, rows_found, ord % 7 AS lo, 20 + ord % 90 AS hi FROM rows_report WHERE ok) r USING (plot_stem)"""))
def qa_usable_length(spark, sf_dir):
    report = derive.rows_report(spark, sf_dir).where("ok").select("plot_stem", "ord", "ok", "rows_found", (F.col("ord") % 7).alias("usable_lo"), (20 + F.col("ord") % 90).alias("usable_hi"))
    tiles = derive.tiles(spark, sf_dir).join(report.select("plot_stem", "ok", "rows_found"), "plot_stem", "left")
    return checks.usable_tiles(tiles, report).select("plot_stem", "tile_k", "x0", "y0", "h", "ok", "rows_found", "in_usable_length")


@query(with_views("tiles", body="""SELECT result, count(*) AS n, count(DISTINCT plot_stem) AS plots FROM (SELECT plot_stem, CASE WHEN veg_pct < 1 THEN 'MISSING' WHEN x0 % 5 = 0 THEN 'RESAMPLED' WHEN y0 % 3 = 0 THEN 'NO SOURCE' ELSE 'IDENTICAL' END AS result FROM tiles) GROUP BY 1"""))
def qa_result_counts(spark, sf_dir):
    t = derive.tiles(spark, sf_dir)
    result = F.when(F.col("veg_pct") < 1, "MISSING").when(F.col("x0") % 5 == 0, "RESAMPLED").when(F.col("y0") % 3 == 0, "NO SOURCE").otherwise("IDENTICAL")
    return t.select("plot_stem", result.alias("result")).groupBy("result").agg(F.count("*").alias("n"), F.countDistinct("plot_stem").alias("plots"))


@query(with_views("tiles", body="SELECT min(n) AS least, max(n) AS most, count(*) AS plots, sum(n)::bigint AS tiles FROM (SELECT plot_stem, count(*) AS n FROM tiles GROUP BY 1)"))
def tiles_per_plot(spark, sf_dir):
    per = derive.tiles(spark, sf_dir).groupBy("plot_stem").agg(F.count("*").alias("n"))
    return per.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("plots"), F.sum("n").alias("tiles"))


@query(with_views("patches", body="""SELECT p.vec_id AS raster_id, count(*) FILTER (crop > 0) AS inside, count(*) FILTER (crop > 0 AND crop = s.value) AS identical, max(CASE WHEN crop > 0 THEN abs(crop - s.value) END) AS max_diff,
  CASE WHEN count(*) FILTER (crop > 0) = count(*) FILTER (crop > 0 AND crop = s.value) THEN 'IDENTICAL' ELSE 'FAIL' END AS result
  FROM (SELECT vec_id, row, col, CASE WHEN vec_id % 10 = 3 AND row = 1 AND col = 2 THEN value + 1 ELSE value END AS crop FROM patches WHERE row < 6 AND col < 5) p
  JOIN patches s ON s.vec_id = p.vec_id AND s.row = p.row AND s.col = p.col GROUP BY 1"""))
def pixel_identity(spark, sf_dir):
    source = derive.patches(spark, sf_dir).withColumnRenamed("vec_id", "source_id")
    touched = (F.col("vec_id") % 10 == 3) & (F.col("row") == 1) & (F.col("col") == 2)
    crop = derive.patches(spark, sf_dir).where("row < 6 and col < 5").select(F.col("vec_id").alias("raster_id"), (F.col("row") - 2).alias("row"), (F.col("col") - 1).alias("col"), F.when(touched, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    boxes = derive.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster_id"), F.col("vec_id").alias("source_id"), F.lit(1).alias("x0"), F.lit(2).alias("y0"))
    return checks.compare_pixels(crop, source, boxes)


@query(with_views("patches", body="SELECT vec_id, round(100 * avg((value > 130)::int), 4) AS veg_pct, round(avg((value > 4)::int), 4) AS valid, avg((value > 4)::int) < 0.5 AS dropped FROM patches GROUP BY 1"))
def veg_and_valid_share(spark, sf_dir):
    share = lambda c: F.avg(c.cast("int"))
    valid = share(F.col("value") > 4)
    return derive.patches(spark, sf_dir).groupBy("vec_id").agg(F.round(100 * share(F.col("value") > 130), 4).alias("veg_pct"), F.round(valid, 4).alias("valid"), (valid < 0.5).alias("dropped"))


@query(with_views("patches", body="SELECT vec_id, row, col, value, ((value * 257 + 128) // 257)::int AS back, value * 257 AS wide, (floor((value * 255 + 128) / 257.0))::int AS narrow FROM patches"))
def bit_depth_roundtrip(spark, sf_dir):
    p = derive.patches(spark, sf_dir)
    return p.select("vec_id", "row", F.col("col").cast("long").alias("col"), "value", labels.to_8_bit(labels.to_16_bit(F.col("value"))).alias("back"), labels.to_16_bit(F.col("value")).alias("wide"), labels.to_8_bit(F.col("value") * 255).alias("narrow"))


@query(with_views("patches", body="SELECT vec_id, 7 - col AS row, row AS col, value FROM patches"))
def tile_rotate90(spark, sf_dir):
    return checks.quarter_turn(derive.patches(spark, sf_dir), 8).select("vec_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")


@query(with_views("patches", body="SELECT vec_id // 4 AS plot, row, col + (vec_id % 4) * 4 AS x, arg_max(value, vec_id) AS value FROM patches GROUP BY 1, 2, 3"))
def stitch_last_wins(spark, sf_dir):
    p = derive.patches(spark, sf_dir).select(F.expr("vec_id div 4").alias("plot"), "row", (F.col("col") + (F.col("vec_id") % 4) * 4).alias("x"), "value", "vec_id")
    return checks.stitch(p, "plot", "row", "x", "value", "vec_id")


# ---------------------------------------------------------------- signals


@query(with_views("profile", body="SELECT vec_id, i, round(sum(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM profile"))
def moving_average_same(spark, sf_dir):
    return signal.moving_sum_share(derive.profile(spark, sf_dir), "vec_id", "i", "v", 5).select("vec_id", F.col("i").cast("long").alias("i"), F.round("smooth", 6).alias("smooth"))


@query(with_views("profile", body="SELECT vec_id, i, round(v, 6) AS v FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM profile WINDOW w AS (PARTITION BY vec_id ORDER BY i)) WHERE v >= a AND v > b"))
def local_maxima(spark, sf_dir):
    return signal.local_maxima(derive.profile(spark, sf_dir), "vec_id", "i", "v").select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query(with_views("profile", body="""SELECT vec_id, round(arg_max(mid, (between_, -bin)), 6) AS threshold FROM (
  SELECT *, round(coalesce(w0 * nullif(w - w0, 0) * (s0 / w0 - (s - s0) / nullif(w - w0, 0)) ** 2, 0), 6) AS between_ FROM (
  SELECT vec_id, bin, mid, sum(n) OVER u AS w0, sum(n) OVER a AS w, sum(n * mid) OVER u AS s0, sum(n * mid) OVER a AS s FROM (
    SELECT vec_id, bin, lo + (bin + 0.5::double) * ((hi - lo) / 256) AS mid, count(*) AS n FROM (
      SELECT vec_id, lo, hi, least(255, floor((v - lo) / ((hi - lo) / 256)))::int AS bin FROM profile
      JOIN (SELECT vec_id, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM profile GROUP BY 1) USING (vec_id) WHERE v BETWEEN lo AND hi) GROUP BY vec_id, bin, lo, hi)
  WINDOW u AS (PARTITION BY vec_id ORDER BY bin), a AS (PARTITION BY vec_id))) GROUP BY vec_id"""))
def otsu_threshold(spark, sf_dir):
    return signal.otsu(derive.profile(spark, sf_dir), "vec_id", "v")


_PERIODS = [4 + 0.5 * k for k in range(25)]


@query(with_views("profile", body=f"""SELECT vec_id, arg_max(period, (power, -period)) AS period, max(power) AS power FROM (
  SELECT vec_id, period, round(sum(s * cos(2 * {math.pi!r}::double * i / period)) ** 2 + sum(s * sin(2 * {math.pi!r}::double * i / period)) ** 2, 6) AS power FROM (
  SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS s, unnest({_PERIODS!r}::double[]) AS period FROM profile) GROUP BY 1, 2) GROUP BY 1"""))
def periodogram_argmax(spark, sf_dir):
    return signal.strongest_period(derive.profile(spark, sf_dir), "vec_id", "i", "v", _PERIODS)


@query(with_views("profile", body="""SELECT vec_id, arg_max(phase, (contrast, -phase)) AS phase, max(contrast) AS contrast FROM (SELECT vec_id, phase,
  round(avg(CASE WHEN (i - phase + 8) % 8 = 0 THEN v END) - avg(CASE WHEN (i - phase + 8) % 8 = 4 THEN v END), 9) AS contrast FROM (SELECT *, unnest(range(8)) AS phase FROM profile) GROUP BY 1, 2) GROUP BY 1"""))
def comb_fit(spark, sf_dir):
    return signal.comb_fit(derive.profile(spark, sf_dir), "vec_id", "i", "v", 8).select("vec_id", F.col("phase").cast("long").alias("phase"), "contrast")


@query(with_views("profile", body="""SELECT vec_id, unnest(taken)::int AS i, v[unnest(taken) + 1] AS v FROM (
  SELECT vec_id, v, list_reduce(list_transform(list_sort(list_transform(found, lambda i: struct_pack(h := -v[i + 1], i := i))), lambda x: [x.i]),
    lambda a, x: CASE WHEN len(list_filter(a, lambda j: abs(j - x[1]) < 4)) > 0 THEN a ELSE list_concat(a, x) END, []::bigint[]) AS taken FROM (
  SELECT vec_id, v, list_filter(range(1, 63), lambda i: v[i + 1] >= v[i] AND v[i + 1] > v[i + 2]
    AND v[i + 1] - greatest(list_min(v[greatest(0, i - 4) + 1:i]), list_min(v[i + 2:least(64, i + 5)])) >= 0.05::double) AS found FROM (SELECT vec_id, list(v ORDER BY i) AS v FROM profile GROUP BY 1)))"""))
def peak_nms(spark, sf_dir):
    return signal.peaks_of(derive.profile(spark, sf_dir), "vec_id", "i", "v", 4, 0.05)


@query(with_views("profile", body="""SELECT vec_id, arg_min(i, (score, i)) AS start, min(score) AS score FROM (SELECT vec_id, i, round(3 * avg(gap) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) + abs((pos + last) / 2 - 320), 6) AS score, last FROM (
  SELECT vec_id, i, pos, abs(pos - lag(pos) OVER w - 10) AS gap, lead(pos, 2) OVER w AS last FROM (SELECT vec_id, i, 10 * i + round(v, 4) AS pos FROM profile) WINDOW w AS (PARTITION BY vec_id ORDER BY i))) WHERE last IS NOT NULL GROUP BY 1"""))
def block_choice_regular_gaps(spark, sf_dir):
    p = derive.profile(spark, sf_dir).select("vec_id", F.col("i").cast("long").alias("i"), (10 * F.col("i") + F.round("v", 4)).alias("pos"))
    return checks.block_choice(p, "vec_id", "i", "pos", 3, F.lit(10), F.lit(320))


# ---------------------------------------------------------------- labels, lookups, records


@query(r"""SELECT page_id, CASE WHEN trim(url) = '' THEN 'unnamed' ELSE regexp_replace(trim(url), '[^\p{L}\p{N}\-_.]', '_', 'g') END AS name FROM pages""")
def safe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", labels.safe_name(F.col("url")).alias("name"))


@query("""SELECT o_orderkey, b || '-' || (b + c) || ',' || a AS spec, CASE WHEN c = 1 THEN 'middle' ELSE 'list' END AS mode, CASE WHEN c = 1 THEN a END AS n,
  CASE WHEN c <> 1 THEN array_to_string(list_sort(list_distinct(list_concat([a::bigint], range(b, b + c + 1)))), ' ') END AS rows_ FROM (
  SELECT o_orderkey, (1 + o_orderkey % 4)::int AS a, (2 + o_custkey % 5)::int AS b, (o_orderkey % 5 - 2)::int AS c FROM orders)""")
def row_spec_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 4).cast("int").alias("a"), (2 + F.col("o_custkey") % 5).alias("b"), (F.col("o_orderkey") % 5 - 2).alias("c"))
    spec = F.concat_ws("", F.col("b"), F.lit("-"), F.col("b") + F.col("c"), F.lit(","), F.col("a"))
    chosen = labels.row_spec(F.when(F.col("c") == 1, F.concat(F.lit("middle "), F.col("a").cast("string"))).otherwise(spec))
    return o.select("o_orderkey", spec.alias("spec"), chosen.alias("r")).select("o_orderkey", "spec", "r.mode", "r.n", F.array_join("r.rows", " ").alias("rows_"))


@query("""WITH k AS (SELECT o_orderkey AS id, o_orderkey % 5000 AS key, 1 AS prio FROM orders UNION ALL SELECT o_orderkey, o_custkey % 700, 2 FROM orders),
  x AS (SELECT p_partkey * 3 AS key, min_by(p_name, p_partkey) AS path FROM part GROUP BY 1), f AS (SELECT id, path, prio FROM k JOIN x USING (key))
  SELECT a.id, min_by(f.path, f.prio) AS path, min(f.prio) AS prio FROM (SELECT DISTINCT id FROM k) a LEFT JOIN f USING (id) GROUP BY 1""")
def lookup_ordered_keys(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    keys = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5000).alias("key"), F.lit(1).alias("prio")).union(o.select("o_orderkey", F.col("o_custkey") % 700, F.lit(2)))
    return frames.by_priority(keys, p.select((F.col("p_partkey") * 3).alias("key"), F.col("p_name").alias("path"), F.col("p_partkey").alias("ord")))


@query("""SELECT coalesce(a.id, b.id) AS id, coalesce(n_rows, 0) AS n_rows, coalesce(note, '') AS note FROM (SELECT o_custkey AS id, count(*) AS n_rows FROM orders GROUP BY 1) a
  FULL JOIN (SELECT c_custkey + 100 AS id, 'not measured' AS note FROM customer) b ON a.id = b.id""")
def full_outer_summary(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_rows"))
    b = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 100).alias("id"), F.lit("not measured").alias("note"))
    return a.join(b, "id", "full").select("id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("note", F.lit("")).alias("note"))


@query("""SELECT 'f' || o_orderkey AS path, o_orderstatus = 'P' AS gone FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 250000""")
def snapshot_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path")
    before = o.select(path, F.col("o_custkey").alias("length"), F.col("o_orderdate").alias("modified"))
    after = o.where("o_orderstatus <> 'P'").select(path, (F.col("o_custkey") + (F.col("o_totalprice") > 250000).cast("int")).alias("length"), F.col("o_orderdate").alias("modified"))
    return checks.changed_files(before, after)


@query("""SELECT 's' || o_orderkey AS section, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS body FROM orders""")
def recipe_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("section")
    return checks.upsert_sections(o.select(name, F.lit("old").alias("body")), o.where("o_orderstatus = 'F'").select(name, F.lit("new").alias("body")))


@query("""SELECT user_id, string_agg(event_type, '; ' ORDER BY event_id) AS flags FROM events GROUP BY 1""")
def flags_joined(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return checks.flags_of(e.select(F.col("user_id").alias("plot"), F.col("event_id").alias("seq"), F.col("event_type").alias("flag"))).withColumnRenamed("plot", "user_id")


# ---------------------------------------------------------------- sources, edits, events


@query(with_views("plots", body="""SELECT plot_id, 4 AS corners, round(CASE WHEN plot_id % 2 = 0 THEN 4 ELSE 1 END * (x1 - x0) * (y1 - y0), 6) AS area, p_name AS name
  FROM plots JOIN part ON p_partkey = plot_id"""))
def geojson_polygons(spark, sf_dir):
    """Features written as text and read back; every other one has a second part, twice as large each way, which counts."""
    named = derive.plots(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("plot_id"), "p_name"), "plot_id")
    rings = derive.rings(named)
    feature = vector.geojson_feature(F.col("ring"), F.struct(F.col("p_name").alias("name")))
    one = F.get_json_object(feature, "$.geometry.coordinates")
    twice = F.to_json(F.array(F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda p: F.array(p.x * 2, p.y * 2))))
    several = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), one, F.lit(","), twice, F.lit("]}"))
    geometry = F.when(F.col("plot_id") % 2 == 0, several).otherwise(F.get_json_object(feature, "$.geometry"))
    back = rings.select("plot_id", vector.polygon_of(geometry).alias("ring"), F.get_json_object(feature, "$.properties.name").alias("name"))
    return back.select("plot_id", F.size("ring").alias("corners"), F.round(geo.ring_area("ring"), 6).alias("area"), "name")


@query("""SELECT CASE WHEN event_id % 5 = 0 THEN 'ERR' WHEN event_id % 2 = 0 THEN 'OK' ELSE 'INFO' END AS kind, event_id::int AS job,
  CASE WHEN event_id % 5 <> 0 THEN (100 + event_id % 900)::int END AS width, CASE WHEN event_id % 5 <> 0 THEN (200 + user_id)::int END AS height,
  CASE WHEN event_id % 5 <> 0 AND event_id % 2 = 0 THEN 16 END AS bits, CASE WHEN event_id % 5 = 0 THEN 'no ' || event_type END AS message FROM events""")
def helper_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    size = F.concat_ws(" ", "event_id", 100 + F.col("event_id") % 900, 200 + F.col("user_id"))
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("@@ERR "), F.col("event_id"), F.lit(" no "), F.col("event_type"))).when(F.col("event_id") % 2 == 0, F.concat(F.lit("@@OK "), size, F.lit(" 16"))).otherwise(F.concat(F.lit("@@INFO "), size, F.lit(" 7 7")))
    return records.helper_log(e.select(line.alias("value")))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events""")
def recipe_settings(spark, sf_dir):
    recipe = F.concat(F.lit('{"tiles":{"gui":'), F.coalesce("props", F.lit("null")), F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(records.recipe_section(recipe, "tiles"), F.lit("k")), F.lit("")).alias("k"))


@query(with_views("plots", body="""SELECT plot_id, round((x1 - x0 + CASE WHEN plot_id % 3 = 0 THEN 0.2::double ELSE 0 END) * (y1 - y0 + CASE WHEN plot_id % 3 = 0 THEN -0.5::double ELSE 0 END), 6) AS area,
  round(y0 + CASE WHEN plot_id % 3 = 0 THEN 0.25::double + 0.3::double ELSE 0 END, 6) AS low FROM plots"""))
def plots_edited(spark, sf_dir):
    """Every third plot shorter and wider, then shifted along its long axis."""
    plots = derive.rings(derive.plots(spark, sf_dir))
    chosen = plots.where("plot_id % 3 = 0").select("plot_id")
    done = edits.shift_along(edits.resize(plots.select("plot_id", "ring"), -0.5, 0.2, chosen), 0.3, False, chosen)
    return done.select("plot_id", F.round(geo.ring_area("ring"), 6).alias("area"), F.round(F.array_min(F.transform("ring", lambda p: p.y)), 6).alias("low"))


@query(with_views("plots", body="SELECT plot_id, round((x0 + x1) / 2 + 3, 6) AS cx, round((y0 + y1) / 2 - 1, 6) AS cy, round(2.25::double * (x1 - x0) * (y1 - y0), 6) AS area FROM plots"))
def plots_moved_and_scaled(spark, sf_dir):
    done = edits.scale(edits.move(derive.rings(derive.plots(spark, sf_dir)), 3.0, -1.0), 1.5)
    return done.select("plot_id", F.round(geo.centroid("ring").x, 6).alias("cx"), F.round(geo.centroid("ring").y, 6).alias("cy"), F.round(geo.ring_area("ring"), 6).alias("area"))


@query("""WITH l AS (SELECT o_custkey AS plot_id, o_orderkey AS ord, o_totalprice % 1000 AS v, (o_orderkey % 9) / 2.0::double AS angle FROM orders)
  SELECT plot_id, round(v, 4) AS v, round(angle, 4) AS angle, 'count' AS source, ord FROM l UNION ALL
  SELECT c_custkey, 500.0, round(coalesce(median(angle), 0), 4), 'edit', coalesce(max(ord), 0) + 1 FROM customer LEFT JOIN l ON plot_id = c_custkey GROUP BY c_custkey""")
def rows_added(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plot_id"), (F.col("o_totalprice") % 1000).alias("v"), ((F.col("o_orderkey") % 9) / 2).alias("angle"), F.lit("count").alias("source"), F.col("o_orderkey").alias("ord"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plot_id"), F.lit(500.0).alias("v"))
    return edits.add_row(rows, new).select("plot_id", F.round("v", 4).alias("v"), F.round("angle", 4).alias("angle"), "source", "ord")


@query()
def utm_coordinates(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    lon, lat = F.col("c_acctbal") / 60 - 90, F.col("c_nationkey") * 6.0 - 70
    zone = F.floor((lon + 180) / 6) + 1
    p = t.select("c_custkey", utm_forward(lon, lat, zone, lat < 0).alias("p"))
    return p.select("c_custkey", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    return landing.tumbling_counts(table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS end, user_id, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    form = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return landing.sessions(table(spark, sf_dir, "events")).select(form("start"), form("end"), "user_id", "n")


@query("""WITH g AS (SELECT l_orderkey AS g, l_linenumber AS k, (l_partkey % 97) * 20 AS col, (l_suppkey % 89) * 20 AS row, l_quantity::double / 1000 AS e FROM lineitem),
  p AS (SELECT a.g, sqrt((a.col - b.col) ** 2 + (a.row - b.row) ** 2) AS px, sqrt((0.006::double * (a.col - b.col) + a.e - b.e) ** 2 + (0.006::double * (a.row - b.row) - a.e + b.e) ** 2) AS m FROM g a JOIN g b ON a.g = b.g AND a.k < b.k)
  SELECT g, count(*) AS pairs, round(round(median(m / px), 9), 6) AS scale FROM p WHERE px >= 50 GROUP BY g""")
def gcp_scale_median(spark, sf_dir):
    """Ground metres for each pixel: the median over pairs of a crop's control points (an order's at most seven lines) that are 50 pixels apart."""
    li = table(spark, sf_dir, "lineitem")
    col, row, e = (F.col("l_partkey") % 97) * 20, (F.col("l_suppkey") % 89) * 20, F.col("l_quantity").cast("double") / 1000
    point = F.struct(F.col("l_linenumber").alias("k"), col.alias("col"), row.alias("row"), (0.006 * col + e).alias("x"), (0.006 * row - e).alias("y"))
    return rows.scale_of_points(li.groupBy(F.col("l_orderkey").alias("g")).agg(F.collect_list(point).alias("points")), "g", "points", 50.0).withColumn("scale", F.round("scale", 6))


# ---------------------------------------------------------------- rasters


def _halves(spark, sf_dir):
    """Pairs of patches as layers of one raster: the even one, then the odd one."""
    p = derive.patches(spark, sf_dir)
    return p.select(F.expr("vec_id div 2").alias("raster"), "row", "col", F.when((F.col("vec_id") % 2 == 0) & (F.col("row") + F.col("col") > 8), 0).otherwise(F.col("value")).alias("value"), (F.col("vec_id") % 2 + 1).alias("rank"), (1 + 0.7 * (F.expr("vec_id div 6") % 2 * (1 - F.col("vec_id") % 2))).alias("aniso"))


_HALVES = "halves AS (SELECT vec_id // 2 AS raster, row, col, CASE WHEN vec_id % 2 = 0 AND row + col > 8 THEN 0 ELSE value END AS value, vec_id % 2 + 1 AS rank, 1 + 0.7::double * ((vec_id // 6) % 2 * (1 - vec_id % 2)) AS aniso FROM patches)"


@query(with_views("patches", body="""SELECT p.vec_id, row, col, floor(255 * least(1, greatest(0, round((value - lo) / greatest(hi - lo, 1), 9))) + 0.5)::int AS shown
  FROM patches p JOIN (SELECT vec_id, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM patches GROUP BY 1) e USING (vec_id)"""))
def percentile_stretch(spark, sf_dir):
    return raster.stretch(derive.patches(spark, sf_dir), "vec_id").select("vec_id", "row", F.col("col").cast("long").alias("col"), "shown")


@query(with_views("patches", body="""SELECT vec_id, 0 AS level, row, col, value::double AS value FROM patches UNION ALL SELECT vec_id, 1, row // 2, col // 2, avg(value) FROM patches GROUP BY 1, 3, 4
  UNION ALL SELECT vec_id, 2, row // 4, col // 4, avg(value) FROM patches GROUP BY 1, 3, 4 UNION ALL SELECT vec_id, 3, 0, 0, avg(value) FROM patches GROUP BY 1"""))
def raster_pyramid(spark, sf_dir):
    return raster.pyramid(derive.patches(spark, sf_dir), "vec_id", 3)


@query(with_views("patches", body="SELECT vec_id, row - 2 AS row, col - 1 AS col, value FROM patches WHERE row BETWEEN 2 AND 6 AND col BETWEEN 1 AND 4"))
def box_crop(spark, sf_dir):
    return raster.crop(derive.patches(spark, sf_dir), 1, 2, 4, 5).select("vec_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")


@query(with_views("patches", body="") .rstrip() + ", " + _HALVES + """ SELECT raster, row, col, value, rank AS source FROM (SELECT *, row_number() OVER (PARTITION BY raster, row, col ORDER BY (aniso > 1.6)::int, rank) AS k FROM halves WHERE value > 0) WHERE k = 1""")
def multi_frame_fill(spark, sf_dir):
    return raster.filled(_halves(spark, sf_dir), "raster").select("raster", "row", F.col("col").cast("long").alias("col"), "value", F.col("source").cast("long").alias("source"))


@query(with_views("patches", body="") .rstrip() + ", " + _HALVES + """, f AS (SELECT raster, row, col, rank AS source FROM (SELECT *, row_number() OVER (PARTITION BY raster, row, col ORDER BY (aniso > 1.6)::int, rank) AS k FROM halves WHERE value > 0) WHERE k = 1)
  SELECT raster, median(row) AS seam, count(*) AS turns FROM (SELECT *, lag(source) OVER (PARTITION BY raster, col ORDER BY row) AS b FROM f) WHERE b IS NOT NULL AND b <> source GROUP BY 1""")
def seam_position(spark, sf_dir):
    return raster.seam_place(raster.filled(_halves(spark, sf_dir), "raster"), "raster")


@query(with_views("patches", body="""SELECT raster, n, round(CASE WHEN n > 20 THEN s ELSE 1 END, 6) AS scale, round(CASE WHEN n > 20 THEN mb - s * mo ELSE 0 END, 6) AS offset_ FROM (SELECT *, least(1.6, greatest(0.6, coalesce(sb / nullif(so, 0), 1))) AS s FROM (
  SELECT a.vec_id // 2 AS raster, count(*) AS n, avg(a.value) AS mb, avg(b.value) AS mo, stddev_pop(a.value) AS sb, stddev_pop(b.value) AS so FROM patches a JOIN patches b ON b.vec_id = a.vec_id + 1 AND b.row = a.row AND b.col = a.col WHERE a.vec_id % 2 = 0 GROUP BY 1))"""))
def radiometric_match(spark, sf_dir):
    p = derive.patches(spark, sf_dir)
    one = p.where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("raster"), "row", "col", F.col("value").alias("base"))
    two = p.where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("raster"), "row", "col", F.col("value").alias("other"))
    return raster.matched(one.join(two, ["raster", "row", "col"]), "raster", "base", "other", 20).select("raster", "n", F.round("scale", 6).alias("scale"), F.round("offset", 6).alias("offset_"))


@query(with_views("patches", body="""SELECT vec_id, round(avg(d), 6) AS mean_abs, round(quantile_cont(d, 0.99), 6) AS p99_abs, round(sqrt(avg(d * d)), 6) AS rms, round(avg((d > 0)::int), 6) AS changed, count(DISTINCT b) AS levels,
  round(20 * log10(255 / nullif(sqrt(avg(d * d)), 0)), 4) AS psnr FROM (SELECT vec_id, b, abs(value - b) AS d FROM (SELECT vec_id, value, value // 4 * 4 AS b FROM patches)) GROUP BY 1"""))
def format_difference(spark, sf_dir):
    p = derive.patches(spark, sf_dir).withColumn("b", F.expr("value div 4 * 4"))
    r = lambda c, n: F.round(c, n).alias(c)
    return raster.difference(p, "vec_id", "value", "b").select("vec_id", r("mean_abs", 6), r("p99_abs", 6), r("rms", 6), r("changed", 6), "levels", r("psnr", 4))


@query(with_views("patches", body="""SELECT vec_id, round(stddev_pop(l), 6) AS detail, count(*) AS n FROM (SELECT vec_id, lag(value) OVER a + lead(value) OVER a + lag(value) OVER d + lead(value) OVER d - 4 * value AS l
  FROM patches WINDOW a AS (PARTITION BY vec_id, row ORDER BY col), d AS (PARTITION BY vec_id, col ORDER BY row)) WHERE l IS NOT NULL GROUP BY 1"""))
def high_pass_detail(spark, sf_dir):
    return raster.detail(derive.patches(spark, sf_dir), "vec_id").select("vec_id", F.round("detail", 6).alias("detail"), "n")


@query(with_views("patches", body="""SELECT vec_id, col AS bin, count(*) FILTER (value > 4) AS n, CASE WHEN count(*) FILTER (value > 4) > 3 THEN round(avg((value > 128)::int::double) FILTER (value > 4), 6) END AS share,
  CASE WHEN count(*) FILTER (value > 4) > 3 THEN round(avg(value) FILTER (value > 4), 6) END AS mean FROM patches GROUP BY 1, 2"""))
def profile_across(spark, sf_dir):
    b = raster.profile_bins(derive.patches(spark, sf_dir), "vec_id", 128)
    return b.select("vec_id", F.col("bin").cast("long").alias("bin"), "n", F.round("share", 6).alias("share"), F.round("mean", 6).alias("mean"))


@query(with_views("profile", body="""SELECT vec_id, CASE WHEN b - a + 1 >= 32 THEN a ELSE 0 END AS lo, CASE WHEN b - a + 1 >= 32 THEN b ELSE 63 END AS hi FROM (SELECT p.vec_id, min(CASE WHEN v >= l THEN i END) AS a, max(CASE WHEN v >= l THEN i END) AS b
  FROM profile p JOIN (SELECT vec_id, 0.35::double * median(v) AS l FROM profile WHERE i BETWEEN 16 AND 47 GROUP BY 1) m USING (vec_id) GROUP BY 1)"""))
def usable_length(spark, sf_dir):
    u = raster.usable_length(derive.profile(spark, sf_dir), "vec_id", "i", "v")
    return u.select("vec_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


@query(with_views("tiles", body="""SELECT plot_stem, tile_k, x0, y0, CASE WHEN ok THEN sx + x0 END AS src_photo_x0, CASE WHEN ok THEN sy + y0 END AS src_photo_y0, CASE WHEN st IS NULL THEN 'no manifest row' WHEN NOT ok THEN 'not a plain copy' ELSE '' END AS link_note
  FROM (SELECT t.*, sx, sy, st, coalesce(st IN ('mask', 'bbox', 'native') AND fu = 1, false) AS ok FROM tiles t LEFT JOIN (SELECT o_orderkey + 40 AS plot_stem, o_custkey % 900 AS sx, o_custkey % 70 AS sy, CASE o_orderstatus WHEN 'F' THEN 'mask' WHEN 'O' THEN 'bbox' ELSE 'rectify' END AS st, 1 + o_orderkey % 2 AS fu FROM orders) USING (plot_stem))"""))
def tile_source_links(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    style = F.when(F.col("o_orderstatus") == "F", "mask").when(F.col("o_orderstatus") == "O", "bbox").otherwise("rectify")
    m = o.select((F.col("o_orderkey") + 40).alias("plot_stem"), style.alias("raw_style"), (1 + F.col("o_orderkey") % 2).alias("frames_used"), (F.col("o_custkey") % 900).alias("src_x0"), (F.col("o_custkey") % 70).alias("src_y0"), F.col("o_orderkey").alias("ord"))
    return raster.linked(derive.tiles(spark, sf_dir), m).select("plot_stem", "tile_k", "x0", "y0", "src_photo_x0", "src_photo_y0", "link_note")


@query(_frames_sql("""SELECT plot_id, camera, greatest(0, least(trunc(w), trunc(u0)))::int AS x0, greatest(0, least(trunc(h), trunc(v0)))::int AS y0, greatest(0, least(trunc(w), trunc(u1)))::int AS x1, greatest(0, least(trunc(h), trunc(v1)))::int AS y1 FROM ranked WHERE rank = 1"""))
def crop_boxes(spark, sf_dir):
    first = ranked(spark, sf_dir).where("rank = 1")
    px = first.withColumns({"a": (F.col("x0") - F.col("fx0")) * F.col("gsd"), "b": (F.col("y0") - F.col("fy0")) * F.col("gsd"), "c": (F.col("x1") - F.col("fx0")) * F.col("gsd"), "d": (F.col("y1") - F.col("fy0")) * F.col("gsd")})
    box = raster.crop_box(F.col("ring"), (F.col("fx1") - F.col("fx0")) * F.col("gsd"), (F.col("fy1") - F.col("fy0")) * F.col("gsd"))
    return derive.rings(px, ("a", "b", "c", "d")).select("plot_id", "camera", box.alias("box")).select("plot_id", "camera", "box.*")


# ---------------------------------------------------------------- row detection


_EDGE = "(sum(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING) + greatest(0, {b} - i) * first_value(v) OVER (PARTITION BY vec_id ORDER BY i) + greatest(0, {a} - (63 - i)) * first_value(v) OVER (PARTITION BY vec_id ORDER BY i DESC)) / {k}"


@query(with_views("profile", body=f"""SELECT vec_id, i, round(coalesce(r / nullif(stddev_pop(r) OVER (PARTITION BY vec_id), 0), 0), 5) AS signal FROM (
  SELECT vec_id, i, {_EDGE.format(b=2, a=1, k=4)} - {_EDGE.format(b=8, a=7, k=16)} AS r FROM profile)"""))
def ridge_signal(spark, sf_dir):
    r = rows.ridge(derive.profile(spark, sf_dir), "vec_id", "i", "v", 4, 16)
    return r.select("vec_id", F.col("i").cast("long").alias("i"), F.round("signal", 5).alias("signal"))


@query(with_views("profile", body=f"""SELECT vec_id, round(arg_max(pitch, (power, -k)), 6) AS pitch FROM (SELECT vec_id, k, pitch, round(sum(v * cos(2 * {math.pi!r}::double * i / pitch)) ** 2 + sum(v * sin(2 * {math.pi!r}::double * i / pitch)) ** 2, 5) AS power
  FROM (SELECT *, 8 * (0.94::double + k * (1.06::double - 0.94::double) / 40) AS pitch FROM (SELECT *, unnest(range(41)) AS k FROM profile)) GROUP BY 1, 2, 3) GROUP BY 1"""))
def pitch_refined(spark, sf_dir):
    return rows.fine_pitch(derive.profile(spark, sf_dir), "vec_id", "i", "v", F.lit(8.0), 41).select("vec_id", F.round("pitch", 6).alias("pitch"))


@query(with_views("profile", body="""SELECT vec_id, arg_max(i, (s, -i)) AS start, max(s) AS contrast FROM (SELECT vec_id, i, round(sum(v) OVER w, 6) AS s, count(v) OVER w AS n FROM (SELECT vec_id, i, CASE WHEN v > -0.2 THEN v END AS v FROM profile)
  WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5 GROUP BY 1"""))
def expected_rows_block(spark, sf_dir):
    p = derive.profile(spark, sf_dir).select("vec_id", F.col("i").cast("long").alias("i"), F.when(F.col("v") > -0.2, F.col("v")).alias("v"))
    return rows.best_block(p, "vec_id", "i", "v", 5)


@query(with_views("profile", body="""SELECT vec_id, arg_min(i, (round(abs(m - 300), 3), round(abs(m - al), 6), i)) AS start FROM (SELECT vec_id, i, (pos + lead(pos, 2) OVER (PARTITION BY vec_id ORDER BY i)) / 2 AS m, (min(pos) OVER (PARTITION BY vec_id) + max(pos) OVER (PARTITION BY vec_id)) / 2 AS al
  FROM (SELECT vec_id, i, 10 * i + round(v, 4) AS pos FROM profile)) WHERE m IS NOT NULL GROUP BY 1"""))
def middle_rows_block(spark, sf_dir):
    p = derive.profile(spark, sf_dir).select("vec_id", F.col("i").cast("long").alias("i"), (10 * F.col("i") + F.round("v", 4)).alias("pos"))
    return rows.middle_block(p, "vec_id", "i", "pos", 3, F.lit(300))


@query(with_views("profile", body="SELECT vec_id, i, round(v, 6) AS v FROM profile JOIN (SELECT vec_id, min(i) AS a, max(i) AS b FROM profile WHERE v > 0.15 GROUP BY 1) USING (vec_id) WHERE i BETWEEN a AND b"))
def present_rows_run(spark, sf_dir):
    r = rows.present_run(derive.profile(spark, sf_dir), "vec_id", "i", F.col("v") > 0.15)
    return r.select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query(with_views("profile", body="""SELECT s.vec_id, CASE WHEN k >= 2 THEN greatest(0, a - 2.5) ELSE 0 END::double AS lo, CASE WHEN k >= 2 THEN least(64, b + 2.5) ELSE 64 END::double AS hi FROM (SELECT DISTINCT vec_id FROM profile) s
  LEFT JOIN (SELECT vec_id, min(i) AS a, max(i) AS b, count(*) AS k FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM profile WINDOW w AS (PARTITION BY vec_id ORDER BY i)) WHERE v >= p AND v > q AND v > 0.2 GROUP BY 1) USING (vec_id)"""))
def row_band_bounds(spark, sf_dir):
    p = derive.profile(spark, sf_dir)
    peaks = signal.local_maxima(p, "vec_id", "i", "v").where("v > 0.2")
    return rows.row_band(peaks, p.groupBy("vec_id").agg(F.count("*").alias("n")), "vec_id", "i", 2.5)


@query()
def sparse_tiles_kept(spark, sf_dir):
    t = derive.tiles(spark, sf_dir)
    return rows.keep_sparse(t, F.col("veg_pct"), 5.0, 0.15, F.concat_ws("_", "plot_stem", "tile_k", "x0", "y0"))


@query(with_views("patches", body="""SELECT a.vec_id, a.row AS i, a.col AS j, (a.value + b.value + c.value + d.value) / 4.0::double AS mean FROM patches a JOIN patches b ON b.vec_id = a.vec_id AND b.row = a.row + 1 AND b.col = a.col
  JOIN patches c ON c.vec_id = a.vec_id AND c.row = a.row AND c.col = a.col + 1 JOIN patches d ON d.vec_id = a.vec_id AND d.row = a.row + 1 AND d.col = a.col + 1"""))
def mesh_cell_means(spark, sf_dir):
    nodes = derive.patches(spark, sf_dir).select("vec_id", F.col("row").alias("i"), F.col("col").cast("long").alias("j"), "value")
    return rows.mesh_cells(nodes, ["vec_id"], "value").select("vec_id", "i", "j", "mean")


@query(with_views("tiles", body="""SELECT result, count(*) AS n FROM (SELECT CASE WHEN w % 5 = 0 THEN 'RESAMPLED' WHEN bits = src AND x0 % 11 <> 0 THEN 'IDENTICAL' WHEN bits <> src AND y0 % 7 <> 0 THEN 'EXACT CONVERSION' ELSE 'FAIL' END AS result
  FROM (SELECT *, 8 + 8 * (x0 % 2) AS bits, 8 + 8 * (y0 % 2) AS src FROM tiles)) GROUP BY 1"""))
def qa_tile_results(spark, sf_dir):
    t = derive.tiles(spark, sf_dir)
    bits, src = 8 + 8 * (F.col("x0") % 2), 8 + 8 * (F.col("y0") % 2)
    return t.select(rows.tile_result(F.col("x0") % 11 != 0, F.col("w") % 5 != 0, bits, src, F.col("y0") % 7 != 0).alias("result")).groupBy("result").agg(F.count("*").alias("n"))
