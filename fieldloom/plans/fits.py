"""Queries of the two-pass refit, row fits, tiles on middle rows and control points, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import middle, refit, rowfit
from fieldloom.plans import derive
from fieldloom.plans.catalog import query
from fieldloom.plans.derive import table, with_views
from fieldloom.tables import stored

# ---------------------------------------------------------------- the refit of a run

_MEASURED = """profiles AS (SELECT vec_id AS plot, 1400 + 10.0::double * (vec_id % 9) AS w, CASE WHEN vec_id % 17 = 0 THEN NULL WHEN vec_id % 23 = 1 THEN list_transform(range(64), lambda i: i::double)
    ELSE list_transform(range(64), lambda i: embedding[i + 1]::double * CASE WHEN abs(i - 31.5::double) < 13 THEN 1 ELSE 0.1::double END + CASE WHEN vec_id % 29 = 2 THEN 0 ELSE CASE WHEN abs(i - 31.5::double) < 13 THEN 0.6::double * cos(2 * pi() * (i - 0.9::double * (vec_id % 5)) / 4.6::double) ELSE 0 END END) END AS prof FROM embeddings),
sm AS (SELECT *, list_transform(range(64), lambda i: (coalesce(prof[i], 0) + prof[i + 1] + coalesce(prof[i + 2], 0)) / 3) AS s FROM profiles),
n AS (SELECT *, list_transform(s, lambda x: (x - list_min(s)) / (list_max(s) - list_min(s) + 1e-9::double)) AS v FROM sm),
f AS (SELECT *, list_filter(range(1, 63), lambda i: v[i + 1] >= v[i] AND v[i + 1] > v[i + 2] AND v[i + 1] - greatest(list_min(v[greatest(0, i - 3) + 1:i]), list_min(v[i + 2:least(64, i + 4)])) >= 0.09::double) AS found FROM n),
t AS (SELECT plot, w, prof IS NULL AS nodata, list_sort(list_reduce(list_transform(list_sort(list_transform(found, lambda i: struct_pack(h := -v[i + 1], i := i))), lambda x: [x.i]),
    lambda a, x: CASE WHEN len(list_filter(a, lambda j: abs(j - x[1]) < 3)) > 0 THEN a ELSE list_concat(a, x) END, []::bigint[])) AS taken FROM f),
p AS (SELECT plot, w, CASE WHEN nodata THEN 'nodata' WHEN len(taken) < 3 THEN 'rows_not_found' ELSE '' END AS flag, CASE WHEN NOT nodata THEN len(taken) END AS n_all,
    CASE WHEN len(taken) >= 3 AND NOT nodata THEN list_transform(taken, lambda i: (-0.45::double + i * (1.9::double / 63)) * w) END AS pos FROM t),
g AS (SELECT *, round(list_median(list_filter(list_transform(range(1, len(pos)), lambda i: pos[i + 1] - pos[i]), lambda d: d > 110 AND d < 360)), 1) AS gap, len(list_filter(pos, lambda x: x >= 0 AND x <= w)) AS n_in FROM p),
run AS (SELECT (SELECT median(gap) FROM g) AS pitch, (SELECT median(w) FROM g) AS width, (SELECT arg_max(n_in, (c, -n_in)) FROM (SELECT n_in, count(*) AS c FROM g WHERE n_in > 0 GROUP BY 1)) AS rows_),
k AS (SELECT g.*, pitch, rows_, unnest(range(len(pos) - rows_ + 1)) AS k FROM g, run WHERE len(pos) >= rows_),
e AS (SELECT *, round(list_sum(list_transform(range(1, rows_), lambda i: abs(pos[k + i + 1] - pos[k + i] - pitch))) / (rows_ - 1), 9) AS err, (pos[k + 1] + pos[k + rows_]) / 2 - round(w, 1) / 2 AS off, pos[k + rows_] - pos[k + 1] AS span FROM k),
b AS (SELECT plot, arg_min({'err': err, 'off': off, 'span': span}, (round(3 * err + abs(off), 6), k)) AS b FROM e GROUP BY 1),
clean AS (SELECT count(*) AS n, CASE WHEN count(*) >= 20 THEN median(b.off) ELSE 0 END AS global_mm FROM b, run WHERE b.err <= 0.18::double * pitch)"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with planted rows, some without data, without rows or with rows at odd places."""
    v = F.col("vec_id")
    wave = lambda i: F.when((v % 29 == 2) | (F.abs(i - 31.5) >= 13), 0.0).otherwise(0.6 * F.cos(2 * math.pi * (i - 0.9 * (v % 5)) / 4.6))
    rows = F.transform("embedding", lambda x, i: x.cast("double") * F.when(F.abs(i - 31.5) < 13, 1.0).otherwise(0.1) + wave(i))
    shown = F.when(v % 17 == 0, None).when(v % 23 == 1, F.transform("embedding", lambda x, i: i.cast("double"))).otherwise(rows)
    return table(spark, sf_dir, "embeddings").select(v.alias("plot"), (1400 + 10.0 * (v % 9)).alias("width_mm"), shown.alias("profile"))


@query(f"""WITH {_MEASURED}, x AS (SELECT g.*, b.b AS b, pitch, global_mm, (width - (rows_ - 1) * pitch) / pitch >= 1.12::double AS go FROM g LEFT JOIN b USING (plot), run, clean)
SELECT plot, round(w, 1) AS plot_w_mm, n_all, CASE WHEN pos IS NOT NULL THEN n_in END AS n_in, gap AS gap_med_mm, round(b.span, 1) AS block_span_mm, round(b.err, 1) AS block_gap_err_mm, round(b.off, 1) + 0.0 AS offset_mm, round(global_mm, 1) + 0.0 AS global_mm, round(b.off - global_mm, 1) + 0.0 AS resid_mm,
  CASE WHEN NOT go THEN 0.0 WHEN b IS NULL OR b.err > 0.18::double * pitch OR abs(b.off - global_mm) > 0.3::double * pitch THEN round(global_mm, 1) + 0.0 ELSE round(b.off, 1) + 0.0 END AS shift_mm,
  CASE WHEN NOT go THEN 'measured only (continuity test)' WHEN b IS NULL THEN 'global only - rows not measured' WHEN b.err > 0.18::double * pitch THEN 'global only - irregular gaps' WHEN abs(b.off - global_mm) > 0.3::double * pitch THEN 'global only - residual > ' || round(0.3::double * pitch)::int || ' mm' ELSE 'global + residual' END AS action,
  CASE WHEN b IS NULL THEN flag WHEN b.err > 0.18::double * pitch THEN 'irregular' WHEN abs(b.off - global_mm) > 0.3::double * pitch THEN 'large_residual' ELSE flag END AS flag FROM x""")
def refit_two_pass(spark, sf_dir):
    plots = stored(refit.measured(_profiles(spark, sf_dir), 200.0, 0.45), "measured")
    return refit.shifted(plots, refit.run_of(plots), 0.3)


@query(f"""WITH {_MEASURED} SELECT round(pitch, 6) AS pitch_mm, rows_ AS rows, round((width - (rows_ - 1) * pitch) / pitch, 6) AS gap_ratio, CASE WHEN (SELECT count(gap) FROM g) < 10 THEN 2 WHEN (width - (rows_ - 1) * pitch) / pitch >= 1.12::double THEN 0 ELSE 3 END AS code,
  round(global_mm, 6) + 0.0 AS global_mm, n AS clean FROM run, clean""")
def refit_verdict(spark, sf_dir):
    plots = stored(refit.measured(_profiles(spark, sf_dir), 200.0, 0.45), "measured")
    run = refit.run_of(plots)
    return spark.createDataFrame([run], "pitch_mm double, rows long, gap_ratio double, code int, global_mm double, clean long").select(F.round("pitch_mm", 6).alias("pitch_mm"), "rows", F.round("gap_ratio", 6).alias("gap_ratio"), "code", (F.round("global_mm", 6) + 0.0).alias("global_mm"), "clean")


# ---------------------------------------------------------------- rows of rectified crops


@query(with_views("profile", body="""SELECT vec_id, round(max(m) / (avg(m) + 1e-9::double), 6) AS strength, arg_max(k, (round(m, 9), -k))::int AS waves FROM (
  SELECT vec_id, k, sqrt(sum(y * cos(2 * pi() * k * i / 64)) ** 2 + sum(y * sin(2 * pi() * k * i / 64)) ** 2) AS m FROM (
    SELECT vec_id, i, (r - avg(r) OVER (PARTITION BY vec_id)) * (0.5::double - 0.5::double * cos(2 * pi() * i / 63)) AS y FROM (
      SELECT q.vec_id, i, v - c0 - c1 * t - c2 * (t * t - 4095 / 12.0::double) - c3 * (t * t * t - t * 12281 / 20.0::double) AS r FROM (SELECT *, i - 31.5::double AS t FROM profile) q JOIN (
        SELECT vec_id, avg(v) AS c0, sum(v * t) / sum(t * t) AS c1, sum(v * (t * t - 4095 / 12.0::double)) / sum((t * t - 4095 / 12.0::double) ** 2) AS c2, sum(v * (t * t * t - t * 12281 / 20.0::double)) / sum((t * t * t - t * 12281 / 20.0::double) ** 2) AS c3
        FROM (SELECT *, i - 31.5::double AS t FROM profile) GROUP BY 1) c USING (vec_id))), (SELECT unnest(range(2, 12)) AS k) GROUP BY 1, 2) GROUP BY 1"""))
def periodicity_strength(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("sig"))
    shown = F.transform(rowfit.magnitudes(rowfit.without_trend(F.col("sig")), F.lit(2), F.lit(12)), lambda m: F.round(m, 9))
    return e.select("vec_id", F.round(rowfit.periodicity(F.col("sig")), 6).alias("strength"), (F.array_position(shown, F.array_max(shown)) + 1).cast("int").alias("waves"))


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of 64 columns and 8 rows: eight embeddings above each other."""
    p = derive.profile(spark, sf_dir)
    level = lambda a: F.floor((F.col("v") + 1) * a).cast("int")
    green = F.when(F.pmod(F.col("i") + F.expr("vec_id div 8"), F.lit(9)) < 3, 60).otherwise(0)
    return p.select(F.expr("vec_id div 8").alias("crop"), (F.col("vec_id") % 8).alias("row"), F.col("i").alias("col"), level(80).alias("r"), (level(80) + green).alias("g"), level(75).alias("b"))


@query()
def rows_of_crops(spark, sf_dir):
    """Boxes of the rows of crops: SQL has no greedy choice along a signal; the tests hold it against plain loops."""
    means = stored(rowfit.column_means(_crops(spark, sf_dir), "crop"), "columns")
    return rowfit.fitted_rows(means, "crop", 4, "width_length").select("crop", F.round("spacing", 6).alias("spacing"), F.array_join("peaks", " ").alias("peaks"), "rows", "x0", "x1", "y0", "y1")


# ---------------------------------------------------------------- middle rows

_MIDDLE = """pl AS (SELECT p_partkey AS plot, (600 + p_size * 7)::int AS w, (300 + p_partkey % 97)::int AS h, (p_partkey % 2)::int AS axis, 30.0::double + p_partkey % 13 AS pitch, (p_partkey % 21 - 10) * 0.5::double AS angle,
    list_transform(range(2 + p_size % 6), lambda k: 20.0::double + p_partkey % 17 + k * (30.0::double + p_partkey % 13) + k * k % 3 * 0.7::double) AS rows_, 10.0::double + p_partkey % 31 AS u0, p_size FROM part),
a AS (SELECT *, CASE WHEN axis = 0 THEN w ELSE h END AS long, CASE WHEN axis = 0 THEN h ELSE w END AS wide FROM pl),
u AS (SELECT *, long / 2.0::double AS lc, CASE WHEN plot % 37 = 0 THEN u0 + 70 ELSE long - 12.0::double - p_size % 40 END AS u1, (rows_[1] + rows_[-1]) / 2 + 3 AS span_c FROM a),
c AS (SELECT *, unnest(range(greatest(len(rows_) - 2, 1))) AS k FROM u),
m AS (SELECT *, (rows_[k + 1] + rows_[k + 3]) / 2 AS mid FROM c),
bb AS (SELECT plot, arg_min({'lo': rows_[k + 1] - pitch / 2, 'hi': rows_[k + 3] + pitch / 2}, (round(abs(mid - (rows_[1] + rows_[-1]) / 2), 3), round(abs(mid - span_c), 9), k)) AS band FROM m WHERE len(rows_) >= 3 GROUP BY 1),
v AS (SELECT u.*, bb.band, round_even(bb.band.hi - bb.band.lo, 0)::int AS bw, u1 - u0 AS span FROM u LEFT JOIN bb USING (plot))"""


def _tile_sql(placing: str) -> str:
    if placing == "band":
        size = "s AS (SELECT *, greatest(8, least(bw, wide)) AS side, greatest(8, least(bw, wide)) AS across FROM v), st AS (SELECT *, side AS stride, false AS large FROM s), n AS (SELECT *, CASE WHEN floor(span / side) <= 0 AND span >= 0.6::double * side THEN 1 ELSE floor(span / side)::int END AS n FROM st)"
    elif placing == "strict":
        size = "s AS (SELECT *, 90 AS side, 110 AS across FROM v), st AS (SELECT *, 70 AS stride, 110 > wide OR 90 > long AS large FROM s), n AS (SELECT *, CASE WHEN span >= side THEN floor((span - side) / stride)::int + 1 ELSE 0 END AS n FROM st)"
    else:
        size = "s AS (SELECT *, greatest(8, least(90, wide)) AS side, greatest(8, least(110, wide)) AS across FROM v), st AS (SELECT *, greatest(1, side - 20) AS stride, false AS large FROM s), n AS (SELECT *, 0 AS n FROM st)"
    even = "CASE WHEN n > 0 THEN list_transform(range(n), lambda i: round_even(u0 + (span - (side + (n - 1) * stride)) / 2 + i * stride, 0)::bigint) ELSE [] END"
    flush = "CASE WHEN span < side THEN [] WHEN round_even(u1, 0)::bigint - round_even(u0, 0)::bigint <= side THEN [round_even(u0, 0)::bigint] ELSE list_sort(list_distinct(list_append(list_transform(range(0, (round_even(u1, 0)::bigint - side - round_even(u0, 0)::bigint) // stride + 1), lambda i: round_even(u0, 0)::bigint + i * stride), round_even(u1, 0)::bigint - side))) END"
    return f"""WITH {_MIDDLE}, {size}, l AS (SELECT *, CASE WHEN band IS NULL OR large THEN [] ELSE {flush if placing == "flush" else even} END AS ats FROM n),
r AS (SELECT *, CASE WHEN band IS NULL THEN 'only ' || len(rows_) || ' row(s) found, 3 middle rows asked' WHEN large THEN 'the plot is smaller than one tile' WHEN len(ats) = 0 THEN 'usable length shorter than one tile' ELSE '' END AS reason FROM l),
x AS (SELECT *, unnest(CASE WHEN len(ats) = 0 THEN [NULL] ELSE range(len(ats)) END) AS tile_k FROM r),
y AS (SELECT *, greatest(0, least(ats[tile_k + 1], long - side)) AS l0 FROM x),
z AS (SELECT *, greatest(0, least(round_even(round((band.lo + band.hi) / 2 + tan(radians(angle)) * (l0 + side / 2.0::double - lc) - across / 2.0::double, 9), 0)::bigint, wide - across)) AS a0 FROM y)
SELECT plot, reason, tile_k::int AS tile_k, CASE WHEN tile_k IS NOT NULL THEN CASE axis WHEN 0 THEN l0 ELSE a0 END END AS x, CASE WHEN tile_k IS NOT NULL THEN CASE axis WHEN 0 THEN a0 ELSE l0 END END AS y,
  CASE WHEN tile_k IS NOT NULL THEN CASE axis WHEN 0 THEN side ELSE across END END AS w, CASE WHEN tile_k IS NOT NULL THEN CASE axis WHEN 0 THEN across ELSE side END END AS h FROM z"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = F.transform(F.sequence(F.lit(0), 1 + s % 6), lambda i: 20.0 + k % 17 + i * (30.0 + k % 13) + i * i % 3 * 0.7)
    t = table(spark, sf_dir, "part").select(k.alias("plot"), (600 + s * 7).cast("int").alias("w"), (300 + k % 97).cast("int").alias("h"), (k % 2).cast("int").alias("across_axis"), (30.0 + k % 13).alias("pitch"), ((k % 21 - 10) * 0.5).alias("angle_deg"), rows.alias("rows"), (10.0 + k % 31).alias("u0"), s.alias("s"))
    long = F.when(F.col("across_axis") == 0, F.col("w")).otherwise(F.col("h"))
    t = t.withColumns({"along_centre": long / 2.0, "u1": F.when(F.col("plot") % 37 == 0, F.col("u0") + 70).otherwise(long - 12.0 - F.col("s") % 40), "span_centre": (F.get("rows", F.lit(0)) + F.element_at("rows", -1)) / 2 + 3})
    return t.drop("s")


@query(_tile_sql("band"))
def middle_tiles_band(spark, sf_dir):
    return middle.middle_row_tiles(_detected(spark, sf_dir), 3, "band")


@query(_tile_sql("strict"))
def middle_tiles_strict(spark, sf_dir):
    return middle.middle_row_tiles(_detected(spark, sf_dir), 3, "strict", 90, 110, 20)


@query(_tile_sql("flush"))
def middle_tiles_flush(spark, sf_dir):
    return middle.middle_row_tiles(_detected(spark, sf_dir), 3, "flush", 90, 110, 20)


@query(with_views("patches", body="""SELECT vec_id AS plot, k, CASE axis WHEN 0 THEN row - a0 ELSE row END::int AS row, CASE axis WHEN 0 THEN col ELSE col - a0 END::int AS col, CASE WHEN across >= lo + slope * along AND across < lo + 3.7::double + slope * along THEN value ELSE 0 END AS value FROM (
  SELECT *, greatest(0, floor(lo + least(0, slope * 7)))::int AS a0, least(8, ceil(lo + 3.7::double + greatest(0, slope * 7)))::int AS a1, CASE axis WHEN 0 THEN row ELSE col END AS across, CASE axis WHEN 0 THEN col ELSE row END AS along FROM (
    SELECT *, vec_id % 2 AS axis, tan(radians(vec_id % 9 * 2 - 8)) AS slope, 2.3::double + 3.1::double * (k - 1) + 0.4::double * (vec_id % 3) - 1.85::double - tan(radians(vec_id % 9 * 2 - 8)) * 4 AS lo FROM patches, (SELECT unnest([1, 2]) AS k)))
  WHERE a1 - a0 >= 4 AND across >= a0 AND across < a1"""))
def whole_row_strips(spark, sf_dir):
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(v.alias("plot"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), (0.4 * (v % 3)).alias("o"), F.lit(3.7).alias("pitch"), (v % 9 * 2 - 8).alias("angle_deg"), F.lit(4).alias("along_centre"), (v % 2).alias("across_axis"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    rows = rows.withColumn("centre", 2.3 + 3.1 * (F.col("k") - 1) + F.col("o")).drop("o")
    out = middle.row_strips(derive.patches(spark, sf_dir).withColumnRenamed("vec_id", "plot"), rows, ["value"])
    return out.select("plot", "k", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value")


# ---------------------------------------------------------------- control points of a part

_POINTS = """pt AS (SELECT p_partkey AS crop, i, j, 20.0::double * i + p_partkey % 7 AS row, 30.0::double * j + p_partkey % 11 AS col, (i * 7 + j * 13 + p_partkey) % 5 * pi() / 500 AS e FROM part, (SELECT unnest(range(5)) AS i), (SELECT unnest(range(5)) AS j)),
v AS (SELECT *, 100 + 0.01::double * col + 0.002::double * row + 1e-5::double * row * col + e AS x, 50 - 0.012::double * row + 3e-6::double * row * col - e AS y, 12 + 0.001::double * col + 2 * e AS z FROM pt)"""
_FIT = ", ".join(f"avg({k}) AS {k}0, sum({k} * dr) / sum(dr * dr) AS {k}1, sum({k} * dc) / sum(dc * dc) AS {k}2, sum({k} * dr * dc) / sum(dr * dr * dc * dc) AS {k}3" for k in "xyz")
_AT = ", ".join(f"round({k}0 + {k}1 * (r - rm) + {k}2 * (c - cm) + {k}3 * (r - rm) * (c - cm), 4) AS {k}" for k in "xyz")


@query(f"""WITH {_POINTS}, d AS (SELECT *, row - avg(row) OVER (PARTITION BY crop) AS dr, col - avg(col) OVER (PARTITION BY crop) AS dc, avg(row) OVER (PARTITION BY crop) AS rm, avg(col) OVER (PARTITION BY crop) AS cm FROM v),
f AS (SELECT crop, any_value(rm) AS rm, any_value(cm) AS cm, {_FIT} FROM d GROUP BY 1)
SELECT crop, r - 7 AS row, c - 5 AS col, {_AT} FROM f, (SELECT unnest([7.0::double, 70]) AS r), (SELECT unnest([5.0::double, 100]) AS c)""")
def control_points_of_part(spark, sf_dir):
    k = F.col("p_partkey")
    grid = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.struct((20.0 * i + k % 7).alias("row"), (30.0 * j + k % 11).alias("col"), (F.pmod(i * 7 + j * 13 + k, F.lit(5)) * math.pi / 500).alias("e")))))
    points = F.transform(grid, lambda p: F.struct(p.row.alias("row"), p.col.alias("col"), (100 + 0.01 * p.col + 0.002 * p.row + 1e-5 * p.row * p.col + p.e).alias("x"), (50 - 0.012 * p.row + 3e-6 * p.row * p.col - p.e).alias("y"), (12 + 0.001 * p.col + 2 * p.e).alias("z")))
    part = derive.spread(table(spark, sf_dir, "part").select("p_partkey"))
    found = part.select(k.alias("crop"), F.explode(middle.points_of_box(points, F.lit(5), F.lit(7), F.lit(100), F.lit(70))).alias("p"))
    return found.select("crop", "p.row", "p.col", *[F.round(f"p.{c}", 4).alias(c) for c in "xyz"])
