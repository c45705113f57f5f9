"""Queries of a run's reports: sets of ids, lookups, summaries and small geometry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import checks, reports
from fieldloom.plans import derive
from fieldloom.plans.catalog import query
from fieldloom.plans.derive import table, with_views

_LINES = "lines AS (SELECT o_custkey AS plot_id, o_orderkey AS ord, (o_totalprice % 1000)::double AS v FROM orders)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plot_id"), F.col("o_orderkey").alias("ord"), (F.col("o_totalprice") % 1000).cast("double").alias("v"))


# ---------------------------------------------------------------- sets


@query("SELECT o_custkey AS plot_id FROM orders UNION SELECT c_custkey FROM customer UNION SELECT l_suppkey FROM lineitem")
def plot_ids_of_all_reports(spark, sf_dir):
    key = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("plot_id"))
    return reports.all_ids("plot_id", key("orders", "o_custkey"), key("customer", "c_custkey"), key("lineitem", "l_suppkey"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem)
  (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL (SELECT id FROM b EXCEPT SELECT id FROM a)""")
def selection_toggled(spark, sf_dir):
    key = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("id"))
    return reports.in_one_only(key("orders", "o_custkey"), key("lineitem", "l_partkey"), "id")


@query("""SELECT l_orderkey AS plot_stem, array_to_string(list_sort(list_filter([1, 2, 3, 5, 7], lambda r: NOT list_contains(list(l_linenumber), r))), ' ') AS missing FROM lineitem GROUP BY 1""")
def rows_not_found(spark, sf_dir):
    there = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plot_stem")).agg(F.collect_set(F.col("l_linenumber").cast("int")).alias("there"))
    wanted = F.array(*[F.lit(k) for k in (1, 2, 3, 5, 7)])
    return there.select("plot_stem", F.array_join(reports.rows_not_there(wanted, F.col("there")), " ").alias("missing"))


@query(with_views("patches", body="SELECT vec_id, count(*) FILTER (value > 140 OR (row + col) % 3 = 0) AS n_any, count(*) FILTER (value > 140 AND (row + col) % 3 = 0) AS n_both, count(*) FILTER (value > 140 AND (row + col) % 3 <> 0) AS n_first FROM patches GROUP BY 1"))
def pixel_masks(spark, sf_dir):
    p = derive.patches(spark, sf_dir)
    return reports.mask_counts(p, "vec_id", F.col("value") > 140, (F.col("row") + F.col("col")) % 3 == 0)


@query(with_views("tiles", "rows_report", body="""SELECT plot, string_agg(flag, '; ' ORDER BY seq) AS flags FROM (
    SELECT plot_stem AS plot, 0 AS seq, 'rows not measured' AS flag FROM rows_report WHERE NOT ok
    UNION ALL SELECT plot_stem, tile_k, 'tile ' || tile_k || ' is bare' FROM tiles WHERE veg_pct < 0.5) GROUP BY plot"""))
def flags_of_all_checks(spark, sf_dir):
    rows = derive.rows_report(spark, sf_dir).where("not ok").select(F.col("plot_stem").alias("plot"), F.lit(0).alias("seq"), F.lit("rows not measured").alias("flag"))
    tiles = derive.tiles(spark, sf_dir).where("veg_pct < 0.5").select(F.col("plot_stem").alias("plot"), F.col("tile_k").alias("seq"), F.format_string("tile %d is bare", "tile_k").alias("flag"))
    return checks.flags_of(reports.gathered(rows, tiles))


@query("""SELECT o_orderkey AS plot_stem, o_orderstatus AS status, NULL::double AS pct, NULL::varchar AS clerk FROM orders
  UNION ALL SELECT l_orderkey, NULL, l_discount::double, NULL FROM lineitem UNION ALL SELECT s_suppkey, NULL, NULL, s_name FROM supplier""")
def report_of_many_columns(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plot_stem"), F.col("o_orderstatus").alias("status"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plot_stem"), F.col("l_discount").cast("double").alias("pct"))
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("plot_stem"), F.col("s_name").alias("clerk"))
    return reports.gathered(a, b, c)


# ---------------------------------------------------------------- lookups


@query("""WITH ids AS (SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier)
  SELECT id, price, balance, supplier FROM ids LEFT JOIN (SELECT o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) USING (id)
  LEFT JOIN (SELECT c_custkey AS id, c_acctbal AS balance FROM customer) USING (id) LEFT JOIN (SELECT s_suppkey AS id, s_name AS supplier FROM supplier) USING (id)""")
def plots_with_their_reports(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("ord"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit(0).alias("ord"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("supplier"), F.lit(0).alias("ord"))
    return reports.with_lookups(reports.all_ids("id", o, c, s), "id", o, c, s)


@query(f"WITH {_LINES} SELECT count(*) FILTER (p IS NOT NULL) AS matched, count(*) FILTER (p IS NULL) AS unmatched FROM lines LEFT JOIN (SELECT DISTINCT p_partkey AS p FROM part) ON p = plot_id * 2")
def lines_without_plot(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("plot_id", F.col("plot_id") * 2)
    known, lost = reports.matched_lines(lines, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("plot_id")), "plot_id")
    return checks.crossed(known.agg(F.count("*").alias("matched")), lost)


@query("SELECT c_custkey AS plot_id, count(o_orderkey) AS n_rows FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def row_counts_of_plots(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("plot_id")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plot_id")).join(n, "plot_id", "left").select("plot_id", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query(with_views("plots", body="""SELECT plot_id, round(x0 + coalesce(shift, 0), 6) AS x0, round(x1 + coalesce(shift, 0), 6) AS x1, shift IS NOT NULL AS moved FROM plots
  LEFT JOIN (SELECT o_custkey AS plot_id, arg_max(o_orderkey % 41 / 100.0::double, o_orderkey) AS shift FROM orders GROUP BY 1) USING (plot_id)"""))
def plots_shifted_by_refit(spark, sf_dir):
    shifts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plot_id"), (F.col("o_orderkey") % 41 / 100).alias("shift"), F.col("o_orderkey").alias("ord"))
    p = reports.with_lookups(derive.plots(spark, sf_dir).select("plot_id", "x0", "x1"), "plot_id", shifts)
    by = F.coalesce("shift", F.lit(0.0))
    return p.select("plot_id", F.round(F.col("x0") + by, 6).alias("x0"), F.round(F.col("x1") + by, 6).alias("x1"), F.col("shift").isNotNull().alias("moved"))


@query("""WITH a AS (SELECT o_custkey % 1000 AS g, o_orderkey AS ring, row_number() OVER (PARTITION BY o_custkey % 1000 ORDER BY o_orderkey) AS place FROM orders),
  b AS (SELECT c_custkey % 1000 AS g, c_name AS record, row_number() OVER (PARTITION BY c_custkey % 1000 ORDER BY c_custkey) AS place FROM customer) SELECT g, place, ring, record FROM a JOIN b USING (g, place)""")
def rings_zipped_with_records(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 1000).alias("g"), F.col("o_orderkey").alias("ring"))
    b = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 1000).alias("g"), F.col("c_name").alias("record"), F.col("c_custkey").alias("o"))
    return reports.zipped(a, b, "g", "ring", "o").select("g", F.col("place").cast("long").alias("place"), "ring", "record")


@query("SELECT o_orderkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal::double END, 12.5) AS z FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 3")
def heights_with_fallback(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 3).alias("cell"))
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("double")).otherwise(F.lit(float("nan"))).alias("height"))
    return reports.height_or(points, cells, "cell", "height", 12.5).select("o_orderkey", "z")


@query(with_views("plots", body="""SELECT plot_id, arg_min(i, (round(d, 9), i))::int AS corner FROM (SELECT plot_id, i, (cx - px) ** 2 + (cy - py) ** 2 AS d FROM (
  SELECT plot_id, x0 + 0.01::double * (plot_id % 100) AS px, y0 + 0.05::double * (plot_id % 81) AS py, unnest([0, 1, 2, 3]) AS i, unnest([x0, x1, x1, x0]) AS cx, unnest([y0, y0, y1, y1]) AS cy FROM plots)) GROUP BY 1"""))
def nearest_corners(spark, sf_dir):
    p = derive.rings(derive.plots(spark, sf_dir))
    return p.select("plot_id", reports.nearest_corner(F.col("ring"), F.col("x0") + 0.01 * (F.col("plot_id") % 100), F.col("y0") + 0.05 * (F.col("plot_id") % 81)).cast("int").alias("corner"))


# ---------------------------------------------------------------- summaries


_GAPS = f"{_LINES}, gaps AS (SELECT plot_id, v - lag(v) OVER (PARTITION BY plot_id ORDER BY v) AS gap FROM lines), per AS (SELECT plot_id, median(gap) AS gap_med, count(*) AS n_gaps FROM gaps WHERE gap > 0.55::double * 60 AND gap < 1.8::double * 60 GROUP BY 1)"


@query(f"WITH {_GAPS} SELECT plot_id, round(gap_med, 6) AS gap_med, n_gaps FROM per")
def refit_gap_medians(spark, sf_dir):
    return reports.gap_medians(_lines(spark, sf_dir), "plot_id", "v", 60.0).select("plot_id", F.round("gap_med", 6).alias("gap_med"), "n_gaps")


@query(f"WITH {_GAPS} SELECT count(*) AS measured, CASE WHEN count(*) >= 10 THEN round(median(gap_med), 6) END AS pitch, count(*) < 10 AS stop FROM per")
def refit_run_pitch(spark, sf_dir):
    return reports.run_pitch(reports.gap_medians(_lines(spark, sf_dir), "plot_id", "v", 60.0)).withColumn("pitch", F.round("pitch", 6))


@query("SELECT l_orderkey AS plot_stem, median(l_extendedprice::double) AS row_length FROM lineitem GROUP BY 1")
def row_length_medians(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plot_stem")).agg(F.median(F.col("l_extendedprice").cast("double")).alias("row_length"))


@query("SELECT o_orderstatus AS action, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def refit_action_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("action")).agg(F.count("*").alias("n")).orderBy("action")


@query(with_views("tiles", body="SELECT plot_stem, array_to_string(list_sort(list(DISTINCT w || 'x' || h)), ' ') AS sizes, count(DISTINCT w || 'x' || h) = 1 AS uniform FROM tiles GROUP BY 1"))
def tile_sizes_uniform(spark, sf_dir):
    return reports.size_uniformity(derive.tiles(spark, sf_dir), "plot_stem")


@query(with_views("tiles", body="SELECT plot_stem, round(median(veg_pct)::double, 6) AS median_pct, round(avg((veg_pct < 0.5)::int), 6) AS bare_share FROM tiles GROUP BY 1"))
def tile_cover_summary(spark, sf_dir):
    s = reports.cover_summary(derive.tiles(spark, sf_dir), "plot_stem", "veg_pct")
    return s.select("plot_stem", F.round(F.col("median_pct").cast("double"), 6).alias("median_pct"), F.round("bare_share", 6).alias("bare_share"))


@query("SELECT l_orderkey AS plot_stem, list_sort(list(l_quantity::double))[count(*) // 2 + 1] AS pitch FROM lineitem GROUP BY 1")
def pitch_upper_median(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plot_stem")).agg(F.collect_list(F.col("l_quantity").cast("double")).alias("p"))  # an order's few lines
    return each.select("plot_stem", reports.upper_median(F.col("p")).alias("pitch"))


@query("SELECT arg_max(n, (k, -n)) AS usual FROM (SELECT n, count(*) AS k FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY n)")
def usual_rows_of_a_plot(spark, sf_dir):
    return reports.usual_count(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")), "n")


@query(with_views("rows_report", body="SELECT round(3 * median(pitch_mm)::double / 1000 + 2 * 0.05::double, 3) AS across_m FROM rows_report WHERE ok"))
def tile_across_size(spark, sf_dir):
    r = derive.rows_report(spark, sf_dir).where("ok").withColumn("pitch_mm", F.col("pitch_mm").cast("double"))
    return reports.across_size(r, "pitch_mm", 3, 0.05)


@query("""WITH p AS (SELECT l_orderkey AS id, list_sort(list(l_quantity::double + 60 * l_linenumber)) AS peaks, (1 + l_orderkey % 3)::int AS n, 400 + (l_orderkey % 7)::int AS w FROM lineitem GROUP BY 1)
  SELECT id, CASE WHEN n < len(peaks) THEN list_sort(list_transform(range(0, len(peaks) - n + 1), lambda s: struct_pack(d := abs((peaks[s + 1] + peaks[s + n]) / 2 - w / 2.0::double), s := s)))[1].s ELSE 0 END::int AS first FROM p""")
def block_nearest_middle(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("double") + 60 * F.col("l_linenumber"))).alias("peaks"))
    n, w = (1 + F.col("id") % 3).cast("int"), (400 + F.col("id") % 7).cast("int")
    return p.select("id", reports.block_near_middle(F.col("peaks"), n, w).cast("int").alias("first"))


@query(with_views("profile", body="""SELECT vec_id, i, round(f + sum(step) OVER (PARTITION BY vec_id ORDER BY i), 6) AS unwrapped FROM (SELECT vec_id, i, coalesce((ph - lag(ph) OVER w + 12 + 48) % 24 - 12, 0) AS step, first_value(ph) OVER w AS f
  FROM (SELECT vec_id, i, round((v + 1) * 12, 3) AS ph FROM profile) WINDOW w AS (PARTITION BY vec_id ORDER BY i))"""))
def phase_unwrapped(spark, sf_dir):
    p = derive.profile(spark, sf_dir).withColumn("ph", F.round((F.col("v") + 1) * 12, 3))
    return reports.unwrapped(p, "vec_id", "i", "ph", 24.0).select("vec_id", F.col("i").cast("long").alias("i"), F.round("unwrapped", 6).alias("unwrapped"))


# ---------------------------------------------------------------- small geometry and labels


@query("""SELECT l_orderkey, l_linenumber, round(least(a, 180 - a), 6) AS tilt FROM (SELECT l_orderkey, l_linenumber, abs(degrees(atan2(l_quantity::double - 25.5::double, l_linenumber - 3.5::double))) % 180 AS a FROM lineitem)""")
def edge_tilt(spark, sf_dir):
    dx, dy = F.col("l_quantity").cast("double") - 25.5, F.col("l_linenumber") - 3.5
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(reports.tilt_from_vertical(dx, dy), 6).alias("tilt"))


@query("SELECT l_orderkey, l_linenumber, greatest(2, least(512, ceil(l_extendedprice::double / 96)))::int AS nx, greatest(2, least(512, ceil(l_quantity::double * 2 / 96)))::int AS ny FROM lineitem")
def mesh_dimensions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", reports.mesh_cells(F.col("l_extendedprice").cast("double")).alias("nx"), reports.mesh_cells(F.col("l_quantity").cast("double") * 2).alias("ny"))


@query("SELECT c_custkey, round(111320.0::double * cos(radians(greatest(-89.5::double, least(89.5::double, c_acctbal::double / 60)))), 3) AS mx, 110540.0::double AS my FROM customer")
def metres_per_degree(spark, sf_dir):
    mx, my = reports.metres_per_degree(F.col("c_acctbal").cast("double") / 60)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(mx, 3).alias("mx"), my.alias("my"))


@query(with_views("plots", body="SELECT plot_id, round(CASE WHEN pct > -90 THEN (x1 - x0) * (1 + pct / 100.0::double) ELSE x1 - x0 END, 6) AS width FROM (SELECT *, plot_id % 211 - 105 AS pct FROM plots)"))
def plots_resized_by_pct(spark, sf_dir):
    p = derive.plots(spark, sf_dir)
    return p.select("plot_id", F.round(reports.resized_pct(F.col("x1") - F.col("x0"), F.col("plot_id") % 211 - 105), 6).alias("width"))


@query("""SELECT l_orderkey, l_linenumber, abs(dx * 0.6::double + dy * 0.8::double) <= 12 AND abs(dy * 0.6::double - dx * 0.8::double) <= 4 AS inside
  FROM (SELECT l_orderkey, l_linenumber, l_quantity::double - 25 AS dx, l_linenumber - 4.0::double AS dy FROM lineitem)""")
def points_in_oriented_frame(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    inside = reports.in_oriented_frame(F.col("l_quantity").cast("double") - 25, F.col("l_linenumber") - 4.0, F.lit(0.6), F.lit(0.8), F.lit(12), F.lit(4))
    return li.select("l_orderkey", "l_linenumber", inside.alias("inside"))


@query("""SELECT o_orderkey, rtrim(lower(src), '/') || '/' = left(rtrim(lower(dst), '/') || '/', length(rtrim(lower(src), '/')) + 1) AS unsafe FROM (
  SELECT o_orderkey, 'C:/Data/' || o_orderstatus || '/' AS src, 'c:/data/' || CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderstatus) WHEN o_orderkey % 3 = 1 THEN 'f/tiles//' ELSE 'p2' END AS dst FROM orders)""")
def output_in_source_folder(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    src = F.concat(F.lit("C:\\Data/"), F.col("o_orderstatus"), F.lit("/"))
    dst = F.concat(F.lit("c:/data\\"), F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderstatus")).when(F.col("o_orderkey") % 3 == 1, "f/tiles//").otherwise("p2"))
    return o.select("o_orderkey", reports.output_unsafe(src, dst).alias("unsafe"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'daylight' WHEN '2-HIGH' THEN 'cloudy' ELSE 'camera' END AS balance, printf('%.2f', o_custkey / 10.0::double) AS shown FROM orders")
def preset_labels(spark, sf_dir):
    known = {"1-URGENT": "daylight", "2-HIGH": "cloudy", "as shot": "camera"}
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.preset(F.col("o_orderpriority"), known, "as shot").alias("balance"), F.format_string("%.2f", F.col("o_custkey") / 10).alias("shown"))
