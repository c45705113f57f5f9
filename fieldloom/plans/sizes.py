"""Queries of plot sizes on oblique rings, choices, edits of rows, noisy control points and shifts of patches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import checks, edits, shift, sizes
from fieldloom.plans import derive
from fieldloom.plans.catalog import query
from fieldloom.plans.derive import table, with_views

_OBLIQUE = """ob AS (SELECT plot_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (x1 - x0) / 2 AS hw, (y1 - y0) / 2 AS hl, 0.05::double * (plot_id % 40) AS t, 0.1::double * (plot_id % 5) AS sk FROM plots),
pts AS (SELECT plot_id, i, cx + cos(t) * u - sin(t) * v AS x, cy + sin(t) * u + cos(t) * v AS y FROM (SELECT *, unnest([0, 1, 2, 3]) AS i, unnest([-hw, hw, hw + sk, sk - hw]) AS u, unnest([-hl, -hl, hl, hl]) AS v FROM ob))"""


def oblique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots turned by up to two radians and sheared."""
    p = derive.plots(spark, sf_dir)
    k, cx, cy = F.col("plot_id"), (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hw, hl, t, sk = (F.col("x1") - F.col("x0")) / 2, (F.col("y1") - F.col("y0")) / 2, 0.05 * (k % 40), 0.1 * (k % 5)
    at = lambda u, v: F.struct((cx + F.cos(t) * u - F.sin(t) * v).alias("x"), (cy + F.sin(t) * u + F.cos(t) * v).alias("y"))
    return p.select("plot_id", F.array(at(-hw, -hl), at(hw, -hl), at(hw + sk, hl), at(sk - hw, hl)).alias("ring"))


@query(with_views("plots", body=f"""SELECT plot_id, round(aw, 6) AS axes_width, round(al, 6) AS axes_length, round(ew, 6) AS edges_width, round(el, 6) AS edges_length, short_first, round(sw, 6) AS short_width, round(sl, 6) AS short_length FROM (
  WITH {_OBLIQUE}, m AS (SELECT plot_id, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY 1), d AS (SELECT plot_id, i, x - mx AS dx, y - my AS dy FROM pts JOIN m USING (plot_id)),
  t AS (SELECT plot_id, 0.5::double * atan2(2 * sum(dx * dy), sum(dx * dx) - sum(dy * dy)) AS t FROM d GROUP BY 1),
  a AS (SELECT plot_id, max(-dx * sin(t) + dy * cos(t)) - min(-dx * sin(t) + dy * cos(t)) AS aw, max(dx * cos(t) + dy * sin(t)) - min(dx * cos(t) + dy * sin(t)) AS al FROM d JOIN t USING (plot_id) GROUP BY 1),
  e AS (SELECT p.plot_id, p.i, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS len FROM pts p JOIN pts q ON p.plot_id = q.plot_id AND q.i = (p.i + 1) % 4),
  s AS (SELECT plot_id, max(len) FILTER (i = 0) AS s0, max(len) FILTER (i = 1) AS s1, max(len) FILTER (i = 2) AS s2, max(len) FILTER (i = 3) AS s3 FROM e GROUP BY 1)
  SELECT plot_id, aw, al, (s0 + s2) / 2 AS ew, (s3 + s1) / 2 AS el, CASE WHEN round(s0 + s2, 9) <= round(s1 + s3, 9) THEN 0 ELSE 1 END AS short_first, CASE WHEN round(s0 + s2, 9) <= round(s1 + s3, 9) THEN s0 ELSE s1 END AS sw, CASE WHEN round(s0 + s2, 9) <= round(s1 + s3, 9) THEN s3 ELSE s0 END AS sl FROM a JOIN s USING (plot_id))"""))
def plot_sizes_three_ways(spark, sf_dir):
    r = F.col("ring")
    found = oblique(spark, sf_dir).select("plot_id", sizes.size_by_axes(r).alias("a"), sizes.size_by_edges(r).alias("e"), sizes.size_from_short_edge(r).alias("s"))
    one = lambda c, name: F.round(c, 6).alias(name)
    return found.select("plot_id", one("a.width", "axes_width"), one("a.length", "axes_length"), one("e.width", "edges_width"), one("e.length", "edges_length"), F.col("s.first").alias("short_first"), one("s.width", "short_width"), one("s.length", "short_length"))


@query(with_views("plots", body=f"SELECT plot_id FROM (WITH {_OBLIQUE} SELECT plot_id, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY 1) WHERE mx BETWEEN 10.3 AND 41.7 AND my BETWEEN 5.1 AND 60.2"))
def plots_in_band(spark, sf_dir):
    return oblique(spark, sf_dir).where(sizes.inside_band(F.col("ring"), F.lit(41.7), F.lit(5.1), F.lit(10.3), F.lit(60.2))).select("plot_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN least(40, l_quantity::int + 12) <= l_suppkey % 30 OR 50 - l_linenumber * 8 <= l_quantity::int THEN 'degenerate crop' ELSE '' END AS note FROM lineitem""")
def crops_without_area(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sizes.crop_note(F.col("l_suppkey") % 30, q, F.least(F.lit(40), q + 12), 50 - F.col("l_linenumber") * 8).alias("note"))


@query("""SELECT s_suppkey, round(km, 6) AS km, km > 10 AS far FROM (SELECT s_suppkey, sqrt((s_acctbal / 40000 * 111.32::double * cos(radians(48.5::double))) ** 2 + ((s_nationkey - 12) / 200.0::double * 110.54::double) ** 2) AS km FROM supplier)""")
def plots_far_from_project(spark, sf_dir):
    d = sizes.far_from_project(9.0 + F.col("s_acctbal") / 40000, 48.5 + (F.col("s_nationkey") - 12) / 200.0, F.lit(9.0), F.lit(48.5))
    return table(spark, sf_dir, "supplier").select("s_suppkey", d.alias("d")).select("s_suppkey", F.round("d.km", 6).alias("km"), F.col("d.far").alias("far"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def first_plots_of_file(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_totalprice", "o_orderkey").alias("ord"))
    return sizes.first_plots(o, "ord", 25).select("o_orderkey")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN n_points = 0 OR epsg IS NULL THEN 'skipped' WHEN epsg = 32630 THEN 'already' WHEN epsg IN (4326, 32631) THEN 'converted' ELSE 'failed' END AS status FROM (
  SELECT o_orderkey % 6 AS n_points, CASE o_custkey % 5 WHEN 0 THEN 32630 WHEN 1 THEN 4326 WHEN 2 THEN 32631 WHEN 3 THEN 27700 END AS epsg FROM orders)) GROUP BY 1""")
def control_points_retagged(spark, sf_dir):
    k = F.col("o_custkey") % 5
    files = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 6).alias("n_points"), F.when(k == 0, 32630).when(k == 1, 4326).when(k == 2, 32631).when(k == 3, 27700).alias("epsg"))
    return sizes.retagged(files, 32630, [4326, 32631])


_ROWS = "rw AS (SELECT o_custkey AS plot_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::int AS row_idx, round(o_totalprice % 3 - 1.5::double, 4) AS v, o_orderstatus AS source FROM orders), ch AS (SELECT plot_id, row_idx FROM rw WHERE (plot_id + row_idx) % 3 = 0)"


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plot_id"), n.alias("row_idx"), F.round(F.col("o_totalprice") % 3 - 1.5, 4).alias("v"), F.col("o_orderstatus").alias("source"))
    return rows, rows.where((F.col("plot_id") + F.col("row_idx")) % 3 == 0).select("plot_id", "row_idx")


@query(f"WITH {_ROWS} SELECT plot_id, row_number() OVER (PARTITION BY plot_id ORDER BY w, row_idx)::int AS row_idx, w AS v, source FROM (SELECT plot_id, row_idx, CASE WHEN c THEN round(v + 0.75::double, 4) ELSE v END AS w, CASE WHEN c THEN 'edit' ELSE source END AS source FROM (SELECT rw.*, ch.row_idx IS NOT NULL AS c FROM rw LEFT JOIN ch USING (plot_id, row_idx)))")
def rows_nudged(spark, sf_dir):
    return edits.rows_moved(*_rows(spark, sf_dir), 0.75).select("plot_id", "row_idx", "v", "source")


@query(f"WITH {_ROWS} SELECT plot_id, row_number() OVER (PARTITION BY plot_id ORDER BY v, row_idx)::int AS row_idx, v, source FROM rw ANTI JOIN ch USING (plot_id, row_idx)")
def rows_taken_away(spark, sf_dir):
    return edits.rows_deleted(*_rows(spark, sf_dir)).select("plot_id", "row_idx", "v", "source")


@query("""WITH p AS (SELECT o_custkey AS g, o_orderkey % 97 AS col, o_orderkey % 89 AS row, 2.5::double * (o_orderkey % 97) - 0.5::double * (o_orderkey % 89) + 10 + o_totalprice % 1 AS x, 0.25::double * (o_orderkey % 97) + 3.0::double * (o_orderkey % 89) - 7 - o_totalprice % 0.7::double AS y FROM orders),
m AS (SELECT g, count(*) AS n, avg(col) AS mc, avg(row) AS mr, avg(x) AS mx, avg(y) AS my FROM p GROUP BY 1), d AS (SELECT p.g, n, mc, mr, mx, my, col, row, x, y, col - mc AS c, row - mr AS r FROM p JOIN m USING (g)),
s AS (SELECT g, any_value(n) AS n, any_value(mc) AS mc, any_value(mr) AS mr, any_value(mx) AS mx, any_value(my) AS my, sum(c * c) AS cc, sum(c * r) AS cr, sum(r * r) AS rr, sum(c * (x - mx)) AS cx, sum(r * (x - mx)) AS rx, sum(c * (y - my)) AS cy, sum(r * (y - my)) AS ry FROM d GROUP BY 1),
f AS (SELECT *, (cx * rr - rx * cr) / (cc * rr - cr * cr) AS a, (rx * cc - cx * cr) / (cc * rr - cr * cr) AS b, (cy * rr - ry * cr) / (cc * rr - cr * cr) AS dd, (ry * cc - cy * cr) / (cc * rr - cr * cr) AS e FROM s WHERE n >= 3 AND abs(cc * rr - cr * cr) > 1e-3)
SELECT g, any_value(f.n) AS n, round(avg(off), 5) AS mean_off, round(max(off), 5) AS max_off FROM (SELECT p.g, f.n, sqrt((a * (col - mc) + b * (row - mr) + mx - x) ** 2 + (dd * (col - mc) + e * (row - mr) + my - y) ** 2) AS off FROM p JOIN f USING (g)) f GROUP BY g""")
def affine_fit_residuals(spark, sf_dir):
    """Fits of noisy control points, with how far the points lie off."""
    col, row, price = F.col("o_orderkey") % 97, F.col("o_orderkey") % 89, F.col("o_totalprice")
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), col.alias("col"), row.alias("row"), (2.5 * col - 0.5 * row + 10 + price % 1).alias("x"), (0.25 * col + 3.0 * row - 7 - price % 0.7).alias("y"))
    return checks.affine_residuals(p, "g").where("a is not null").select("g", "n", F.round("mean_off", 5).alias("mean_off"), F.round("max_off", 5).alias("max_off"))


@query("""SELECT vec_id, round(corr(ln(1 + a), ln(1 + b)), 6) AS corr, count(*) AS n FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: x::double + 1)) AS a, unnest(list_transform(range(64), lambda i: 0.7::double * (embedding[i + 1]::double + 1) + 0.3::double * (embedding[(i + 9) % 64 + 1]::double + 1))) AS b FROM embeddings) GROUP BY 1""")
def patch_correlations(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", i.cast("int")).cast("double") + 1
    px = e.select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(at(i).alias("a"), (0.7 * at(i) + 0.3 * at((i + 9) % 64)).alias("b")))).alias("p"))
    return shift.correlations(px.select("vec_id", "p.a", "p.b"), "vec_id", F.col("a"), F.col("b")).select("vec_id", F.round("corr", 6).alias("corr"), "n")


@query("SELECT vec_id, ((vec_id % 7) - 3)::double AS dy, ((vec_id // 7) % 7 - 3)::double AS dx FROM embeddings")
def patch_shifts(spark, sf_dir):
    """Patches turned round by known steps, which phase correlation finds again."""
    v = F.col("vec_id")
    dy, dx = v % 7 - 3, F.expr("vec_id div 7") % 7 - 3
    moved = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("embedding", (F.pmod(F.floor(i / 8) - dy, F.lit(8)) * 8 + F.pmod(i % 8 - dx, F.lit(8))).cast("int")).cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("a"), F.transform("embedding", lambda x: x.cast("double")).alias("b"))
    found = e.select("vec_id", shift.shift_of("a", "b", F.lit(8)).alias("s"))
    return found.select("vec_id", (F.round("s.dy") + 0.0).alias("dy"), (F.round("s.dx") + 0.0).alias("dx"))
