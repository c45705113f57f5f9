"""Queries of row detection, pixel checks and places of crops and tiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import comb, pixelcheck, placing
from fieldloom.plans import derive
from fieldloom.plans.catalog import ORACLES, query
from fieldloom.plans.derive import table, with_views

# ---------------------------------------------------------------- rows from signals

_SIGNALS = "signals AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS sig, 7.5::double + 0.5::double * (vec_id % 5) AS p FROM embeddings)"
_CLEAR = "signals AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x::double > 0.05::double THEN x::double ELSE 0 END) AS sig, 7.5::double + 0.5::double * (vec_id % 5) AS p FROM embeddings)"


def _comb_sql(signals: str) -> str:
    return f"""{signals},
fit AS (SELECT *, round_even((63 - p / 2) / p, 0)::int + 1 AS n, greatest(1, 0.12::double * p) AS hw FROM signals),
tries AS (SELECT *, 31.5::double - (n - 1) * p / 2 - p / 2 + 0.5::double * i AS start FROM fit, LATERAL (SELECT unnest(range(ceil(p / 0.5::double)::int)) AS i)),
kept AS (SELECT vec_id, p, n, hw, i, start FROM tries WHERE start >= -1 AND start + (n - 1) * p <= 64),
places AS (SELECT *, unnest(range(n)) AS k, 1 AS sign FROM kept UNION ALL SELECT *, unnest(range(n - 1)) AS k, -1 AS sign FROM kept),
bins AS (SELECT vec_id, unnest(range(64)) AS bin, unnest(sig) AS v FROM signals),
vals AS (SELECT vec_id, q.i, k, sign, avg(v) AS m FROM places q JOIN bins USING (vec_id) WHERE abs(bin - (start + k * p + CASE WHEN sign < 0 THEN p / 2 ELSE 0 END)) < hw GROUP BY ALL),
scored AS (SELECT vec_id, i, round(sum(sign * m), 9) AS score FROM vals GROUP BY ALL),
best AS (SELECT vec_id, k.p, k.n, k.hw, k.start FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i) AS r FROM scored) s JOIN kept k USING (vec_id, i) WHERE r = 1),
teeth AS (SELECT vec_id, p, hw, k + 1 AS k, start + k * p AS pos FROM best, LATERAL (SELECT unnest(range(n)) AS k)),
sides AS (SELECT *, unnest([-1, 0, 1]) AS side FROM teeth),
parts AS (SELECT vec_id, k, pos, side, avg(v) AS m FROM sides JOIN bins USING (vec_id) WHERE abs(bin - (pos + side * p / 2)) < hw GROUP BY ALL),
rows_ AS (SELECT vec_id, k, pos, max(m) FILTER (side = 0) - avg(m) FILTER (side <> 0) AS contrast FROM parts GROUP BY ALL)"""


def _signals(spark, sf_dir, clear: bool = False):
    t = table(spark, sf_dir, "embeddings")
    sig = F.transform("embedding", lambda x: F.when(x.cast("double") > comb.GREEN_FLOOR, x.cast("double")).otherwise(0.0) if clear else x.cast("double"))
    return t.select("vec_id", sig.alias("sig"), F.lit(0.0).alias("first"), F.lit(1.0).alias("step"), F.lit(0.0).alias("lo"), F.lit(63.0).alias("hi"), (7.5 + 0.5 * (F.col("vec_id") % 5)).alias("pitch"))


@query(f"WITH {_comb_sql(_SIGNALS)} SELECT vec_id, k::int AS k, pos, round(contrast, 6) AS contrast, contrast > 0 AS present FROM rows_")
def comb_rows(spark, sf_dir):
    return comb.comb_rows(_signals(spark, sf_dir), "vec_id", 1.0).select("vec_id", "k", "pos", F.round("contrast", 6).alias("contrast"), "present")


@query(f"""WITH a AS (WITH {_comb_sql(_SIGNALS)} SELECT vec_id, count(*) FILTER (contrast > 0) > 0 AS ok, avg(contrast) FILTER (contrast > 0) AS g FROM rows_ GROUP BY vec_id),
b AS (WITH {_comb_sql(_CLEAR)} SELECT vec_id, count(*) FILTER (contrast > 0) > 0 AS ok, avg(contrast) FILTER (contrast > 0) AS g FROM rows_ GROUP BY vec_id),
mid AS (SELECT vec_id, median(v) AS t FROM (SELECT vec_id, unnest(embedding)::double AS v FROM embeddings) GROUP BY 1),
c AS (SELECT a.vec_id, a.g AS ga, b.g AS gb, coalesce(t < 0.05::double AND b.ok AND (NOT a.ok OR coalesce(b.g, -1) > coalesce(a.g, -1)), false) AS wins FROM a LEFT JOIN b USING (vec_id) JOIN mid USING (vec_id))
SELECT vec_id, CASE WHEN wins THEN 'green floor' ELSE 'threshold' END AS branch, round(CASE WHEN wins THEN gb ELSE ga END, 6) AS green_contrast FROM c""")
def rows_of_two_greens(spark, sf_dir):
    one = lambda clear: comb.green_contrast(comb.comb_rows(_signals(spark, sf_dir, clear), "vec_id", 1.0), "vec_id")
    middle = table(spark, sf_dir, "embeddings").select("vec_id", F.array_sort(F.transform("embedding", lambda x: x.cast("double"))).alias("s"))
    middle = middle.select("vec_id", ((F.get("s", F.lit(31)) + F.get("s", F.lit(32))) / 2).alias("threshold"))
    return comb.greener(one(False).join(middle, "vec_id"), one(True), "vec_id").select("vec_id", "branch", F.round("green_contrast", 6).alias("green_contrast"))


@query(with_views("patches", body="""SELECT x.vec_id, CASE WHEN w / 50.0::double <= 0.8 THEN 'x' WHEN w / 50.0::double >= 1.25 THEN 'y' WHEN x.s >= y.s THEN 'x' ELSE 'y' END AS axis
  FROM (SELECT vec_id, 30 + vec_id % 41 AS w, round(var_pop(m), 6) AS s FROM (SELECT vec_id, col, avg(value) AS m FROM patches GROUP BY 1, 2) GROUP BY 1, 2) x
  JOIN (SELECT vec_id, round(var_pop(m), 6) AS s FROM (SELECT vec_id, row, avg(value) AS m FROM patches GROUP BY 1, 2) GROUP BY 1) y USING (vec_id)"""))
def across_axes(spark, sf_dir):
    p = derive.patches(spark, sf_dir)
    side = lambda c, name: p.groupBy("vec_id", c).agg(F.avg("value").alias("m")).groupBy("vec_id").agg(F.round(F.var_pop("m"), 6).alias(name))
    both = side("col", "sx").join(side("row", "sy"), "vec_id")
    return both.select("vec_id", comb.across_axis(30 + F.col("vec_id") % 41, F.lit(50), F.col("sx"), F.col("sy")).alias("axis"))


# ---------------------------------------------------------------- pixels against their sources

_DEPTHS = "depths AS (SELECT vec_id, label, i // 8 AS row, i % 8 AS col, floor((v + 1) * 127.5::double + 0.5)::int AS v8, floor((v + 1) * 32767.5::double + 0.5)::int AS v16 FROM (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::double AS v FROM embeddings))"


def _depths(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    level = lambda top: F.floor((F.col("v") + 1) * top + 0.5).cast("int")
    return p.select("vec_id", "label", F.expr("i div 8").alias("row"), (F.col("i") % 8).alias("col"), level(127.5).alias("v8"), level(32767.5).alias("v16"))


@query(f"""WITH {_DEPTHS}, c AS (SELECT vec_id, count(*) FILTER (v8 > 0) AS inside, count(*) FILTER (v8 > 0 AND v8 = (v16 + 128) // 257) AS identical, coalesce(max(abs(v8 - (v16 + 128) // 257)) FILTER (v8 > 0), 0)::bigint AS max_diff FROM depths GROUP BY 1),
m AS (SELECT vec_id, label, embedding[1] AS e, EXISTS (SELECT 1 FROM orders WHERE o_custkey = vec_id) AS has_file, EXISTS (SELECT 1 FROM pages WHERE page_id = vec_id // 2 + 5) AS has_source FROM embeddings)
SELECT vec_id, inside, identical, max_diff, CASE WHEN NOT has_file THEN 'MISSING' WHEN label % 4 = 3 THEN 'RESAMPLED' WHEN e < -0.1 THEN 'NO SOURCE BOX' WHEN NOT has_source THEN 'NO SOURCE'
  WHEN inside = identical THEN 'IDENTICAL' WHEN label % 2 = 0 AND label % 3 <> 0 AND max_diff <= 2 THEN 'MATCH' ELSE 'FAIL' END AS result FROM m JOIN c USING (vec_id)""")
def qa_crop_results(spark, sf_dir):
    d = _depths(spark, sf_dir).withColumn("source", pixelcheck.at_depth(F.col("v16"), F.lit(16), F.lit(8)))
    label, box = F.col("label"), F.get("embedding", F.lit(0)) >= F.lit(-0.1)
    m = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("crop_"), "vec_id").alias("raw_file"), F.when(label % 4 == 3, "rectify").otherwise("bbox").alias("raw_style"), F.concat(F.lit("photo_"), F.expr("vec_id div 2 + 5")).alias("source_path"),
        *[F.when(box, F.lit(k)).alias(k2) for k, k2 in ((0, "src_x0"), (0, "src_y0"), (8, "src_x1"), (8, "src_y1"))], F.lit(8).alias("bits"), (label % 2 == 0).alias("developed"), (label % 3 == 0).alias("neutral"),
    )
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("crop_"), "o_custkey").alias("file")).distinct()
    sources = table(spark, sf_dir, "pages").select(F.concat(F.lit("photo_"), "page_id").alias("path")).distinct()
    return pixelcheck.crop_results(m, files, sources, pixelcheck.pixel_counts(d, "vec_id", "v8", "source"), "vec_id").select("vec_id", "inside", "identical", "max_diff", "result")


@query(f"""WITH {_DEPTHS}, t AS (SELECT vec_id, min(label) AS label, bool_and(label % 2 = 1 OR v8 = (v16 + 128) // 257) AS same FROM depths WHERE row BETWEEN 1 AND 4 AND col BETWEEN 2 AND 5 GROUP BY 1)
  SELECT vec_id, CASE WHEN label % 5 = 0 THEN 'RESAMPLED' WHEN NOT same THEN 'FAIL' WHEN label % 2 = 1 THEN 'IDENTICAL' ELSE 'EXACT CONVERSION' END AS pixels FROM t""")
def qa_tile_pixels(spark, sf_dir):
    d = _depths(spark, sf_dir)
    own = F.when(F.col("label") % 2 == 1, F.col("v16")).otherwise(F.col("v8"))
    window = d.where("row between 1 and 4 and col between 2 and 5").select("vec_id", (F.col("row") - 1).alias("row"), (F.col("col") - 2).alias("col"), own.alias("value"))
    tiles = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("vec_id").alias("source_id"), F.lit(2).alias("x0"), F.lit(1).alias("y0"), F.lit(4).alias("w"), F.lit(4).alias("h"), F.when(F.col("label") % 5 == 0, 5).otherwise(4).alias("out_w"), F.lit(4).alias("out_h"),
        F.when(F.col("label") % 2 == 1, 16).otherwise(8).alias("bits"), F.lit(16).alias("src_bits"),
    )
    sources = d.select(F.col("vec_id").alias("source_id"), "row", "col", F.col("v16").alias("value"))
    return pixelcheck.tile_results(tiles, window, sources, "vec_id").select("vec_id", "pixels")


@query(f"SELECT result, count(*) AS n, sum(inside)::bigint AS inside, sum(identical)::bigint AS identical FROM ({ORACLES['qa_crop_results']}) GROUP BY 1")
def qa_counts_of_crop_results(spark, sf_dir):
    """How many crops have each result, of the results found on their pixels."""
    return qa_crop_results(spark, sf_dir).groupBy("result").agg(F.count("*").alias("n"), F.sum("inside").alias("inside"), F.sum("identical").alias("identical"))


@query(f"SELECT pixels, count(*) AS n FROM ({ORACLES['qa_tile_pixels']}) GROUP BY 1")
def qa_counts_of_tile_results(spark, sf_dir):
    return qa_tile_pixels(spark, sf_dir).groupBy("pixels").agg(F.count("*").alias("n"))


@query(f"""WITH {_DEPTHS} SELECT vec_id, count(*) FILTER (kept AND v8 > 0) AS kept_px, CASE WHEN bool_and(NOT kept OR v8 = 0 OR v8 = (v16 + 128) // 257) THEN 'IDENTICAL' ELSE 'FAIL' END AS pixels
  FROM (SELECT *, row >= 2 + col // 4 AS kept FROM depths WHERE row BETWEEN 2 AND 4) GROUP BY vec_id""")
def qa_row_images(spark, sf_dir):
    d = _depths(spark, sf_dir)
    strip = d.where("row between 2 and 4").select("vec_id", (F.col("row") - 2).alias("row"), "col", F.when(F.col("row") >= 2 + F.expr("col div 4"), F.col("v8")).otherwise(0).alias("value"))
    images = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").alias("source_id"), F.lit(0).alias("x0"), F.lit(2).alias("y0"))
    sources = d.select(F.col("vec_id").alias("source_id"), "row", "col", pixelcheck.at_depth(F.col("v16"), F.lit(16), F.lit(8)).alias("value"))
    return pixelcheck.row_image_results(images, strip, sources, "vec_id")


# ---------------------------------------------------------------- places of tiles and crops

_WINDOWS = "win AS (SELECT p_partkey AS id, 0.001::double * (1 + p_size % 7) AS a, 0.0002::double * (p_size % 3) AS b, 500.0::double + p_partkey AS c, 0.0001::double * (p_size % 5) AS d, -0.001::double * (1 + p_size % 4) AS e, 900.0::double - p_partkey AS f, p_partkey % 37 AS x, p_size AS y, 64.0::double + p_size AS w, 96.0::double AS h, p_retailprice AS price FROM part)"


def _windows(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    t = F.struct((0.001 * (1 + s % 7)).alias("a"), (0.0002 * (s % 3)).alias("b"), (500.0 + k).alias("c"), (0.0001 * (s % 5)).alias("d"), (-0.001 * (1 + s % 4)).alias("e"), (900.0 - k).alias("f"))
    return table(spark, sf_dir, "part").select(k.alias("id"), t.alias("t"), (k % 37).alias("x"), s.alias("y"), (64.0 + s).alias("w"), F.lit(96.0).alias("h"), F.col("p_retailprice").alias("price"))


@query(f"""WITH {_WINDOWS}, s AS (SELECT *, w / 63 AS sx, h / 63 AS sy FROM win), m AS (SELECT id, a * sx AS ta, b * sy AS tb, a * x + b * y + c AS tc, d * sx AS td, e * sy AS te, d * x + e * y + f AS tf FROM s)
  SELECT id, round(ta, 9) AS a, round(tb, 9) AS b, round(tc, 6) AS c, round(td, 9) AS d, round(te, 9) AS e, round(tf, 6) AS f, round(ta * (63 - 10) + tb * 3 + tc, 5) AS turned_x, round(td * (63 - 10) + te * 3 + tf, 5) AS turned_y FROM m""")
def tile_transforms(spark, sf_dir):
    t = _windows(spark, sf_dir).select("id", placing.tile_transform(F.col("t"), F.col("x"), F.col("y"), F.col("w") / 63, F.col("h") / 63).alias("t"))
    turned = t.select("id", "t", placing.at(placing.turned_transform(F.col("t"), F.lit(63.0)), F.lit(3.0), F.lit(10.0)).alias("q"))
    return turned.select("id", *[F.round(F.col("t")[k], 6 if k in "cf" else 9).alias(k) for k in "abcdef"], F.round("q.x", 5).alias("turned_x"), F.round("q.y", 5).alias("turned_y"))


@query(f"""WITH {_WINDOWS}, m AS (SELECT *, price % 3 / 100 AS n FROM win), o AS (SELECT id, abs(a * w / 63) AS px, a * n AS off FROM m)
  SELECT id, CASE WHEN off < 1e-6::double + px * 0.01::double THEN 'OK' ELSE 'WRONG' END AS georef, round(off, 9) AS off FROM o""")
def qa_tile_places(spark, sf_dir):
    w = _windows(spark, sf_dir)
    right = placing.tile_transform(F.col("t"), F.col("x"), F.col("y"), F.col("w") / 63, F.col("h") / 63)
    off = F.col("t.a") * (F.col("price") % 3 / 100)
    moved = w.withColumns({"off": off, "_r": right}).withColumn("tile", F.col("_r").withField("c", F.col("_r.c") + F.col("off")))
    found = placing.place_check(F.col("t"), F.col("tile"), F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(63.0), F.lit(63.0))
    return moved.select("id", F.split_part(found, F.lit(" "), F.lit(1)).alias("georef"), F.round("off", 9).alias("off"))


@query(f"""WITH {_WINDOWS}, p AS (SELECT *, sqrt(abs(a * e - b * d)) AS px FROM win)
  SELECT id, round(px * 0.3048::double * 1000, 6) AS mm_feet, round(px * sqrt(111320.0::double * cos(radians(((d * w / 2 + e * h / 2 + f) / 1e4::double))) * 110540.0::double) / 10, 3) AS mm_degrees FROM p""")
def crop_scales_affine(spark, sf_dir):
    w = _windows(spark, sf_dir)
    degrees = F.struct(*[(F.col("t")[k] / 1e4).alias(k) for k in "abcdef"])
    feet = placing.mm_per_pixel(F.col("t"), F.col("w"), F.col("h"), F.lit(False), F.lit(0.3048))
    return w.select("id", F.round(feet, 6).alias("mm_feet"), F.round(placing.mm_per_pixel(degrees, F.col("w"), F.col("h"), F.lit(True), F.lit(1.0)), 3).alias("mm_degrees"))


_QUADS = """quads AS (SELECT p_partkey AS id, p_size AS s, [0.0::double, 1.0::double + p_size / 20.0::double, 1.2::double + p_size / 20.0::double, 0.1::double] AS gx, [0.0::double, 0.1::double, 3.0::double, 2.9::double] AS gy,
  [0.0::double, 900 + 31.0::double * p_size, 980 + 33.0::double * p_size, 70] AS px, [0.0::double, 50, 2000 + 11.0::double * p_size, 1900] AS py FROM part),
edges AS (SELECT *, [sqrt((px[(i % 4) + 1] - px[i]) ** 2 + (py[(i % 4) + 1] - py[i]) ** 2) for i in range(1, 5)] AS pl, [sqrt((gx[(i % 4) + 1] - gx[i]) ** 2 + (gy[(i % 4) + 1] - gy[i]) ** 2) for i in range(1, 5)] AS gl FROM quads)"""


def _quads(spark, sf_dir):
    s = F.col("p_size")
    ring = lambda *p: F.array(*[F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "cast") else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not hasattr(y, "cast") else y.cast("double").alias("y")) for x, y in p])
    ground = ring((0.0, 0.0), (1.0 + s / 20.0, 0.1), (1.2 + s / 20.0, 3.0), (0.1, 2.9))
    pixels = ring((0.0, 0.0), (900 + 31.0 * s, 50.0), (980 + 33.0 * s, 2000 + 11.0 * s), (70.0, 1900.0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), s.alias("s"), ground.alias("ground"), pixels.alias("pixels"))


@query(f"WITH {_QUADS}, r AS (SELECT id, list_sort([pl[i] / gl[i] for i in range(1, 5)]) AS r FROM edges) SELECT id, round(r[4] / r[1], 6) AS aniso, round(r[3], 6) AS gsd FROM r")
def frame_edge_scales(spark, sf_dir):
    e = _quads(spark, sf_dir).select("id", placing.edge_scales(F.col("pixels"), F.col("ground")).alias("e"))
    return e.select("id", F.round("e.aniso", 6).alias("aniso"), F.round("e.gsd", 6).alias("gsd"))


@query(f"""WITH {_QUADS}, k AS (SELECT *, 111320.0::double * cos(radians(list_sum(gy) / 4)) AS mx, 110540.0::double AS my FROM quads),
l AS (SELECT *, [sqrt(((gx[(i % 4) + 1] - gx[i]) * mx) ** 2 + ((gy[(i % 4) + 1] - gy[i]) * my) ** 2) for i in range(1, 5)] AS m FROM k),
o AS (SELECT *, CASE WHEN m[1] + m[3] <= m[2] + m[4] THEN [2, 1, 4, 3] ELSE [4, 3, 2, 1] END AS other, CASE WHEN m[1] + m[3] <= m[2] + m[4] THEN [m[1], m[1], m[3], m[3]] ELSE [m[4], m[2], m[2], m[4]] END AS len FROM l)
SELECT id, i - 1 AS corner, round(gx[i] - (gx[other[i]] - gx[i]) * 5000 / len[i], 9) AS x, round(gy[i] - (gy[other[i]] - gy[i]) * 5000 / len[i], 9) AS y FROM o, range(1, 5) t(i)""")
def short_edges_pushed(spark, sf_dir):
    q = _quads(spark, sf_dir).select("id", F.posexplode(placing.short_edges_pushed(F.col("ground"), 5000.0)).alias("corner", "p"))
    return q.select("id", F.col("corner").cast("long").alias("corner"), F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


@query(f"""WITH {_QUADS}, r AS (SELECT *, CASE WHEN s % 3 > 0 THEN 1.0::double + s / 20.0::double END AS gw FROM edges)
  SELECT id, least(20000, greatest(1, round_even(CASE WHEN gw IS NOT NULL THEN gw * (400 * s) ELSE (pl[1] + pl[3]) / 2 END, 0)))::int AS w, least(20000, greatest(1, round_even(CASE WHEN gw IS NOT NULL THEN 3.0::double * (400 * s) ELSE (pl[4] + pl[2]) / 2 END, 0)))::int AS h FROM r""")
def rectified_sizes(spark, sf_dir):
    s = F.col("s")
    size = placing.rectified_size(F.when(s % 3 > 0, 1.0 + s / 20.0), F.lit(3.0), 400.0 * s, F.col("pixels"))
    return _quads(spark, sf_dir).select("id", size.alias("z")).select("id", "z.w", "z.h")


@query(f"""WITH {_QUADS}, g AS (SELECT id, i * 5 + j AS k, (1 - i / 4.0::double) * ((1 - j / 4.0::double) * px[1] + j / 4.0::double * px[2]) + i / 4.0::double * ((1 - j / 4.0::double) * px[4] + j / 4.0::double * px[3]) AS col,
    (1 - i / 4.0::double) * ((1 - j / 4.0::double) * py[1] + j / 4.0::double * py[2]) + i / 4.0::double * ((1 - j / 4.0::double) * py[4] + j / 4.0::double * py[3]) AS row FROM quads, range(5) a(i), range(5) b(j))
  SELECT id, count(*) AS points, round(sum(col), 4) AS col_sum FROM g WHERE col BETWEEN -0.5 AND 1200.5 AND row BETWEEN -0.5 AND 1500.5 GROUP BY id""")
def control_points_on_crop(spark, sf_dir):
    from fieldloom.functions.geometry import bilinear

    q = _quads(spark, sf_dir)
    grid = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: bilinear(F.col("pixels"), j / 4, i / 4))))
    points = F.transform(grid, lambda p: F.struct(p["x"].alias("col"), p["y"].alias("row")))
    kept = q.select("id", placing.points_on_crop(points, F.lit(1200), F.lit(1500)).alias("k")).where(F.size("k") > 0)
    return kept.select("id", F.size("k").cast("long").alias("points"), F.round(F.aggregate("k", F.lit(0.0), lambda s, p: s + p["col"]), 4).alias("col_sum"))


_FRAMES = "frames_ AS (SELECT s_suppkey AS b, 4.0::double * s_suppkey AS cx, 2.0::double * s_nationkey AS cy, cos(s_acctbal / 1000) AS ux, sin(s_acctbal / 1000) AS uy, -sin(s_acctbal / 1000) AS vx, cos(s_acctbal / 1000) AS vy FROM supplier)"


def _frames(spark, sf_dir):
    turn = F.col("s_acctbal") / 1000
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), (4.0 * F.col("s_suppkey")).alias("cx"), (2.0 * F.col("s_nationkey")).alias("cy"), F.cos(turn).alias("ux"), F.sin(turn).alias("uy"), (-F.sin(turn)).alias("vx"), F.cos(turn).alias("vy"))


@query(f"WITH {_FRAMES} SELECT f.b, round(CASE WHEN f.ux * r.ux + f.uy * r.uy < 0 THEN -f.ux ELSE f.ux END, 9) AS ux, round(CASE WHEN f.ux * r.ux + f.uy * r.uy < 0 THEN -f.vy ELSE f.vy END, 9) AS vy FROM frames_ f, (SELECT ux, uy FROM frames_ ORDER BY b LIMIT 1) r")
def frames_one_way(spark, sf_dir):
    return placing.frames_one_way(_frames(spark, sf_dir), "b").select("b", F.round("ux", 9).alias("ux"), F.round("vy", 9).alias("vy"))


@query(f"""WITH {_FRAMES}, l AS (SELECT l_orderkey, l_linenumber, l_suppkey + l_linenumber - 4 AS b, 4.0::double * l_suppkey AS x0, l_quantity AS y0, 4.0::double * l_suppkey + l_linenumber AS x1, l_quantity + 100 * l_discount - 4.5::double AS y1 FROM lineitem),
j AS (SELECT *, ((x0 + x1) / 2 - cx) * vx + ((y0 + y1) / 2 - cy) * vy AS v, (x1 - x0) * ux + (y1 - y0) * uy AS al, (x1 - x0) * vx + (y1 - y0) * vy AS ac FROM l JOIN frames_ USING (b))
SELECT l_orderkey, l_linenumber, round(v, 4) AS v_off_m, round(degrees(atan2(CASE WHEN al < 0 THEN -ac ELSE ac END, abs(al))), 3) AS angle_deg FROM j""")
def row_lines_in_frames(spark, sf_dir):
    k = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") + k - 4).alias("b"), (4.0 * F.col("l_suppkey")).alias("x0"), F.col("l_quantity").alias("y0"), (4.0 * F.col("l_suppkey") + k).alias("x1"), (F.col("l_quantity") + 100 * F.col("l_discount") - 4.5).alias("y1"))
    return placing.lines_in_frame(lines, _frames(spark, sf_dir), "b").select("l_orderkey", "l_linenumber", "v_off_m", "angle_deg")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 120 - 20 AS a0, 40 AS n, 90 AS across FROM lineitem), h AS (SELECT *, greatest(0, least(a0, across - n)) AS held FROM t)
  SELECT l_orderkey, l_linenumber, held AS a0, count(*) AS tiles FROM h WHERE abs(held - a0) <= 0.25 * n GROUP BY ALL""")
def row_tiles_on_crop(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 120 - 20).alias("a0"), F.lit(40).cast("long").alias("n"), F.lit(90).cast("long").alias("across"))
    return placing.on_crop(t, "a0", "n", "across").groupBy("l_orderkey", "l_linenumber", "a0").agg(F.count("*").alias("tiles"))


# ---------------------------------------------------------------- lookups of a run


@query("""WITH m AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'n/a' WHEN 'O' THEN '' ELSE (o_orderkey % 50 / 100.0::double)::varchar END AS margin FROM orders),
n AS (SELECT o_custkey, o_orderkey, try_cast(CASE WHEN margin = '' THEN '0' ELSE margin END AS double) AS v FROM m)
SELECT c_custkey, coalesce(v, 0) AS margin_m FROM customer LEFT JOIN (SELECT o_custkey, arg_max(v, o_orderkey) AS v FROM n WHERE v IS NOT NULL GROUP BY 1) ON o_custkey = c_custkey""")
def crop_margins(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderstatus") == "P", "n/a").when(F.col("o_orderstatus") == "O", "").otherwise((F.col("o_orderkey") % 50 / 100.0).cast("string"))
    manifest = o.select(F.col("o_custkey").alias("raw_file"), text.alias("margin_m"), F.col("o_orderkey").alias("ord"))
    crops = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("raw_file"))
    return placing.margins_of(crops, manifest).select(F.col("raw_file").alias("c_custkey"), "margin_m")


_CHUNKS = """chunks AS (SELECT o_custkey AS project, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, o_orderpriority AS label, o_orderstatus = 'O' AS active,
  CASE o_custkey % 5 WHEN 0 THEN '2-HIGH' WHEN 1 THEN 'active' WHEN 2 THEN '3' WHEN 3 THEN 'no such' ELSE '' END AS want FROM orders),
g AS (SELECT project, min(ord) FILTER (label = want) AS l0, max(ord) FILTER (label = want) AS l1, min(ord) FILTER (ord = try_cast(want AS int)) AS pl, min(ord) FILTER (active) AS ac, min(ord) AS fi, max(want) NOT IN ('', 'active') AS asked FROM chunks GROUP BY 1)"""


def _chunks(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("o_custkey") % 5
    want = F.when(k == 0, "2-HIGH").when(k == 1, "active").when(k == 2, "3").when(k == 3, "no such").otherwise("")
    ord_ = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), ord_.alias("ord"), F.col("o_orderpriority").alias("label"), (F.col("o_orderstatus") == "O").alias("active"), want.alias("want"))


@query(f"""WITH {_CHUNKS} SELECT * FROM (SELECT project, CASE WHEN l0 IS NOT NULL AND asked THEN l0 WHEN pl IS NOT NULL AND asked THEN pl WHEN NOT asked THEN coalesce(ac, fi) END AS ord,
  CASE WHEN l0 IS NOT NULL AND asked THEN 'label' WHEN pl IS NOT NULL AND asked THEN 'place' WHEN ac IS NOT NULL THEN 'active' ELSE 'first' END AS rule FROM g) WHERE ord IS NOT NULL""")
def chunks_chosen(spark, sf_dir):
    return placing.chosen_chunks(_chunks(spark, sf_dir), "project")


@query(f"""WITH {_CHUNKS} SELECT project, coalesce(l1, ac, fi) AS ord, CASE WHEN l1 IS NOT NULL THEN 'label' WHEN ac IS NOT NULL THEN 'active' ELSE 'first' END AS rule FROM g""")
def chunks_chosen_last(spark, sf_dir):
    return placing.chosen_chunks(_chunks(spark, sf_dir), "project", last_label=True)


@query("""WITH names AS (SELECT s_suppkey AS camera, lower(s_name) AS stem, s_suppkey * 2 AS place FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT s_suppkey, 'customer#' || lpad((s_nationkey * 7)::varchar, 9, '0'), s_suppkey * 2 + 1 FROM supplier WHERE s_acctbal >= 0)
  SELECT c_custkey, camera FROM customer LEFT JOIN (SELECT stem, arg_max(camera, place) AS camera FROM names GROUP BY 1) ON stem = lower(c_name)""")
def cameras_of_files(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("stem"))
    photo = F.concat(F.lit("Customer#"), F.lpad((F.col("s_nationkey") * 7).cast("string"), 9, "0"))
    cameras = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("camera"), F.col("s_name").alias("label"), photo.alias("photo_stem"), (F.col("s_acctbal") >= 0).alias("posed"), F.col("s_suppkey").alias("ord"))
    return placing.cameras_by_stem(files, cameras).select("c_custkey", "camera")


@query("""WITH r AS (SELECT o_custkey AS path, arg_max(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END, o_orderkey) AS section FROM orders GROUP BY 1)
  SELECT c_custkey, coalesce(nullif(a.section, ''), nullif(b.section, '')) AS section FROM customer LEFT JOIN r a ON a.path = c_custkey // 2 LEFT JOIN r b ON b.path = c_custkey""")
def upstream_recipes(spark, sf_dir):
    section = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority"))
    recipes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.max_by(section, "o_orderkey").alias("section"))
    folders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.expr("c_custkey div 2").alias("parent"))
    return placing.upstream_sections(folders, recipes).select(F.col("path").alias("c_custkey"), "section")


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id, CASE WHEN event_type = 'error' THEN 'undo' WHEN value > 95 THEN 'reset' ELSE 'set' END AS kind FROM events),
s AS (SELECT user_id, 0::bigint AS k, []::bigint[] AS st FROM (SELECT DISTINCT user_id FROM events) UNION ALL
  SELECT s.user_id, e.k, CASE e.kind WHEN 'reset' THEN []::bigint[] WHEN 'undo' THEN s.st[1:greatest(len(s.st) - 1, 0)] ELSE list_append(s.st, e.event_id) END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, (arg_max(st, k)[-1])::varchar AS value FROM s GROUP BY 1""")
def edits_undone(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "undo").when(F.col("value") > 95, "reset").otherwise("set")
    log = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"), F.col("event_id").alias("value"))
    return placing.last_state(log, "user_id", "event_id")
