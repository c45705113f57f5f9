"""Plots, frames, tiles and profiles derived from the given tables, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a small file is read by few tasks, whatever its rows cost."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-aligned plots of 1.0 to 1.04 by 4 m with alleys, 50 in a bank."""
    t = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    x0, y0 = 1.2 * (F.col("p_partkey") % 50), 4.5 * F.expr("p_partkey div 50")
    return t.select(F.col("p_partkey").alias("plot_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 1.0 + 0.01 * (F.col("p_size") % 5)).alias("x1"), (y0 + 4.0).alias("y1"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground rectangles of frames; aniso is the scale ratio, gsd pixels for each metre."""
    t = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    cx, cy = 6.0 * (F.col("s_suppkey") % 10) + 3, 18.0 * F.expr("s_suppkey div 10") + 11
    return t.select(
        F.col("s_suppkey").alias("camera"), (cx - 4).alias("fx0"), (cy - 9.5).alias("fy0"), (cx + 4).alias("fx1"), (cy + 9.5).alias("fy1"),
        (1 + F.abs("s_acctbal") / 20000).alias("aniso"), (1000.0 + 20 * F.col("s_nationkey")).alias("gsd"),
    )


def narrow_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames, with ground rectangles so small that gaps lie between them."""
    return cameras(spark, sf_dir).withColumns({"fx0": F.col("fx0") + 2.5, "fx1": F.col("fx1") - 2.5, "fy0": F.col("fy0") + 4.0, "fy1": F.col("fy1") - 4.0})


def rings(boxes: DataFrame, corners: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """boxes with ring, their corners in order."""
    a, b, c, d = (F.col(x) for x in corners)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return boxes.withColumn("ring", F.array(point(a, b), point(c, b), point(c, d), point(a, d)))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("plot_stem"), F.col("l_linenumber").alias("tile_k"), F.col("l_partkey").alias("x0"), F.col("l_suppkey").alias("y0"), F.col("l_quantity").cast("int").alias("w"), F.col("l_quantity").cast("int").alias("h"), (100 * F.col("l_discount")).alias("veg_pct"))


def rows_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return t.select(F.col("o_orderkey").alias("plot_stem"), (F.col("o_orderstatus") != "P").alias("ok"), (3 + F.col("o_custkey") % 5).alias("rows_found"), (200 + F.col("o_totalprice") % 40).alias("pitch_mm"), F.col("o_orderkey").alias("ord"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bin of a signal for each row."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 by 8 patches of one band, one pixel for each row."""
    p = profile(spark, sf_dir)
    return p.select("vec_id", F.expr("i div 8").alias("row"), (F.col("i") % 8).alias("col"), F.floor((F.col("v") + 1) * 127 + 0.5).cast("int").alias("value"))


#: The same views for DuckDB, as common table expressions.
VIEWS = {
    "plots": "SELECT p_partkey AS plot_id, 1.2::double * (p_partkey % 50) AS x0, 4.5::double * (p_partkey // 50) AS y0, 1.2::double * (p_partkey % 50) + 1.0::double + 0.01::double * (p_size % 5) AS x1, 4.5::double * (p_partkey // 50) + 4.0::double AS y1 FROM part",
    "cameras": "SELECT s_suppkey AS camera, 6.0::double * (s_suppkey % 10) + 3 - 4 AS fx0, 18.0::double * (s_suppkey // 10) + 11 - 9.5::double AS fy0, 6.0::double * (s_suppkey % 10) + 3 + 4 AS fx1, 18.0::double * (s_suppkey // 10) + 11 + 9.5::double AS fy1, 1 + abs(s_acctbal) / 20000 AS aniso, 1000.0::double + 20 * s_nationkey AS gsd FROM supplier",
    "tiles": "SELECT l_orderkey AS plot_stem, l_linenumber AS tile_k, l_partkey AS x0, l_suppkey AS y0, l_quantity::int AS w, l_quantity::int AS h, 100 * l_discount AS veg_pct FROM lineitem",
    "rows_report": "SELECT o_orderkey AS plot_stem, o_orderstatus <> 'P' AS ok, 3 + o_custkey % 5 AS rows_found, 200 + o_totalprice % 40 AS pitch_mm, o_orderkey AS ord FROM orders",
    "profile": "SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::double AS v FROM embeddings",
    "patches": "SELECT vec_id, i // 8 AS row, i % 8 AS col, floor((v + 1) * 127 + 0.5)::int AS value FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::double AS v FROM embeddings)",
}


def with_views(*names: str, body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + body
