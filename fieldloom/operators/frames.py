"""Frame selection: plots joined to the frames that see them, scored, ranked and picked."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the ranking.
WHOLE, INSET_PX, DEMOTE, ANISO_OK, COVER_OK, REPORT = 0.999, 8.0, 0.7, 1.5, 0.5, 12
TIERS = (1.06, 1.20, 1.50)
#: Side of the join's grid cells in metres, about the size of a frame.
CELL_X, CELL_Y = 8.0, 19.0


def _covered(lo: Column, hi: Column, cell: float) -> Column:
    return F.sequence(F.floor(lo / cell), F.floor(hi / cell))


def box_join(plots: DataFrame, frames: DataFrame, cell_x: float = CELL_X, cell_y: float = CELL_Y) -> DataFrame:
    """All pairs of a plot (x0, y0, x1, y1) and a frame (fx0, fy0, fx1, fy1) that overlap, each once.

    Both sides go to the grid cells that they touch and meet by equality; the
    cell that has the lower left corner of the overlap keeps the pair, so no
    distinct is needed.  Cells are near the size of a frame, so a box has few.
    """
    spread = lambda df, a, b, c, d: df.withColumn("cell_x", F.explode(_covered(F.col(a), F.col(c), cell_x))).withColumn("cell_y", F.explode(_covered(F.col(b), F.col(d), cell_y)))
    pairs = spread(plots, "x0", "y0", "x1", "y1").join(spread(frames, "fx0", "fy0", "fx1", "fy1"), ["cell_x", "cell_y"])
    meets = (F.col("x0") < F.col("fx1")) & (F.col("fx0") < F.col("x1")) & (F.col("y0") < F.col("fy1")) & (F.col("fy0") < F.col("y1"))
    home = (F.floor(F.greatest("x0", "fx0") / cell_x) == F.col("cell_x")) & (F.floor(F.greatest("y0", "fy0") / cell_y) == F.col("cell_y"))
    return pairs.where(meets & home).drop("cell_x", "cell_y")


def score(pairs: DataFrame, margin: float = 0.1) -> DataFrame:
    """pairs with coverage, area, corners in frame, clearance, centre distance and overshoot, in pixels of the frame."""
    w, h = (F.col("fx1") - F.col("fx0")) * F.col("gsd"), (F.col("fy1") - F.col("fy0")) * F.col("gsd")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    seen = (F.least("x1", "fx1") - F.greatest("x0", "fx0")) * (F.least("y1", "fy1") - F.greatest("y0", "fy0"))
    u = {k: (F.col(k) - F.col("fx0")) * F.col("gsd") for k in ("x0", "x1")}
    v = {k: (F.col(k) - F.col("fy0")) * F.col("gsd") for k in ("y0", "y1")}
    m = margin * F.col("gsd")
    within = lambda a, size: ((a >= 0) & (a < size)).cast("int")
    corners = sum((within(a, w) * within(b, h) for a in u.values() for b in v.values()), F.lit(0))
    clear = (u["x0"] - m >= INSET_PX) & (u["x1"] + m <= w - INSET_PX) & (v["y0"] - m >= INSET_PX) & (v["y1"] + m <= h - INSET_PX)
    over = F.greatest(-u["x0"], u["x1"] - w, -v["y0"], v["y1"] - h, F.lit(0.0))
    dist = F.hypot((u["x0"] + u["x1"]) / 2 - w / 2, (v["y0"] + v["y1"]) / 2 - h / 2) / (F.hypot(w, h) / 2)
    return pairs.withColumns({"area": area, "cov": seen / area, "corners": corners, "clear": clear, "dist": F.round(dist, 4), "over": F.round(over, 3)})


def tier(aniso: Column) -> Column:
    out = F.lit(len(TIERS))
    for i, most in reversed(list(enumerate(TIERS))):
        out = F.when(aniso <= most, i).otherwise(out)
    return out


def best_scale(by: str = "plot_id") -> Column:
    """The plot's best scale: of upright frames, else of those that see half of it, else 0."""
    w = Window.partitionBy(by)
    upright = F.max(F.when(F.col("aniso") <= ANISO_OK, F.col("gsd"))).over(w)
    half = F.max(F.when(F.col("cov") >= COVER_OK, F.col("gsd"))).over(w)
    return F.coalesce(F.nullif(upright, F.lit(0.0)), half, F.lit(0.0))


def rank_frames(scored: DataFrame, mode: str = "whole_first") -> DataFrame:
    """scored with rank from 1 for each plot, whole plots first, coarse frames demoted; ties keep the camera order.

    mode: whole_first; best (coverage alone); tiered (coverage tiers first).
    """
    cov4 = F.round("cov", 4)
    whole = F.col("cov") >= WHOLE
    low = (F.col("gsd") < DEMOTE * best_scale()).cast("int")
    clear = -F.col("clear").cast("int")
    if mode == "best":
        keys = [-cov4, F.round("aniso", 3), F.round("dist", 3)]
    elif mode == "tiered":
        step = F.when(F.col("cov") >= 0.75, 0).when(F.col("cov") >= 0.5, 1).otherwise(2)
        keys = [tier(F.col("aniso")) + step + low, -cov4, clear, F.col("dist"), F.col("over")]
    else:
        keys = [
            F.when(whole, 0).otherwise(1), F.when(whole, tier(F.col("aniso")).cast("double")).otherwise(-cov4) + low,
            F.when(whole, clear).otherwise(tier(F.col("aniso"))), F.col("dist"), F.col("over"),
        ]
    scored = scored.withColumns({f"k{i}": k for i, k in enumerate(keys)})
    order = [f"k{i}" for i in range(len(keys))]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("plot_id").orderBy(*order, "camera"))).drop(*order)


def candidates(ranked: DataFrame, top: int = REPORT) -> DataFrame:
    """The report: the first frames of each plot."""
    used = F.first("camera").over(Window.partitionBy("plot_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.where(F.col("rank") <= top).select(
        "plot_id", "rank", "camera", F.round(100 * F.col("cov"), 1).alias("cover_pct"), F.round(F.col("cov") * F.col("area"), 3).alias("cover_m2"), F.col("corners").alias("corners_in_frame"),
        F.round("aniso", 3).alias("aniso"), F.round(1000 / F.col("gsd"), 3).alias("mm_per_px"), (F.col("camera") == used).alias("used"),
    )


def manifest(plots: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row for each plot: its first frame, the best covering one, the number of candidates, or a note."""
    per = ranked.groupBy("plot_id").agg(
        F.count("*").alias("cand_frames"), F.min_by(F.struct("camera", "cov", "corners"), "rank").alias("one"), F.max_by(F.struct("camera", "cov"), F.struct("cov", -F.col("rank"))).alias("best")
    )
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return plots.join(per, "plot_id", "left").select(
        "plot_id", F.round(area, 3).alias("plot_area_m2"), F.coalesce("cand_frames", F.lit(0)).alias("cand_frames"), F.col("one.camera").alias("raw_image"), F.col("one.corners").alias("corners_in_frame"),
        F.round(100 * F.col("one.cov"), 1).alias("raw_covered_pct"), F.col("best.camera").alias("best_frame"), F.round(100 * F.col("best.cov"), 1).alias("best_cover_pct"),
        F.when(F.col("cand_frames").isNull(), "no covering raw image").otherwise("").alias("note"),
    )


def cover_sets(ranked: DataFrame, n_x: int = 5, n_y: int = 13, most: int = 8) -> DataFrame:
    """plot_id, frames (in pick order), covered (nodes): the fewest frames that cover a plot's nodes, greedily.

    Starts from rank 1; then the frame with the most new nodes (the first on
    ties) joins, until all nodes are covered, nothing is gained or most frames
    are used.  A plot has few candidates (a pool of max(2*most, 12)).
    """
    pool = ranked.where(F.col("rank") <= max(2 * most, REPORT))
    x = lambda k: F.col("x0") + (F.col("x1") - F.col("x0")) * ((k % n_x) / (n_x - 1))
    y = lambda k: F.col("y0") + (F.col("y1") - F.col("y0")) * (F.floor(k / n_x) / (n_y - 1))
    sees = lambda k: (x(k) >= F.col("fx0")) & (x(k) < F.col("fx1")) & (y(k) >= F.col("fy0")) & (y(k) < F.col("fy1"))

    def mask(a: int, b: int) -> Column:
        """Nodes a to b that the frame sees, as bits."""
        bits = F.transform(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(1 << (k - a)).cast("bigint").alias("bit")) for k in range(a, b)]), lambda s: F.when(sees(s.k), s.bit).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda m, v: m.bitwiseOR(v))

    words = [(a, min(a + 60, n_x * n_y)) for a in range(0, n_x * n_y, 60)]
    each = pool.select("plot_id", F.struct("rank", "camera", F.array(*[mask(a, b) for a, b in words]).alias("m")).alias("f")).groupBy("plot_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    total = lambda m: F.aggregate(m, F.lit(0), lambda n, w: n + F.bit_count(w))
    gain = lambda m, have: total(F.zip_with(m, have, lambda w, h: w.bitwiseAND(F.bitwise_not(h))))

    def step(s, _):
        """The frame with the most new nodes, the first of equals, joins; none where nothing is new."""
        best = F.array_max(F.transform(F.col("fs"), lambda f: F.struct(gain(f.m, s.have).alias("gain"), (-f["rank"]).alias("rank"), f.camera.alias("camera"), f.m.alias("m"))))
        more = best.gain > 0
        return F.struct(F.when(more, F.zip_with(s.have, best.m, lambda h, w: h.bitwiseOR(w))).otherwise(s.have).alias("have"), F.when(more, F.concat(s.used, F.array(best.camera))).otherwise(s.used).alias("used"))

    first = F.struct(F.get("fs", F.lit(0))["m"].alias("have"), F.array(F.get("fs", F.lit(0))["camera"]).alias("used"))
    done = each.select("plot_id", F.aggregate(F.sequence(F.lit(2), F.lit(most)), first, step).alias("s"))
    return done.select("plot_id", F.array_join("s.used", ",").alias("frames"), total(F.col("s.have")).alias("covered"))


def by_priority(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(id, path) of the first key, by prio, that index (key, path, ord) has; of equal keys the first file wins."""
    first = index.groupBy("key").agg(F.min_by("path", "ord").alias("path"))
    found = keys.join(first, "key", "left").where("path is not null")
    chosen = found.groupBy("id").agg(F.min_by("path", "prio").alias("path"), F.min("prio").alias("prio"))
    return keys.select("id").distinct().join(chosen, "id", "left")


