"""Where crops lie on the ground: by an affine transform of their control points, or by the points themselves; footprints of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.checks import affine_residuals

# Names of tags that readers of these crops look for, and the distance in metres that is worth a warning.
POINTS_TAG, SYSTEM_TAG, RESIDUAL_TAG, WARN_M = "PE_GCPS", "PE_GCPS_EPSG", "PE_AFFINE_RESID", 0.05
# Metres in a degree, the least reach of a footprint, its surplus, and how far beyond the view a point may lie.
M_LON, M_LAT, LEAST_REACH, SURPLUS, VIEW = 111320.0, 110540.0, 2.0, 1.15, 1.05


def georeferenced(files: DataFrame, points: DataFrame, by: str) -> DataFrame:
    """files (by, epsg, projected) with kind, transform, gcps, tags and note.

    points: by, row, col, x, y, z, in the file's system.  kind is "affine"
    where the system is projected and the points give a fit (transform is a,
    b, c, d, e, f; the points and the fit's residuals are tags), "gcps" where
    there are points without one (they are kept in order of row and col), and
    "none" without any.  note says what is worth a warning, else it is empty.
    A file has a few dozen points.
    """
    fit = affine_residuals(points, by).select(by, F.array("a", "b", "c", "d", "e", "f").alias("_t"), F.col("a").isNotNull().alias("_fits"), "mean_off", "max_off")
    held = points.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*[F.col(k).cast("double").alias(k) for k in ("row", "col", "x", "y", "z")]))).alias("_p"))
    all_ = files.join(held, by, "left").join(fit, by, "left")
    n = F.coalesce(F.size("_p"), F.lit(0))
    all_ = all_.withColumn("kind", F.when(F.col("_p").isNull(), "none").when(F.col("projected") & F.col("_fits"), "affine").otherwise("gcps"))
    affine, points_only = F.col("kind") == "affine", F.col("kind") == "gcps"
    text = F.to_json(F.transform("_p", lambda p: F.array(p.row, p["col"], p.x, p.y, p.z)))
    residual = F.format_string("mean=%.2fmm max=%.2fmm n=%d", F.col("mean_off") * 1000, F.col("max_off") * 1000, n)
    tags = F.create_map(F.lit(POINTS_TAG), text, F.lit(SYSTEM_TAG), F.col("epsg").cast("string"), F.lit(RESIDUAL_TAG), residual)
    note = (
        F.when(F.col("kind") == "none", "no control points landed inside the crop")
        .when(affine & (F.col("max_off") > WARN_M), F.format_string("affine residual up to %.1f cm", F.col("max_off") * 100))
        .when(points_only & F.col("projected"), "affine fit failed: control points only")
        .otherwise("")
    )
    return all_.select(*files.columns, "kind", F.when(affine, F.col("_t")).alias("transform"), F.when(points_only, F.col("_p")).alias("gcps"), F.when(affine, tags).alias("tags"), note.alias("note"))


def frame_footprints(frames: DataFrame, heights: DataFrame | None = None, cell: float = 1.0, n: int = 15) -> DataFrame:
    """(camera, row, col, x, y, z): a grid of n by n ground points about each frame, those that the frame sees.

    frames: camera; x, y, z of its position; rotation (nine numbers, world to
    camera, by rows); f, sw, sh (focal length and sensor in pixels), cx, cy
    (the principal point off the sensor's middle), k1, k2 (radial distortion);
    out_w, out_h (the picture's size); ground_z, and geographic (degrees).
    heights (gx, gy, height) are the ground's by cells of a side, met by
    equality; ground_z stands in where a cell has none, and is the ground
    under the camera.  The grid reaches 1.15 times as far as the view, at
    least 2 m.  A point must lie in front of the camera and, before
    distortion, within 1.05 of the view: distortion can fold far ones back.
    """
    hx, hy = 0.5 * F.col("sw") / F.col("f"), 0.5 * F.col("sh") / F.col("f")
    reach = F.greatest(F.lit(LEAST_REACH), SURPLUS * F.abs(F.col("z") - F.col("ground_z")) * F.greatest(hx, hy))
    mx = F.when(F.col("geographic"), M_LON * F.cos(F.radians("y"))).otherwise(1.0)
    my = F.when(F.col("geographic"), M_LAT).otherwise(1.0)
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    g = frames.withColumns({"_hx": hx, "_hy": hy, "_reach": reach, "_mx": mx, "_my": my}).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    off = lambda k: -F.col("_reach") + 2 * F.col("_reach") * F.col(k) / (n - 1)
    g = g.withColumns({"_x": F.col("x") + off("_i") / F.col("_mx"), "_y": F.col("y") + off("_j") / F.col("_my")})
    if heights is None:
        g = g.withColumn("_z", F.col("ground_z"))
    else:
        g = g.withColumns({"_gx": F.floor(F.col("_x") / cell), "_gy": F.floor(F.col("_y") / cell)})
        known = heights.select(F.col("gx").cast("long").alias("_gx"), F.col("gy").cast("long").alias("_gy"), F.col("height").alias("_h"))
        g = g.join(known, ["_gx", "_gy"], "left").withColumn("_z", F.coalesce(F.when(~F.isnan("_h"), F.col("_h")), F.col("ground_z")))
    r = lambda k: F.get("rotation", F.lit(k))
    dx, dy, dz = (F.col("_x") - F.col("x")) * F.col("_mx"), (F.col("_y") - F.col("y")) * F.col("_my"), F.col("_z") - F.col("z")
    seen = lambda k: r(k) * dx + r(k + 1) * dy + r(k + 2) * dz
    g = g.withColumns({"_px": seen(0), "_py": seen(3), "_pz": seen(6)}).where("_pz > 0")
    g = g.withColumns({"_u": F.col("_px") / F.col("_pz"), "_v": F.col("_py") / F.col("_pz")}).where((F.abs("_u") <= VIEW * F.col("_hx")) & (F.abs("_v") <= VIEW * F.col("_hy")))
    r2 = F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v")
    bend = 1 + F.col("k1") * r2 + F.col("k2") * r2 * r2
    place = lambda side, out, at, middle: (F.col(side) * 0.5 + F.col(middle) + F.col("f") * F.col(at) * bend) * F.col(out) / F.col(side)
    g = g.select("camera", "out_w", "out_h", place("sh", "out_h", "_v", "cy").alias("row"), place("sw", "out_w", "_u", "cx").alias("col"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z"))
    return g.where(F.col("col").between(0, F.col("out_w")) & F.col("row").between(0, F.col("out_h"))).drop("out_w", "out_h")
