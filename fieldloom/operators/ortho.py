"""Crops of an orthophoto, as blocks: masked to their plot or with its white made black, their coverage, and what stands in for poor photo crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.geometry import contains, let

# The least sample of uncovered white, the sum of a pixel that counts as black, and what a stand-in is called.
WHITE, BLACK_SUM, FALLBACK_STYLE = 235, 24, "ortho-fallback"
FALLBACK_NOTE = "ortho-fallback: field-edge, no near-nadir raw frame; rebuilt from orthomosaic crop (nodata=black)"


def _of_cell(bands: Column, n: int, f) -> Column:
    """f of all bands' samples of each cell, by place."""
    first = F.get(bands, F.lit(0))
    return F.transform(first, lambda v, k: f([v, *[F.get(F.get(bands, F.lit(b)), k) for b in range(1, n)]]))


def _count(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: v))


def masked_blocks(blocks: DataFrame, plots: DataFrame, by: str, n_bands: int = 3) -> DataFrame:
    """Blocks (by, x0, y0, w, bands) with cells outside their plot's ring (by, ring; in image columns and rows) made 0, n_inside and n_valid.

    A cell is inside by its middle; it is valid where it is inside and a band
    isn't 0.  Cells stay in their block's arrays, so the join is one of blocks
    with rings.  Blocks without a plot are left out.
    """
    joined = blocks.join(plots.select(by, "ring"), by)
    k = lambda i: (F.col("x0") + i % F.col("w") + 0.5, F.col("y0") + F.floor(i / F.col("w")) + 0.5)
    inside = joined.withColumn("_in", F.transform(F.get("bands", F.lit(0)), lambda v, i: contains(F.col("ring"), *k(i))))
    kept = F.transform("bands", lambda b: F.zip_with(b, "_in", lambda v, yes: F.when(yes, v).otherwise(F.lit(0))))
    kept = inside.withColumn("bands", kept)
    valid = _of_cell(F.col("bands"), n_bands, lambda v: F.greatest(*v) > 0 if len(v) > 1 else v[0] > 0)
    return kept.withColumns({"n_inside": _count(F.col("_in")), "n_valid": _count(valid)}).drop("_in", "ring")


def blackened_blocks(blocks: DataFrame, n_bands: int = 3) -> DataFrame:
    """Blocks with cells whose bands are all over 235 made 0, n_cells, n_valid (neither black nor white) and n_black (samples that then sum up to under 24)."""
    low = lambda v: F.least(*v) if len(v) > 1 else v[0]
    white = blocks.withColumn("_white", _of_cell(F.col("bands"), n_bands, lambda v: low(v) > WHITE))
    done = white.withColumn("bands", F.transform("bands", lambda b: F.zip_with(b, "_white", lambda v, yes: F.when(yes, F.lit(0)).otherwise(v))))
    total = lambda v: sum(v[1:], v[0])
    sums = _of_cell(F.col("bands"), n_bands, total)
    counts = let(sums, lambda s: F.struct(F.size(F.filter(s, lambda v: v > 0)).alias("valid"), F.size(F.filter(s, lambda v: v < BLACK_SUM)).alias("black")))
    return done.withColumn("_n", counts).withColumns({"n_cells": F.size("_white"), "n_valid": F.col("_n.valid"), "n_black": F.col("_n.black")}).drop("_white", "_n")


def coverage(blocks: DataFrame, by: str, part: str, whole: str) -> DataFrame:
    """(by, covered_pct): counts of blocks summed up; 0 where the whole is nothing."""
    share = 100.0 * F.sum(part) / F.nullif(F.sum(whole), F.lit(0))
    return blocks.groupBy(by).agg(F.coalesce(share, F.lit(0.0)).alias("covered_pct"))


def with_fallback(manifest: DataFrame, blocks: DataFrame, by: str, least_pct: float) -> DataFrame:
    """The manifest, with plots whose photo crops cover under least_pct (or that have none) taken from their orthophoto crop.

    blocks are blackened_blocks'.  crop_w, crop_h, raw_covered_pct,
    source_path, raw_style, note and src_x0 to src_y1 are those of the
    stand-in, as the crop that it replaces has no place in a photo; without an
    orthophoto crop the row stays as it is.  fallback says which of the two.
    """
    end = lambda a, n: F.max(F.col(a) + F.col(n)).cast("int")
    crops = blocks.groupBy(by).agg(end("x0", "w").alias("_w"), end("y0", "h").alias("_h"), F.round(100 - 100.0 * F.sum("n_black") / F.sum("n_cells"), 1).alias("_pct"))
    low = F.coalesce(F.col("raw_covered_pct") < least_pct, F.lit(True))
    joined = manifest.join(crops, by, "left").withColumn("fallback", F.when(~low, "").when(F.col("_w").isNull(), "skipped").otherwise("replaced"))
    new = {"crop_w": F.col("_w"), "crop_h": F.col("_h"), "raw_covered_pct": F.col("_pct"), "source_path": F.col("ortho_file"), "raw_style": F.lit(FALLBACK_STYLE), "note": F.lit(FALLBACK_NOTE), **{f"src_{k}": F.lit(None) for k in ("x0", "y0", "x1", "y1")}}
    return joined.select(*[F.when(F.col("fallback") == "replaced", new[c].cast(joined.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in manifest.columns], "fallback")
