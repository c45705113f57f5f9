"""Crops, tiles and row images held against the pixels that they were cut from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import labels

# Fixed value: a development with noise reduction may differ by this much in 8 bits.
NOISE_TOLERANCE = 2


def at_depth(value: Column, bits: Column, wanted: Column) -> Column:
    """A pixel of one depth (8 or 16 bits) at another."""
    return F.when(bits == wanted, value).when(wanted == 8, labels.to_8_bit(value)).otherwise(labels.to_16_bit(value))


def pixel_counts(pairs: DataFrame, by: str, mine: str, theirs: str) -> DataFrame:
    """(by, inside, identical, max_diff, missing) of pixel pairs; a pixel is inside where mine is over 0, and missing where theirs is null."""
    inside, diff = F.col(mine) > 0, F.abs(F.col(mine).cast("long") - F.col(theirs))
    count = lambda c: F.count(F.when(c, 1))
    return pairs.groupBy(by).agg(count(inside).alias("inside"), count(inside & (diff == 0)).alias("identical"), F.coalesce(F.max(F.when(inside, diff)), F.lit(0)).cast("long").alias("max_diff"), count(F.col(theirs).isNull()).alias("missing"))


def crop_results(manifest: DataFrame, files: DataFrame, sources: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """manifest with inside, identical, max_diff and result of each crop.

    manifest: by, raw_file, raw_style, source_path, src_x0, src_y0, src_x1,
    src_y1, bits, developed (from a raw file), neutral.  files (file) and
    sources (path) are what is there, each once; counts come from pixel_counts.
    By the first that holds: MISSING (no file), RESAMPLED (rectified), NO SOURCE BOX, NO
    SOURCE, ERROR (nothing was compared), FAIL (a pixel of the box is not
    there), IDENTICAL, MATCH (a developed crop within the tolerance of its
    depth, where the settings aren't neutral), else FAIL.
    """
    out = manifest.join(files.select(F.col("file").alias("raw_file"), F.lit(True).alias("_file")), "raw_file", "left")
    out = out.join(sources.select(F.col("path").alias("source_path"), F.lit(True).alias("_source")), "source_path", "left").join(counts, by, "left")
    box = F.col("src_x0").isNotNull() & F.col("src_y0").isNotNull() & F.col("src_x1").isNotNull() & F.col("src_y1").isNotNull()
    near = F.col("developed") & ~F.col("neutral") & (F.col("max_diff") <= NOISE_TOLERANCE * F.when(F.col("bits") == 16, 257).otherwise(1))
    result = (
        F.when(F.col("_file").isNull(), "MISSING").when(F.col("raw_style") == "rectify", "RESAMPLED").when(~box, "NO SOURCE BOX").when(F.col("_source").isNull(), "NO SOURCE")
        .when(F.col("inside").isNull(), "ERROR").when(F.col("missing") > 0, "FAIL").when(F.col("inside") == F.col("identical"), "IDENTICAL").when(near, "MATCH").otherwise("FAIL")
    )
    return out.withColumn("result", result).drop("_file", "_source", "missing")


def tile_results(tiles: DataFrame, pixels: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """tiles with pixels: RESAMPLED (another size than its window), ERROR (no pixels), IDENTICAL, EXACT CONVERSION (another depth) or FAIL.

    tiles: by, source_id, x0, y0, w, h, out_w, out_h, bits, src_bits.  pixels:
    by, row, col, value.  sources: source_id, row, col, value.  Tiles of
    another size send no pixels.
    """
    same_size = (F.col("w") == F.col("out_w")) & (F.col("h") == F.col("out_h"))
    placed = pixels.join(tiles.where(same_size).select(by, "source_id", "x0", "y0", "bits", "src_bits"), by)
    placed = placed.select(by, "source_id", "bits", "src_bits", (F.col("row") + F.col("y0")).alias("row"), (F.col("col") + F.col("x0")).alias("col"), F.col("value").alias("tile"))
    both = placed.join(sources.select("source_id", "row", "col", F.col("value").alias("_v")), ["source_id", "row", "col"], "left")
    equal = F.coalesce(F.col("tile") == at_depth(F.col("_v"), F.col("src_bits"), F.col("bits")), F.lit(False))
    seen = both.groupBy(by).agg(F.min(equal).alias("_same"), F.count("*").alias("_n"))
    found = F.when(~same_size, "RESAMPLED").when(F.col("_n").isNull(), "ERROR").when(~F.col("_same") | (F.col("_n") != F.col("w") * F.col("h")), "FAIL").when(F.col("bits") == F.col("src_bits"), "IDENTICAL").otherwise("EXACT CONVERSION")
    return tiles.join(seen, by, "left").withColumn("pixels", found).drop("_same", "_n")


def row_image_results(images: DataFrame, pixels: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """(by, kept_px, pixels): IDENTICAL where all pixels over 0 of a row image equal those of its box, else FAIL; an image without pixels is ERROR.

    images: by, source_id, x0, y0.
    """
    placed = pixels.join(images.select(by, "source_id", "x0", "y0"), by).select(by, "source_id", (F.col("row") + F.col("y0")).alias("row"), (F.col("col") + F.col("x0")).alias("col"), F.col("value").alias("mine"))
    both = placed.join(sources.select("source_id", "row", "col", F.col("value").alias("theirs")), ["source_id", "row", "col"], "left")
    counts = pixel_counts(both, by, "mine", "theirs")
    out = images.join(counts, by, "left")
    return out.select(by, F.coalesce("inside", F.lit(0)).cast("long").alias("kept_px"), F.when(F.col("inside").isNull(), "ERROR").when((F.col("identical") == F.col("inside")) & (F.col("missing") == 0), "IDENTICAL").otherwise("FAIL").alias("pixels"))
