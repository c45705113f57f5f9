"""Rows of a plot from its ridge signal: a comb of even teeth, its contrast, and the choice between two greens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.geometry import let

# Fixed value: excess green of clearly green pixels.
GREEN_FLOOR = 0.05


def _add(x: Column) -> Column:
    """Sum of an array without its nulls; 0 of none."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def _around(sig: Column, n: Column, first: Column, step: Column, pos: Column, half: Column) -> Column:
    """Mean of the bins nearer pos than half, null where there are none; bin i lies at first + i * step."""
    lo = F.greatest(F.lit(0).cast("bigint"), F.floor((pos - half - first) / step) + 1)
    hi = F.least(n.cast("bigint") - 1, F.ceil((pos + half - first) / step) - 1)
    return F.when(hi >= lo, _add(F.slice(sig, (lo + 1).cast("int"), (hi - lo + 1).cast("int"))) / (hi - lo + 1))


def comb_rows(signals: DataFrame, by: str, edge_gap: float) -> DataFrame:
    """(by, k, pos, contrast, present): the comb of even rows that fits each signal best.

    signals: by, sig (array of evenly spaced bins), first and step (place of
    bin 0 and distance between bins), lo, hi (span to fill), pitch.  As many
    teeth as fit are tried at offsets of half a step (or a 200th of the pitch)
    around the middle, no further than edge_gap beyond the span; the score is
    the sum at the teeth less that between them, the first of equals wins.
    contrast is a tooth's value less the mean of the two gaps beside it; a row
    is present where that is above 0.  No rows without a pitch or a tooth.
    """
    half_pitch = F.col("pitch") / 2
    s = signals.where("pitch > 0").withColumns({"_n": F.size("sig"), "_teeth": (F.bround((F.col("hi") - F.col("lo") - half_pitch) / F.col("pitch")) + 1).cast("int"), "_half": F.greatest("step", 0.12 * F.col("pitch")), "_by": F.greatest(F.col("step") / 2, F.col("pitch") / 200)})
    s = s.where("_teeth >= 1").withColumn("_zero", (F.col("lo") + F.col("hi")) / 2 - (F.col("_teeth") - 1) * half_pitch)
    value = lambda pos: _around(F.col("sig"), F.col("_n"), F.col("first"), F.col("step"), pos, F.col("_half"))
    tooth = lambda start, k: start + k * F.col("pitch")
    at = F.sequence(F.lit(0), F.col("_teeth") - 1)
    offsets = F.transform(F.sequence(F.lit(0), F.ceil(F.col("pitch") / F.col("_by")).cast("int") - 1), lambda i: F.struct(i.alias("i"), (F.col("_zero") - half_pitch + i * F.col("_by")).alias("start")))
    inside = F.filter(offsets, lambda o: (o.start >= F.col("lo") - edge_gap) & (tooth(o.start, F.col("_teeth") - 1) <= F.col("hi") + edge_gap))
    gaps = F.slice(at, 1, F.col("_teeth") - 1)
    score = lambda o: _add(F.transform(at, lambda k: value(tooth(o.start, k)))) - _add(F.transform(gaps, lambda k: value(tooth(o.start, k) + half_pitch)))
    best = F.array_max(F.transform(inside, lambda o: F.struct(F.round(score(o), 9).alias("score"), (-o.i).alias("i"), o.start.alias("start"))))
    s = s.withColumn("_best", best).where("_best is not null")

    def contrast(pos: Column) -> Column:
        """The tooth less the mean of the gaps beside it that have bins."""
        sides = F.array_compact(F.array(value(pos - half_pitch), value(pos + half_pitch)))
        return let(sides, lambda x: value(pos) - _add(x) / F.nullif(F.size(x), F.lit(0)))

    teeth = F.transform(at, lambda k: let(tooth(F.col("_best.start"), k), lambda pos: F.struct((k + 1).alias("k"), pos.alias("pos"), contrast(pos).alias("contrast"))))
    out = s.select(by, F.explode(teeth).alias("t")).select(by, "t.*")
    return out.withColumn("present", F.coalesce(F.col("contrast") > 0, F.lit(False)))


def green_contrast(rows: DataFrame, by: str) -> DataFrame:
    """(by, ok, green_contrast) of each signal's rows: the mean contrast of the present ones, ok where there are any."""
    seen = F.when(F.col("present"), F.col("contrast"))
    return rows.groupBy(by).agg((F.count(seen) > 0).alias("ok"), F.avg(seen).alias("green_contrast"))


def greener(first: DataFrame, second: DataFrame, by: str) -> DataFrame:
    """(by, branch, green_contrast) of two detections (by, ok, green_contrast; first has threshold too).

    first stands, unless its threshold is below GREEN_FLOOR, second is ok and
    first is not ok or has a smaller contrast (none counts as -1).
    """
    d1 = second.select(by, F.col("ok").alias("_ok"), F.col("green_contrast").alias("_green"))
    none = F.lit(-1.0)
    wins = (F.col("threshold") < GREEN_FLOOR) & F.coalesce("_ok", F.lit(False)) & (~F.col("ok") | (F.coalesce("_green", none) > F.coalesce("green_contrast", none)))
    wins = F.coalesce(wins, F.lit(False))
    both = first.join(d1, by, "left")
    return both.select(by, F.when(wins, "green floor").otherwise("threshold").alias("branch"), F.when(wins, F.col("_green")).otherwise(F.col("green_contrast")).alias("green_contrast"))


def across_axis(w: Column, h: Column, strength_x: Column, strength_y: Column) -> Column:
    """Axis across the rows: the short one, and where the crop is near square the one with the stronger period."""
    ratio = w / F.when(h == 0, F.lit(1.0)).otherwise(h.cast("double"))
    return F.when(ratio <= 0.8, "x").when(ratio >= 1.25, "y").when(strength_x >= strength_y, "x").otherwise("y")
