"""One-dimensional signals: smoothing, peaks, thresholds, periods."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moving_sum_share(df: DataFrame, by: str, at: str, v: str, k: int) -> DataFrame:
    """smooth: sum of the k values around, over k; beyond the ends counts as zero."""
    before, after = k // 2, (k - 1) // 2
    return df.withColumn("smooth", F.sum(v).over(Window.partitionBy(by).orderBy(at).rowsBetween(-before, after)) / k)


def local_maxima(df: DataFrame, by: str, at: str, v: str) -> DataFrame:
    """Rows at least as high as the one before and higher than the one after."""
    w = Window.partitionBy(by).orderBy(at)
    return df.withColumns({"_a": F.lag(v).over(w), "_b": F.lead(v).over(w)}).where((F.col(v) >= F.col("_a")) & (F.col(v) > F.col("_b"))).drop("_a", "_b")


def otsu(df: DataFrame, by: str, v: str, bins: int = 256, least: int = 10) -> DataFrame:
    """Threshold for each group: the middle of the bin with the largest spread between classes, the first on ties.

    Bins span the percentiles 0.5 to 99.5; values beyond them are left out.
    Below least values the threshold is their median.
    """
    span = df.groupBy(by).agg(F.percentile(v, F.array(F.lit(0.005), F.lit(0.995))).alias("_p"), F.median(v).alias("_mid"), F.count(v).alias("_n"))
    span = span.select(by, F.col("_p")[0].alias("lo"), F.col("_p")[1].alias("hi"), "_mid", "_n")
    few = F.when(F.col("_n") < least, F.col("_mid")).when(F.col("hi") <= F.col("lo"), F.col("lo"))
    width = (F.col("hi") - F.col("lo")) / bins
    inside = df.join(span, by).where((F.col(v) >= F.col("lo")) & (F.col(v) <= F.col("hi")) & (F.col("hi") > F.col("lo")))
    hist = inside.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col("lo")) / width)).cast("int")).groupBy(by, "bin", "lo", "hi").agg(F.count("*").alias("n"))
    hist = hist.withColumn("mid", F.col("lo") + (F.col("bin") + 0.5) * width)
    w = Window.partitionBy(by)
    upto = w.orderBy("bin")
    hist = hist.withColumns({"w0": F.sum("n").over(upto), "w": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("mid")).over(upto), "s": F.sum(F.col("n") * F.col("mid")).over(w)})
    w1 = F.nullif(F.col("w") - F.col("w0"), F.lit(0))
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    hist = hist.withColumn("between", F.round(F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(0.0)), 6))
    best = hist.groupBy(by).agg(F.max_by("mid", F.struct("between", -F.col("bin"))).alias("_best"))
    return span.join(best, by, "left").select(by, F.round(F.coalesce(few, "_best"), 6).alias("threshold"))


def strongest_period(df: DataFrame, by: str, at: str, v: str, periods: list[float]) -> DataFrame:
    """The period, of those given, whose wave the signal without its mean holds most of; the first on ties."""
    mean = df.groupBy(by).agg(F.avg(v).alias("_m"))
    waves = df.join(mean, by).select(by, at, (F.col(v) - F.col("_m")).alias("s"), F.explode(F.array(*[F.lit(float(p)) for p in periods])).alias("period"))
    turn = 2 * math.pi * F.col(at) / F.col("period")
    power = waves.groupBy(by, "period").agg(F.sum(F.col("s") * F.cos(turn)).alias("c"), F.sum(F.col("s") * F.sin(turn)).alias("d"))
    power = power.withColumn("power", F.round(F.col("c") * F.col("c") + F.col("d") * F.col("d"), 6))
    return power.groupBy(by).agg(F.max_by("period", F.struct("power", -F.col("period"))).alias("period"), F.max("power").alias("power"))


def comb_fit(df: DataFrame, by: str, at: str, v: str, pitch: int) -> DataFrame:
    """Phase at which teeth every pitch places are highest above the gaps between them; the first on ties."""
    offset = F.explode(F.sequence(F.lit(0), F.lit(pitch - 1))).alias("phase")
    at_tooth = F.pmod(F.col(at) - F.col("phase"), F.lit(pitch)) == 0
    at_gap = F.pmod(F.col(at) - F.col("phase"), F.lit(pitch)) == pitch // 2
    scores = df.select(by, at, v, offset).groupBy(by, "phase").agg(F.round(F.avg(F.when(at_tooth, F.col(v))) - F.avg(F.when(at_gap, F.col(v))), 9).alias("contrast"))
    return scores.groupBy(by).agg(F.max_by("phase", F.struct("contrast", -F.col("phase"))).alias("phase"), F.max("contrast").alias("contrast"))


def peaks_of(df: DataFrame, by: str, at: str, v: str, distance: int, prominence: float) -> DataFrame:
    """(by, at, v) of the peaks of each group's signal; a group is one signal of bounded length.

    A peak is at least as high as the value before it, higher than the one
    after, and stands prominence above the larger of the least values within
    distance on its left and on its right.  Taken by height, the first of
    equals first, and only where no taken one is nearer than distance.
    """
    n, x = F.size("_x"), lambda i: F.get("_x", i)["v"]
    least = lambda a, b: F.array_min(F.transform(F.slice("_x", a + 1, b - a), lambda s: s.v))
    stands = lambda i: x(i) - F.greatest(least(F.greatest(F.lit(0), i - distance), i), least(i + 1, F.least(n, i + distance + 1))) >= prominence
    inner = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    found = F.filter(inner, lambda i: (x(i) >= x(i - 1)) & (x(i) > x(i + 1)) & stands(i))
    ranked = F.array_sort(F.transform(found, lambda i: F.struct((-x(i)).alias("h"), i.alias("i"))))
    taken = F.aggregate(ranked, F.array().cast("array<int>"), lambda got, c: F.when(F.exists(got, lambda j: F.abs(j - c.i) < distance), got).otherwise(F.concat(got, F.array(c.i))))
    each = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(v).alias("v")))).alias("_x"))
    return each.select(by, F.explode(F.transform(taken, lambda i: F.get("_x", i))).alias("_p")).select(by, F.col("_p.at").alias(at), F.col("_p.v").alias(v))
