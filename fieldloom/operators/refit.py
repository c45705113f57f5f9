"""The refit of a plot grid onto its rows in two passes: each plot's rows, then the run's pitch, mode and offset, then each plot's shift."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.geometry import let
from fieldloom.operators import exact

# Gaps that count (in pitches), least prominence, distance and smoothing of peaks (in pitches).
GAP_LOW, GAP_HIGH, PROMINENCE, PEAK_APART, SMOOTH_PART = 0.55, 1.8, 0.09, 0.55, 0.30
# Gaps a run needs, least gap to the neighbour and most error of gaps (in pitches), clean plots of an offset.
LEAST_GAPS, FEASIBLE, IRREGULAR, LEAST_CLEAN = 10, 1.12, 0.18, 20


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _middle(x: Column) -> Column:
    s = lambda a, i: F.get(a, i.cast("int"))
    return let(F.sort_array(x), lambda a: F.when(F.size(a) > 0, (s(a, F.floor((F.size(a) - 1) / 2)) + s(a, F.floor(F.size(a) / 2))) / 2))


def boxed(x: Column, k: Column) -> Column:
    """Sums of the k (odd) values around each, over k; beyond the ends counts as zero."""
    half = F.floor(k / 2).cast("int")
    cut = lambda x, i, half: F.slice(x, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half + 1, F.size(x)) - F.greatest(i - half, F.lit(0)))
    return let(F.struct(x.alias("x"), k.alias("k"), half.alias("half")), lambda q: F.transform(q.x, lambda _, i: _total(cut(q.x, i, q.half)) / q.k))


def peak_places(x: Column, apart: Column, prominence: float) -> Column:
    """Places of the peaks of an array, in order: local maxima that stand prominence above the higher of the lowest values within apart on both sides, the highest first, none nearer to a taken one than apart."""
    return let(F.struct(x.alias("x"), apart.alias("apart"), F.floor(apart).cast("int").alias("reach")), lambda q: _peak_places(q.x, q.apart, q.reach, prominence))


def _peak_places(x: Column, apart: Column, reach: Column, prominence: float) -> Column:
    n = F.size(x)
    least = lambda a, b: F.array_min(F.slice(x, a + 1, b - a))
    at = lambda i: F.get(x, i)
    stands = lambda i: at(i) - F.greatest(least(F.greatest(F.lit(0), i - reach), i), least(i + 1, F.least(n, i + reach + 1))) >= prominence
    inner = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    found = F.filter(inner, lambda i: (at(i) >= at(i - 1)) & (at(i) > at(i + 1)) & stands(i))
    order = F.array_sort(F.transform(found, lambda i: F.struct((-at(i)).alias("h"), i.alias("i"))))
    taken = F.aggregate(order, F.array().cast("array<int>"), lambda got, c: F.when(F.exists(got, lambda j: F.abs(j - c.i) < apart), got).otherwise(F.concat(got, F.array(c.i))))
    return F.sort_array(taken)


def measured(profiles: DataFrame, pitch_hint: float, extend: float) -> DataFrame:
    """profiles (plot, width_mm, profile across, null without data) with flag, n_all, pos (mm from the low edge), gap_med_mm and n_in (rows inside the plot).

    The profile runs from extend of the width before the low edge to as far
    beyond the other.  flag is nodata without a profile and rows_not_found
    under three peaks; such plots have no pos.
    """
    n = F.size("profile")
    p = profiles.withColumn("_mm", F.col("width_mm") * (1 + 2 * extend) / n)
    span = F.floor(pitch_hint / F.col("_mm") * SMOOTH_PART).cast("int")
    k = F.greatest(F.lit(3), span + F.when(span % 2 == 0, 1).otherwise(0))
    p = p.withColumn("_s", boxed(F.col("profile"), k))
    ends = F.struct(F.array_min("_s").alias("lo"), F.array_max("_s").alias("hi"))
    p = p.withColumn("_s", let(ends, lambda e: F.transform("_s", lambda v: (v - e.lo) / (e.hi - e.lo + 1e-9))))
    p = p.withColumn("_p", peak_places(F.col("_s"), F.greatest(F.lit(3.0), pitch_hint / F.col("_mm") * PEAK_APART), PROMINENCE))
    place = lambda i: (-extend + i * ((1 + 2 * extend) / (n - 1))) * F.col("width_mm")
    found = F.size("_p") >= 3
    p = p.withColumns({"flag": F.when(F.col("profile").isNull(), "nodata").when(~found, "rows_not_found").otherwise(""), "n_all": F.when(F.col("profile").isNotNull(), F.size("_p")), "pos": F.when(found, F.transform("_p", place))})
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.size("pos") - 1), lambda i: F.get("pos", i) - F.get("pos", i - 1)), lambda g: (g > pitch_hint * GAP_LOW) & (g < pitch_hint * GAP_HIGH))
    inside = F.size(F.filter("pos", lambda x: (x >= 0) & (x <= F.col("width_mm"))))
    return p.withColumns({"gap_med_mm": F.when(found, F.round(_middle(gaps), 1)), "n_in": F.when(found, inside)}).drop("_mm", "_s", "_p")


class Run(NamedTuple):
    """What the first pass says of a run; code is 0 (refit), 2 (no pitch) or 3 (rows run on across plots)."""

    pitch_mm: float | None
    rows: int | None
    gap_ratio: float | None
    code: int
    global_mm: float
    clean: int


def run_of(plots: DataFrame, rows: int = 0) -> Run:
    """The run of measured plots: its median pitch, rows for each plot (the most frequent n_in above 0, the smallest on ties, unless given), and whether a plot's border can be seen.

    Each is one number; medians are exact and counted in bounded rounds.
    """
    n_gaps = plots.where("gap_med_mm is not null").count()
    if n_gaps < LEAST_GAPS:
        return Run(None, rows or None, None, 2, 0.0, 0)
    pitch, width = exact.median(plots, "gap_med_mm"), exact.median(plots, "width_mm")
    if not rows:
        most = plots.where("n_in > 0").groupBy("n_in").count().orderBy(F.desc("count"), "n_in").first()
        rows = most.n_in if most else 0
    ratio = (width - (rows - 1) * pitch) / pitch if pitch else 1.0
    clean = _blocks(plots, rows, pitch).where(F.col("b.err") <= IRREGULAR * pitch).select(F.col("b.offset").alias("offset"))
    n_clean = clean.count()
    return Run(pitch, rows, ratio, 0 if ratio >= FEASIBLE else 3, exact.median(clean, "offset") if n_clean >= LEAST_CLEAN else 0.0, n_clean)


def _blocks(plots: DataFrame, rows: int, pitch: float) -> DataFrame:
    """plots with b: offset from the middle, span and mean error of the gaps of the adjoining rows with the most regular gaps nearest the middle (three times that error and the distance, the first on ties)."""
    centre = F.round("width_mm", 1) / 2

    def score(k: Column) -> Column:
        block = F.slice("pos", k + 1, rows)
        first, last = F.get("pos", k), F.get("pos", k + rows - 1)
        gaps = F.transform(F.sequence(F.lit(1), F.lit(max(1, rows - 1))), lambda i: F.abs(F.get(block, i) - F.get(block, i - 1) - pitch))
        err = F.round(_total(gaps) / max(1, rows - 1), 9) if rows > 1 else F.lit(None).cast("double")
        off = (first + last) / 2 - centre
        return F.struct(F.round(3 * F.coalesce(err, F.lit(0.0)) + F.abs(off), 6).alias("score"), k.alias("k"), err.alias("err"), off.alias("offset"), (last - first).alias("span"))

    places = F.sequence(F.lit(0), F.size("pos") - rows)
    return plots.withColumn("b", F.when(F.size("pos") >= max(1, rows), F.array_min(F.transform(places, score))))


def shifted(plots: DataFrame, run: Run, most_shift: float = 0.5, force: bool = False) -> DataFrame:
    """plot, plot_w_mm, n_all, n_in, gap_med_mm, block_span_mm, block_gap_err_mm, offset_mm, global_mm, resid_mm, shift_mm, action and flag of each measured plot.

    A plot takes its own offset where its gaps are regular and what is left
    of the run's offset is within most_shift pitches; else the run's.  A run
    that may not be refitted (code 3) shifts nothing unless forced; one
    without a pitch (code 2) has no rows.
    """
    if run.code == 2:
        plots, run = plots.limit(0), run._replace(pitch_mm=1.0, rows=1)
    go = run.code == 0 or force
    p = _blocks(plots, run.rows, run.pitch_mm).withColumn("resid", F.col("b.offset") - run.global_mm)
    irregular = ~F.coalesce(F.col("b.err") <= IRREGULAR * run.pitch_mm, F.lit(False))
    large = F.abs("resid") > most_shift * run.pitch_mm
    none = F.col("b").isNull()
    action = F.when(~F.lit(go), "measured only (continuity test)").when(none, "global only - rows not measured").when(irregular, "global only - irregular gaps").when(large, F.lit(f"global only - residual > {most_shift * run.pitch_mm:.0f} mm")).otherwise("global + residual")
    flag = F.when(none, F.col("flag")).when(irregular, "irregular").when(large, "large_residual").otherwise(F.col("flag"))
    shift = F.when(~F.lit(go), 0.0).otherwise(F.when(none | irregular | large, run.global_mm).otherwise(F.col("b.offset")))
    one = lambda c, name: (F.round(c, 1) + 0.0).alias(name)  # noqa: E731  (no negative zeros)
    return p.select(
        "plot", one(F.col("width_mm"), "plot_w_mm"), "n_all", "n_in", "gap_med_mm", one(F.col("b.span"), "block_span_mm"), one(F.col("b.err"), "block_gap_err_mm"), one(F.col("b.offset"), "offset_mm"),
        one(F.lit(float(run.global_mm)), "global_mm"), one(F.col("resid"), "resid_mm"), one(shift, "shift_mm"), action.alias("action"), flag.alias("flag"),
    )
