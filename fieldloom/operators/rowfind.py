"""Crop rows of plots from the samples of their windows: segments, spectra, tilt, the comb and the choice between two greens.

samples has plot, n_i (samples along), n_j (across), i, j and the bands r, g, b
of 0 to 255.  Profiles are aggregates by plot, segment and step across; from
there on a plot is one row with arrays of bounded length.  Positions are in
steps across.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.geometry import let
from fieldloom.operators import comb, signal
from fieldloom.tables import stored

#: Spacings of rows in mm, widths of the narrow and the wide mean in mm, steepest rows in degrees.
PITCH_RANGE_MM, NARROW_MM, WIDE_MM, MAX_TILT = (170.0, 320.0), 40.0, 500.0, 8.0
VALID_ABOVE, LEAST_VALID, LEAST_SEGMENT, LEAST_BINS, LEAST_OF_BIN = 4, 500, 200, 20, 3
SPECTRUM = 1 << 16
ARRAY = T.ArrayType(T.DoubleType())
PITCH = T.StructType([T.StructField("pitch", T.DoubleType()), T.StructField("share", T.DoubleType())])


def with_green(samples: DataFrame) -> DataFrame:
    """The valid samples (a band above 4), with green: excess green over the sum of the bands."""
    total = (F.col("r") + F.col("g") + F.col("b")).cast("double")
    return samples.where(F.greatest("r", "g", "b") > VALID_ABOVE).withColumn("green", (2 * F.col("g") - F.col("r") - F.col("b")) / total)


def segments_of(n_along: Column) -> Column:
    """Segments that a plot is cut into along: one for about 250 samples, 6 to 24."""
    return F.greatest(F.lit(6.0), F.least(F.lit(24.0), n_along / 250)).cast("int")


def _bins(found: DataFrame, by: list[str], at: Column) -> DataFrame:
    """share, mean and clear (arrays over the steps across, null where 3 samples or fewer lie) of each group, with its samples and their mean place along.

    found has veg, value and clear for each sample.
    """
    n = F.count("*")
    each = found.groupBy(*by, "n_j", at.cast("int").alias("bin")).agg(n.alias("n"), *[F.when(n > LEAST_OF_BIN, F.avg(F.col(c).cast("double"))).alias(c) for c in ("veg", "value", "clear")], F.sum(F.col("i").cast("double")).alias("along"))
    inside = F.col("bin").between(0, F.col("n_j") - 1)
    listed = F.sort_array(F.collect_list(F.when(inside, F.struct("bin", "veg", "value", "clear"))))
    arrays = each.groupBy(*by, "n_j").agg(listed.alias("bins"), F.sum("n").alias("n"), (F.sum("along") / F.sum("n")).alias("along"))
    dense = let(F.map_from_entries(F.transform("bins", lambda b: F.struct(b.bin, b))), lambda m: F.transform(F.sequence(F.lit(0), F.col("n_j") - 1), lambda k: F.try_element_at(m, k)))
    full = F.when(F.size("bins") == F.col("n_j"), F.col("bins")).otherwise(dense)
    return arrays.select(*by, "n_j", "n", "along", full.alias("bins")).select(*by, "n_j", "n", "along", F.col("bins.veg").alias("share"), F.col("bins.value").alias("mean"), F.col("bins.clear").alias("clear"))


def _smooth(p: np.ndarray, k: float) -> np.ndarray:
    """Means of k values, unknown ones as the mean of all, the end values repeated beyond the ends."""
    known = np.isfinite(p)
    p = np.where(known, p, p[known].mean() if known.any() else 0.0)
    k = max(int(round(k)), 1)
    if k < 2 or len(p) < 3:
        return p
    sums = np.concatenate([[0.0], np.cumsum(np.pad(p, (k // 2, k - 1 - k // 2), mode="edge"))])
    return (sums[k:] - sums[:-k]) / k


def _ridge(p: np.ndarray, mm: float) -> np.ndarray:
    narrow = _smooth(np.asarray(p, float), NARROW_MM / mm)
    out = narrow - _smooth(narrow, WIDE_MM / mm)
    sd = out.std()
    return out / sd if sd > 1e-12 else out


@F.pandas_udf(ARRAY)
def ridge_of(share: pd.Series, mean: pd.Series, mm: pd.Series) -> pd.Series:
    """The sum of the ridge signals of two profiles: narrow means less wide ones, to unit variance; mm is a step's width."""
    return pd.Series([_ridge(a, m) + _ridge(b, m) for a, b, m in zip(share, mean, mm, strict=True)])


@F.pandas_udf(ARRAY)
def smoothed(profile: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([_smooth(np.asarray(p, float), x) for p, x in zip(profile, k, strict=True)])


def strongest_pitch(low: Column, high: Column, signals: Column, n: int = SPECTRUM) -> Column:
    """Struct pitch, share: the period between low and high with the largest power in the sum of the signals' spectra, and its part of the power between them.

    signals is an array of arrays of one length; each is windowed (Hann) and
    padded to n.  Both are null where nothing is there.
    """

    @F.pandas_udf(PITCH)
    def pick(low: pd.Series, high: pd.Series, signals: pd.Series) -> pd.DataFrame:
        found = []
        frequency = np.fft.rfftfreq(n)
        for lo, hi, rows in zip(low, high, signals, strict=True):
            rows = np.array([np.asarray(r, float) for r in rows]) if rows is not None and len(rows) else np.zeros((0, 1))
            band = np.flatnonzero((frequency >= 1 / hi) & (frequency <= 1 / lo))
            power = sum((np.abs(np.fft.rfft(r * np.hanning(len(r)), n))[band] ** 2 for r in rows), np.zeros(len(band)))
            k = int(power.argmax()) if len(band) and power.sum() > 0 else -1
            found.append((1 / frequency[band[k]], power[k] / power.sum()) if k >= 0 else (None, None))
        return pd.DataFrame(found, columns=["pitch", "share"])

    return pick(low, high, signals)


@F.pandas_udf(T.DoubleType())
def finer_pitch(pitch: pd.Series, signal: pd.Series) -> pd.Series:
    """Of 241 pitches within 6 % of the given one, that whose wave the signal holds most of; the first on ties."""
    out = []
    for p, s in zip(pitch, signal, strict=True):
        tried = p * np.linspace(0.94, 1.06, 241)
        s = np.asarray(s, float)
        out.append(tried[int(np.abs(np.exp(-2j * np.pi * (np.arange(len(s)) + 0.5) / tried[:, None]) @ s).argmax())])
    return pd.Series(out)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _median(x: Column) -> Column:
    s = lambda a, i: F.get(a, i.cast("int"))
    return let(F.sort_array(x), lambda a: (s(a, F.floor((F.size(a) - 1) / 2)) + s(a, F.floor(F.size(a) / 2))) / 2)


def phases(signals: Column, pitch: Column) -> Column:
    """Structs pos (place of the rows modulo pitch) and amp (strength) of each of an array of signals."""

    def one(s: Column) -> Column:
        wave = lambda f: _total(F.transform(s, lambda v, x: v * f(2 * math.pi * (x + 0.5) / pitch)))
        return let(F.struct(wave(F.cos).alias("c"), (-wave(F.sin)).alias("s")), lambda z: F.struct(F.pmod(-F.atan2(z.s, z.c) / (2 * math.pi) * pitch, pitch).alias("pos"), (F.hypot(z.c, z.s) / F.size(s)).alias("amp")))

    return F.transform(signals, one)


def unwrapped(places: Column, period: Column) -> Column:
    """places without jumps: each step is the shortest way round from the place before."""
    step = lambda a, p: F.element_at(a, -1) + F.pmod(p - F.element_at(a, -1) + period / 2, period) - period / 2
    return F.aggregate(places, F.array().cast("array<double>"), lambda a, p: F.concat(a, F.array(F.when(F.size(a) == 0, p).otherwise(step(a, p)))))


def tilt_of(along: Column, places: Column, weights: Column, pitch: Column, most: float = MAX_TILT) -> Column:
    """Degrees by which rows turn from the axis: the slope of a line through (along, places); 0 beyond most.

    Four rounds of weighted least squares; after each, points off the line by
    an eighth of the pitch, or by two and a half times the median of those
    that count if that is more, count no longer.  With under 3 that count the
    line stays.
    """
    points = F.arrays_zip(along.alias("l"), places.alias("p"), weights.alias("w"))

    def line(w: Column) -> Column:
        """Weighted least squares: a + b l."""
        z = F.zip_with(points, w, lambda p, v: F.struct(p.l.alias("l"), p.p.alias("p"), F.greatest(v, F.lit(0.0)).alias("v")))

        def fit(z: Column) -> Column:
            m = lambda f: _total(F.transform(z, f))
            return let(F.struct(m(lambda q: q.v).alias("n"), m(lambda q: q.v * q.l).alias("l"), m(lambda q: q.v * q.p).alias("p")), lambda s: let(
                F.struct(m(lambda q: q.v * (q.l - s.l / s.n) * (q.l - s.l / s.n)).alias("ll"), m(lambda q: q.v * (q.l - s.l / s.n) * (q.p - s.p / s.n)).alias("lp")),
                lambda t: let(F.coalesce(F.try_divide(t.lp, t.ll), F.lit(0.0)), lambda b: F.struct((s.p / s.n - b * s.l / s.n).alias("a"), b.alias("b"))),
            ))

        return let(z, fit)

    def off(fit: Column) -> Column:
        return F.transform(points, lambda p: F.abs(p.p - fit.a - fit.b * p.l))

    def step(s: Column, _: Column) -> Column:
        def next_(fit: Column) -> Column:
            return let(off(fit), lambda r: let(
                F.greatest(pitch / 8, 2.5 * _median(F.transform(F.filter(F.arrays_zip(r.alias("r"), s.w.alias("w")), lambda q: q.w > 0), lambda q: q.r))),
                lambda tol: F.struct(F.transform(F.arrays_zip(r.alias("r"), weights.alias("w")), lambda q: F.when(q.r < tol, q.w).otherwise(0.0)).alias("w"), fit.b.alias("b")),
            ))

        return F.when(F.size(F.filter(s.w, lambda w: w > 0)) < 3, s).otherwise(let(line(s.w), next_))

    start = F.struct(F.transform(weights, lambda w: w.cast("double")).alias("w"), F.lit(0.0).alias("b"))
    angle = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, step, lambda s: F.degrees(F.atan(s.b)))
    return let(angle, lambda a: F.when(F.abs(a) > most, 0.0).otherwise(a))


def plot_rows(teeth: Column, lo: Column, hi: Column, pitch: Column, expected: Column) -> Column:
    """Numbers (from 0) of the teeth (structs pos, contrast, present, by place) that are the plot's own rows.

    With expected rows, and so many teeth inside lo to hi, the adjoining ones
    with the largest sum of contrast, the first of equals; else all from the
    first to the last present one that is 0.3 pitches inside.
    """
    inside = lambda t: (t.pos >= lo) & (t.pos <= hi)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(teeth) - expected)), lambda k: F.struct(k.alias("k"), F.slice(teeth, k + 1, expected).alias("t")))
    whole = F.filter(runs, lambda x: (F.size(x.t) == expected) & F.forall(x.t, inside))
    best = F.array_max(F.transform(whole, lambda x: F.struct(F.round(_total(F.transform(x.t, lambda t: F.coalesce(t.contrast, F.lit(0.0)))), 9).alias("s"), (-x.k).alias("k"))))
    asked = F.when(best.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(-best.k, -best.k + expected - 1))
    own = F.filter(F.transform(teeth, lambda t, i: F.when(t.present & (t.pos > lo + 0.3 * pitch) & (t.pos < hi - 0.3 * pitch), i)), lambda i: i.isNotNull())
    run = F.when(F.size(own) > 0, F.sequence(F.array_min(own), F.array_max(own))).otherwise(F.array().cast("array<int>"))
    return F.when((expected > 0) & (F.size(F.filter(teeth, inside)) >= expected), asked).otherwise(run)


def _branches(green: DataFrame) -> DataFrame:
    """Each valid sample with its branch: threshold (veg above the plot's Otsu threshold), and green floor where that lies below 0.05."""
    with_threshold = green.join(stored(signal.otsu(green, "plot", "green"), "thresholds"), "plot")
    floor = F.lit(comb.GREEN_FLOOR)
    one = F.struct(F.lit("threshold").alias("branch"), (F.col("green") > F.col("threshold")).alias("veg"), F.col("green").alias("value"))
    two = F.struct(F.lit("green floor").alias("branch"), (F.col("green") > floor).alias("veg"), F.greatest(F.col("green") - floor, F.lit(0.0)).alias("value"))
    both = F.when(F.col("threshold") < floor, F.array(one, two)).otherwise(F.array(one))
    return with_threshold.select("plot", "n_i", "n_j", "i", "j", "threshold", (F.col("green") > floor).alias("clear"), F.explode(both).alias("x")).select("plot", "n_i", "n_j", "i", "j", "threshold", "clear", "x.*")


def detect(samples: DataFrame, step_mm: float, pitch_mm: float | None = None, rows_expected: int = 0) -> DataFrame:
    """One row for each plot of samples: plot, ok, reason, branch, threshold, pitch, pitch_share, angle_deg, green_contrast, lo, hi and rows.

    rows is an array of k (from 1), pos, contrast, present and own of every
    tooth of the comb; own ones are the plot's rows.  pitch and places are in
    steps of step_mm across.  The pitch is sought in the sum of the segments'
    spectra unless pitch_mm gives it (samples are read five times, so pass them stored); the tilt is the drift of the rows' phase
    along the plot.  The branch with more green on its rows wins, see
    comb.greener.  A plot without rows has ok false and the reason.
    """
    valid = with_green(samples)
    counts = samples.groupBy("plot").agg(F.count(F.when(F.greatest("r", "g", "b") > VALID_ABOVE, 1)).alias("n_valid"))
    enough = counts.where(F.col("n_valid") >= LEAST_VALID).select("plot")
    found = _branches(valid.join(enough, "plot", "left_semi"))
    k = segments_of(F.col("n_i"))
    placed = found.withColumn("seg", F.least(F.floor(F.col("i") / F.col("n_i") * k).cast("int"), k - 1))
    segments = _bins(placed, ["plot", "branch", "n_i", "threshold", "seg"], F.col("j"))
    known = lambda c: F.size(F.filter(c, lambda v: v.isNotNull()))
    segments = segments.where((F.col("n") >= LEAST_SEGMENT) & (known("share") >= LEAST_BINS))
    step = F.lit(float(step_mm))
    there = F.transform("share", lambda v: v.isNotNull().cast("double"))
    signals = segments.withColumn("sig", F.zip_with(ridge_of("share", "mean", step), there, lambda a, b: a * b))
    by_plot = signals.groupBy("plot", "branch", "n_i", "n_j", "threshold").agg(F.sort_array(F.collect_list(F.struct("seg", "along", "sig"))).alias("s"))
    lo_hi = (pitch_mm, pitch_mm) if pitch_mm else PITCH_RANGE_MM
    least, most = (F.lit(x / step_mm) for x in lo_hi)
    by_plot = by_plot.withColumn("several", F.size("s") >= 3)
    pick = F.struct(F.lit(lo_hi[0] / step_mm).alias("pitch"), F.lit(1.0).alias("share")) if pitch_mm else strongest_pitch(least, most, F.col("s.sig"))
    by_plot = by_plot.withColumn("p", pick).withColumn("several", F.col("several") & F.col("p.pitch").isNotNull())
    z = phases(F.col("s.sig"), F.col("p.pitch"))
    by_plot = by_plot.withColumn("z", F.when(F.col("several"), z))
    middle = F.col("n_i") / 2.0
    along = F.transform("s", lambda x: x.along - middle)
    by_plot = by_plot.withColumn("angle_deg", F.when(F.col("several"), tilt_of(along, unwrapped(F.col("z.pos"), F.col("p.pitch")), F.col("z.amp"), F.col("p.pitch"))))
    plots = stored(by_plot.select("plot", "branch", "n_j", "n_i", "threshold", "several", "p", "angle_deg", F.size("s").alias("segments")), "tilts")

    turned = found.join(plots.where("several").select("plot", "branch", "angle_deg"), ["plot", "branch"])
    profile = _bins(turned.drop("threshold"), ["plot", "branch"], F.floor(F.col("j") - F.tan(F.radians("angle_deg")) * (F.col("i") - F.col("n_i") / 2.0))).drop("n_j", "n", "along")
    sig = profile.withColumn("ridge", ridge_of("share", "mean", step))
    sig = sig.join(plots.where("several"), ["plot", "branch"]).withColumn("known", F.filter(F.transform("share", lambda v, x: F.when(v.isNotNull(), x + 0.5)), lambda x: x.isNotNull()))
    masked = F.zip_with("ridge", "share", lambda a, v: F.when(v.isNotNull(), a).otherwise(0.0))
    sig = sig.withColumn("pitch", F.col("p.pitch") if pitch_mm else finer_pitch(F.col("p.pitch"), masked))
    sig = stored(sig.withColumns({"lo": F.array_min("known"), "hi": F.array_max("known"), "key": F.concat_ws(":", F.col("plot").cast("string"), "branch")}), "ridges")
    combs = comb.comb_rows(sig.select("key", F.col("ridge").alias("sig"), F.lit(0.5).alias("first"), F.lit(1.0).alias("step"), "lo", "hi", "pitch"), "key", 0.25 * F.col("pitch"))
    teeth = combs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "pos", "contrast", "present"))).alias("teeth"))
    sig = sig.withColumn("clear", F.when(F.exists("clear", lambda v: v.isNotNull()), smoothed("clear", F.greatest(F.lit(1.0), 0.12 * F.col("pitch"))))).join(teeth, "key", "left")
    inside = lambda t: (t.pos >= F.col("lo")) & (t.pos <= F.col("hi"))
    sig = sig.withColumn("teeth", F.transform("teeth", lambda t: t.withField("present", t.present & inside(t))))
    sig = sig.withColumn("own", F.coalesce(plot_rows(F.col("teeth"), F.col("lo"), F.col("hi"), F.col("pitch"), F.lit(int(rows_expected))), F.array().cast("array<int>")))
    at = lambda pos: F.coalesce(F.get("clear", F.bround(pos - 0.5).cast("int")), F.lit(0.0))
    on_green = F.transform("own", lambda i: let(F.get("teeth", i)["pos"], lambda x: at(x) - 0.5 * (at(x - F.col("pitch") / 2) + at(x + F.col("pitch") / 2))))
    sig = sig.withColumn("green_contrast", F.when(F.size("own") > 0, _total(on_green) / F.size("own")))
    marked = F.transform("teeth", lambda t: t.withField("own", F.array_contains("own", t.k - 1)))
    reason = F.when(F.col("teeth").isNull(), "comb fit failed").when(F.size("own") == 0, "no row with positive contrast").otherwise("")
    done = sig.select("plot", "branch", "threshold", "pitch", F.col("p.share").alias("pitch_share"), "angle_deg", "green_contrast", "lo", "hi", marked.alias("rows"), reason.alias("reason"))
    few = plots.where("not several").select("plot", "branch", "threshold", F.when(F.col("segments") < 3, "too little image data along the plot").otherwise("no row periodicity found").alias("reason"))
    every = stored(done.unionByName(few, allowMissingColumns=True).withColumn("ok", F.col("reason") == ""), "branches")
    first = every.where("branch = 'threshold'")
    winner = comb.greener(first.select("plot", "ok", "green_contrast", "threshold"), every.where("branch = 'green floor'").select("plot", "ok", "green_contrast"), "plot").select("plot", "branch")
    chosen = every.join(winner, ["plot", "branch"])
    out = samples.select("plot").distinct().join(chosen, "plot", "left").join(counts, "plot")
    # A plot with enough samples has a branch, unless none of its segments has enough.
    none = F.when(F.col("n_valid") < LEAST_VALID, "almost no image data").otherwise("too little image data along the plot")
    return out.select("plot", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("reason", none).alias("reason"), "branch", "threshold", "pitch", "pitch_share", "angle_deg", "green_contrast", "lo", "hi", "rows")


def row_lines(found: DataFrame, plots: DataFrame, windows: DataFrame, step: float) -> DataFrame:
    """plot, row_idx, v_off_m, length_m, angle_deg, contrast and the line's ends (array of x, y) of the own rows of detect's plots.

    plots has the frames (plot, cx, cy, ux, uy, vx, vy, hl, hw), windows the
    place of the first sample across (plot, across0); step is in the plots' units.
    """
    own = found.where("ok").select("plot", "angle_deg", F.explode(F.filter("rows", lambda r: r.own)).alias("r"))
    first = own.groupBy("plot").agg(F.min("r.k").alias("k0"))
    placed = own.join(first, "plot").join(plots, "plot").join(windows.select("plot", "across0"), "plot")
    v, t = F.col("across0") + F.col("r.pos") * step, F.tan(F.radians("angle_deg"))
    end = lambda side: F.struct(*[(F.col(f"c{a}") + F.col(f"v{a}") * (v + side * t * F.col("hl")) + side * F.col(f"u{a}") * F.col("hl")).alias(a) for a in "xy"])
    return placed.select("plot", (F.col("r.k") - F.col("k0") + 1).alias("row_idx"), F.round(v, 4).alias("v_off_m"), F.round(2 * F.col("hl"), 3).alias("length_m"), F.round("angle_deg", 3).alias("angle_deg"), F.round("r.contrast", 4).alias("contrast"), F.array(end(-1), end(1)).alias("line"))


def report(found: DataFrame, windows: DataFrame, step: float) -> DataFrame:
    """plot, ok, n_rows, pitch_m, angle_deg, reason of every window's plot; weak row(s) where an own row isn't present."""
    own = F.filter("rows", lambda r: r.own)
    seen = windows.select("plot", "outside").join(found, "plot", "left")
    ok = F.coalesce("ok", F.lit(False))
    weak = F.when(ok & F.exists(own, lambda r: ~r.present), "weak row(s)").otherwise(F.col("reason"))
    reason = F.when(F.col("outside"), "plot outside the raster").otherwise(F.coalesce(weak, F.lit("almost no image data")))
    return seen.select("plot", ok.alias("ok"), F.when(ok, F.size(own)).otherwise(0).alias("n_rows"), F.when(ok, F.round(F.col("pitch") * step, 4)).alias("pitch_m"), F.when(ok, F.round("angle_deg", 2)).alias("angle_deg"), reason.alias("reason"))
