"""Exact medians of whole tables in bounded rounds of counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a round of counting, and values that the driver may take at last.
BINS, FEW = 4096, 10_000


def _ranked(df: DataFrame, rank: int) -> float:
    """The value of df.v with so many smaller ones before it: bins are counted and the one that holds it is counted again."""
    while True:
        lo, hi, n = df.agg(F.min("v"), F.max("v"), F.count("*")).first()
        if lo == hi:
            return lo
        if n <= FEW:
            return sorted(r[0] for r in df.collect())[rank]
        share = (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves, so that no span overflows
        df = df.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int"))
        for b, count in sorted(tuple(r) for r in df.groupBy("bin").count().collect()):
            if rank < count:
                break
            rank -= count
        df = df.where(F.col("bin") == b).drop("bin")


def median(df: DataFrame, value) -> float | None:
    """The exact median of a column or expression over all rows, the mean of the two middle ones for an even number; None where all are null.

    No task holds more than a round's counts, which Spark adds up before they
    are shuffled, and the driver no more than FEW values.
    """
    df = df.select(value.cast("double").alias("v") if not isinstance(value, str) else F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n = df.count()
    if not n:
        return None
    low = _ranked(df, (n - 1) // 2)
    return low if n % 2 else (low + _ranked(df, n // 2)) / 2
