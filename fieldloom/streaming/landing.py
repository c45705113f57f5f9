"""Extension: the batch checks on streams of files and events.

The batch package has no unbounded inputs of its own; these run the same
classifications on a landing folder and on event tables as they grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """events with ts as an instant, as watermarks ask for."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n and value of each window; on a stream, rows later than late are left out and windows close."""
    t = timed(events)
    t = t.withWatermark("ts", late) if t.isStreaming else t
    g = t.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """start, end, user_id and n of each user's sessions: events less than gap apart."""
    t = timed(events)
    t = t.withWatermark("ts", late) if t.isStreaming else t
    g = t.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def first_seen(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Rows with a key that wasn't there within late before."""
    t = timed(events)
    return t.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if t.isStreaming else t.dropDuplicates([key])


def classified(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """jobs (stem) with the file that has landed for them; files is a static listing (stem, path)."""
    known = files.groupBy("stem").agg(F.min("path").alias("path"))
    return jobs.join(known, "stem", "left").withColumn("result", F.when(F.col("path").isNull(), "MISSING").otherwise("LANDED"))
