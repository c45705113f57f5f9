"""What the operators share: reading a table and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word rule, as a class for Java's and DuckDB's patterns.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only where none is set and Spark runs in one process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    target, files = _hadoop_path(spark, path)
    files.deleteOnExit(target)
    return path


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path: computed once, and lost executors don't lose it."""
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, what: str) -> DataFrame:
    return stored(df, what)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Frees a stored table that nothing reads any more."""
    target, files = _hadoop_path(spark, path)
    files.delete(target, True)


#: Most bytes of a table that is sent whole to every executor.
BROADCAST_BYTES = 16 << 20


def sent_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, broadcast where its counted rows of at most row_bytes are within BROADCAST_BYTES; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def free_name(df: DataFrame, stem: str) -> str:
    """stem, with underscores after it while df has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def let(value: Column, body) -> Column:
    """body(value) with value computed once for the row, also where body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]
