"""Tables at the edges: CSV with fixed columns, file listings, recipes, helper logs, photo headers."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with a header, by its schema; empty where there is no such file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_table(df: DataFrame, path: str, schema: T.StructType) -> None:
    """df's columns of schema, in its order; those that df lacks are empty, and others are left out."""
    df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("errorifexists").option("header", True).csv(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length, modified, name and stem (lower case) of files that aren't empty; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    return files.select("path", "length", F.col("modificationTime").alias("modified"), name.alias("name"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"))


def photo_index(files: DataFrame) -> DataFrame:
    """(key, path): names and stems in lower case; of files with equal keys the first path wins."""
    keys = files.select("path", F.explode(F.array("name", "stem")).alias("key"))
    return keys.groupBy("key").agg(F.min("path").alias("path"))


def recipe_section(recipe: Column, section: str, group: str = "gui") -> Column:
    """A section's settings as a map; an empty one where the text isn't a recipe."""
    return F.coalesce(F.from_json(F.get_json_object(recipe, f"$.{section}.{group}"), "map<string,string>"), F.create_map().cast("map<string,string>"))


def helper_log(lines: DataFrame) -> DataFrame:
    """kind, job, width, height, bits and message of a helper's progress lines (value); other lines are left out."""
    part = lambda k: F.get(F.split("value", r"\s+"), k)
    kind = F.regexp_extract("value", r"^@@(OK|INFO|ERR)\b", 1)
    number = lambda k: F.when(F.col("kind") != "ERR", part(k).try_cast("int"))
    out = lines.select("value", kind.alias("kind")).where("kind <> ''")
    return out.select("kind", part(1).try_cast("int").alias("job"), number(2).alias("width"), number(3).alias("height"), F.when(F.col("kind") == "OK", part(4).try_cast("int")).alias("bits"), F.when(F.col("kind") == "ERR", F.regexp_extract("value", r"^@@ERR\s+\d+\s*(.*)$", 1)).alias("message"))


def image_size(path: str) -> tuple[int, int, int] | None:
    """(width, height, bits) from the header of a PNG, TIFF or JPEG file; None for others.  No pixels are read."""
    from fieldloom.sources.staged import located
    from fieldloom.sources.tiff import Tiff

    system, inner = located(path)
    with system.open_input_file(inner) as f:
        head = f.read(26)
        if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 25:
            return struct.unpack(">IIB", head[16:25])
        if head[:2] == b"\xff\xd8":
            at, size = 2, f.size()
            while at + 9 <= size:
                f.seek(at)
                mark = f.read(9)
                if mark[0] != 0xFF:
                    return None
                if 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
                    bits, h, w = struct.unpack(">BHH", mark[4:9])
                    return w, h, bits
                at += 2 + (0 if mark[1] == 0x01 or 0xD0 <= mark[1] <= 0xD8 else struct.unpack(">H", mark[2:4])[0])
            return None
    if head[:2] not in (b"II", b"MM"):
        return None
    try:
        image = Tiff(path, pixels=False)
    except (ValueError, struct.error, KeyError):
        return None
    return image.width, image.height, image.bits


def image_sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, width, height and bits of images, from their headers; null for other files.  A task opens files and reads no more than their headers."""
    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [image_size(p) or (None, None, None) for p in pdf["path"]]
            yield pd.DataFrame({"path": pdf["path"], "width": pd.array([f[0] for f in found], "Int32"), "height": pd.array([f[1] for f in found], "Int32"), "bits": pd.array([f[2] for f in found], "Int32")})

    return list_files(spark, path, pattern).select("path").mapInPandas(sizes, "path string, width int, height int, bits int")


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """project, ord, chunk_id, label, active: the chunks that the projects under path list, from their zipped XML.

    A project is a folder x.files with a project.zip, and a zip for each
    chunk.  A chunk whose own file is missing, broken or without a label is
    called "chunk" with its number; a project that can't be read has no rows.
    The files are met by their paths, so only their documents are shuffled.
    """
    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out.append((p, z.read("doc.xml").decode("utf-8", "replace")))
                except (zipfile.BadZipFile, KeyError, zlib.error):
                    continue
            yield pd.DataFrame(out, columns=["zip", "doc"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).where(F.col("path").contains(".files/"))
    docs = files.select("path", "content").mapInPandas(documents, "zip string, doc string")
    entry = r'<chunk id="(\d+)" path="([^"]+)"'
    found = lambda k: F.regexp_extract_all("doc", F.lit(entry), F.lit(k))
    top = docs.where(F.col("zip").endswith(".files/project.zip"))
    base = F.regexp_extract("zip", r"^(.*)/project\.zip$", 1)
    chunks = top.select(base.alias("base"), F.nullif(F.regexp_extract("doc", r'active_id="(\d+)"', 1), F.lit("")).alias("on"), F.posexplode(F.arrays_zip(found(1).alias("id"), found(2).alias("at"))).alias("ord", "c"))
    labels = docs.select("zip", F.nullif(F.regexp_extract("doc", r'label="([^"]*)"', 1), F.lit("")).alias("label"))
    chunks = chunks.withColumn("zip", F.concat("base", F.lit("/"), F.col("c.at")))
    return chunks.join(labels, "zip", "left").select(F.regexp_replace("base", r"\.files$", "").alias("project"), "ord", F.col("c.id").cast("int").alias("chunk_id"), F.coalesce("label", F.concat(F.lit("chunk "), F.col("c.id"))).alias("label"), F.coalesce(F.col("c.id") == F.col("on"), F.lit(False)).alias("active"))
