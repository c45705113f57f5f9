"""Connected components of a graph of any size, by star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import dropped, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return r[0], int(r[1])


#: Links that a task contracts at once.
CHUNK_LINKS = 500_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (u, v) with the components of each chunk of links (a, b); v is the least node of its star."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up] if up in root else up
        return x

    def stars():
        rows = [(x, find(x)) for x in list(root)]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], names=["u", "v"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > CHUNK_LINKS:
            yield stars()
            root.clear()
    if root:
        yield stars()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component.

    Chunks of links are contracted to stars where they lie, which leaves few;
    then large-star and small-star steps alternate until nothing changes.
    Each is a minimum by key (pre-aggregated before its shuffle) and a join,
    so a node with a third of all links is no group that a task must hold.
    """
    spark = edges.sparkSession
    edges, pairs_path = stored(edges.select("a", "b"), "pairs")
    kind = edges.schema["a"].dataType.simpleString()
    e, path = stored(edges.coalesce(max(1, -(-edges.count() // CHUNK_LINKS))).mapInArrow(_contracted, f"u {kind}, v {kind}"), "links")
    dropped(spark, pairs_path)
    state = _state(e)
    while state[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        before = path
        e, path = stored(small, "links")
        dropped(spark, before)
        now = _state(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
