"""Histogram sort: shards of near-equal bytes, cut at counted key boundaries.

Rows have a 128-bit key: a hash of the group value, then a hash of the row.
Splitters are searched for as in histogram sort: the exact bytes and rows
below candidate boundaries (a radix grid over the key) are counted in one
aggregation over all partitions; boundaries within tolerance of their target
are settled, and only the grid cells that hold an open one are probed again
with the next bits.  Then the rows are exchanged once, by range.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import sent_if_small, written

#: Bits of the key that a round of probes adds; the first round has 2**16 candidates.
ROUNDS = (16, 12, 12, 12, 12, 16, 12, 12, 12, 12)
#: A splitter is settled when it is within this share of a shard's mean bytes of its target.
TOLERANCE = 0.002
ROWS_A_RANGE = 1_000_000
#: Bytes of an open cell, and of a range's start, in tables that are sent whole.
CELL_BYTES = 64


def _bits(upto: int, width: int) -> Column:
    """Bits [upto-width, upto) of the 128-bit key, counted from the top; rounds never cross from k1 to k2."""
    name, last = ("k1", upto) if upto <= 64 else ("k2", upto - 64)
    return F.shiftrightunsigned(F.col(name), 64 - last).bitwiseAND(F.lit((1 << width) - 1))


def find_splitters(keys: DataFrame, targets: list[float], tolerance: float) -> list[tuple[int, int, int, int]]:
    """For each target of bytes below: (key of 128 bits, bits used, bytes below, rows below); keys has k1, k2, size.

    The driver sees one grid of at most 2**16 counts, then, for each open
    splitter, one of 2**12: bounded by the number of splitters alone.
    """
    found: list[tuple[int, int, int, int] | None] = [None] * len(targets)
    # Open cells: key prefix -> (bytes below, rows below, splitters that lie in it).
    cells: dict[int, tuple[int, int, list[int]]] = {0: (0, 0, list(range(len(targets))))}
    used = 0
    for width in ROUNDS:
        if not cells:
            break
        grid = keys
        if used:
            spark = keys.sparkSession
            live = spark.createDataFrame(pa.table({"cell": pa.array([_prefix_value(p, used) for p in cells], pa.string())}))
            grid = grid.withColumn("cell", _prefix_column(used)).join(sent_if_small(live, CELL_BYTES), "cell", "left_semi")
        counts = grid.groupBy("cell" if used else F.lit("").alias("cell"), _bits(used + width, width).alias("probe")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        by_cell: dict[str, list[tuple[int, int, int]]] = {}
        for r in counts:
            by_cell.setdefault(r["cell"], []).append((r["probe"], r["bytes"], r["n"]))
        following: dict[int, tuple[int, int, list[int]]] = {}
        for prefix, (below, rows, mine) in cells.items():
            probes = sorted(by_cell.get(_prefix_value(prefix, used) if used else "", []))
            edges, at, n = [], below, rows
            for probe, size, count in probes:
                edges.append((at, n, probe))
                at, n = at + size, n + count
            edges.append((at, n, 1 << width))
            starts = [e[0] for e in edges]
            for i in mine:
                j = max(0, bisect_right(starts, targets[i]) - 1)
                near = min((abs(e[0] - targets[i]), k) for k, e in enumerate(edges) if j <= k <= j + 1)
                best = edges[near[1]]
                single = j + 1 >= len(edges) or edges[j + 1][1] - edges[j][1] <= 1
                if near[0] <= tolerance or used + width >= 128 or single:
                    found[i] = (((prefix << width) + best[2]) << (128 - used - width), used + width, best[0], best[1])
                else:
                    cell = (prefix << width) + edges[j][2]
                    following.setdefault(cell, (edges[j][0], edges[j][1], []))[2].append(i)
        cells, used = following, used + width
    return found


def _prefix_value(prefix: int, used: int) -> str:
    top = f"{prefix << (128 - used):032X}"
    return top[: -(-used // 4)]


def _prefix_column(used: int) -> Column:
    key = F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0"))
    return F.substring(key, 1, -(-used // 4))


def _row_key(tie: list[str]) -> Column:
    """48 bits of the row's hash, then 16 of its place: identical rows differ too."""
    place = F.xxhash64(F.monotonically_increasing_id())
    return F.xxhash64(*tie).bitwiseAND(F.lit(-65536)).bitwiseOR(place.bitwiseAND(F.lit(65535)))


def histogram_shards(docs: DataFrame, n_shards: int, group: str, size: Column, carry: list[Column], tie: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """carry, size, shard and slot for each row of docs.

    Shards have near-equal sums of size; slot counts from 0 within a shard
    without gaps.  Rows are sorted by a hash of group (equal groups adjoin and
    share a shard unless a boundary must cut the group to stay within
    tolerance), then by a hash of the tie columns that ends in bits of the row's
    place, so a group of any size can be cut, one of identical
    rows too.  Nulls in group or tie columns are values like others.  An empty
    table gives no rows; a shard may be empty where there are few rows.
    carry's names must differ from size, shard, slot, base, k1 and k2; with the
    text among them whole rows are exchanged, else only what is carried.
    """
    spark = docs.sparkSession
    keys = written(docs.select(*carry, size.cast("long").alias("size"), F.xxhash64(group).alias("k1"), _row_key(tie).alias("k2")), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    # Each shard is cut into some ranges, so that no task holds a whole shard.
    per = max(4, -(-total["n"] // (n_shards * ROWS_A_RANGE)))
    n_ranges = n_shards * per
    mean = total["b"] / n_ranges
    cuts = find_splitters(keys, [mean * (i + 1) for i in range(n_ranges - 1)], max(1.0, tolerance * mean * per)) if total["n"] else []
    below = [(0, 0)] + [c[2:] for c in cuts]

    # For each of the 2**16 first cells: the cuts before it, and those inside it.
    inside: dict[int, list[str]] = {}
    for key, *_ in cuts:
        if key < 1 << 128:
            inside.setdefault(key >> 112, []).append(f"{key:032X}")
    before, n = [], 0
    for cell in range(1 << 16):
        before.append(n)
        n += len(inside.get(cell, ()))
    place = spark.createDataFrame(pa.table({"cell": pa.array(range(1 << 16), pa.int32()), "before": pa.array(before, pa.int32()), "cuts": pa.array([sorted(inside.get(c, ())) for c in range(1 << 16)], pa.list_(pa.string()))}))
    full = F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0"))
    ranged = keys.withColumn("cell", _bits(16, 16).cast("int")).join(F.broadcast(place), "cell")  # 2**16 rows
    ranged = ranged.withColumn("range", F.col("before") + F.size(F.filter("cuts", lambda c: c <= full)))
    firsts = [n for _, n in below]
    starts = spark.createDataFrame(pa.table({"range": pa.array(range(len(firsts)), pa.int32()), "base": pa.array([n - firsts[i // per * per] for i, n in enumerate(firsts)], pa.int64())}))
    ranged = ranged.join(sent_if_small(starts, CELL_BYTES), "range")
    shard = F.floor(F.col("range") / per).cast("int")
    names = [c for c in keys.columns if c not in ("k1", "k2")]
    number = F.row_number().over(Window.partitionBy("range").orderBy("k1", "k2", *[c for c in names if c != "size"])) - 1
    return ranged.select(*names, shard.alias("shard"), (F.col("base") + number).alias("slot"))
