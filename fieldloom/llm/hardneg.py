"""Hard negatives of anchors by angular triangle filtering.

Vectors become integers, so scores are exact inner products.  Reference
directions are fitted on a bounded sample; every vector stores its norm and
its angles to them.  For an anchor a and a row x the angle between them is at
least |A - X| and at most min(A + X, 2 pi - A - X), A and X being their angles
to any one reference; so their cosine lies in an interval, and norms make of it
bounds of their score, moved apart by more than the rounding.

Rows lie in blocks by their nearest reference, in order of the angle to it.
Of a block an anchor takes the run of rows whose angle alone allows the scores
it looks for, then drops rows that another reference rules out; only what is
left is scored.  It looks for at least the k-th best positive so far, or for
scores inside a window of one of its positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import sent_if_small, written

#: Rows that the reference directions are fitted on at most, their number, and rounds of fitting.
SAMPLE_ROWS, REFERENCES, FIT_ROUNDS = 4096, 16, 8
#: Rows of a block at most, about, and blocks that a table has at least.
BLOCK_ROWS, LEAST_BLOCKS = 1 << 17, 24
#: Anchors that stream through one copy of a block, and those of one row.
GROUP_ANCHORS, PACK_ANCHORS = 1 << 17, 64
#: Bytes of a row of counts or ids that is sent whole.
COUNT_BYTES = 64
#: Angles are moved by this much, and scores by so large a part of the norms' product: both are far above the rounding of doubles.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
#: Rows that an anchor scores at once before it raises its least score.
STEP = 1 << 10
EXACT = float(1 << 53)


def fitted_references(sample: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """n unit vectors (fewer where the sample has fewer): the farthest of the sample by turns, then rounds of spherical means."""
    norm = np.linalg.norm(sample, axis=1)
    unit = sample[norm > 0] / norm[norm > 0][:, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    refs = unit[chosen]
    for _ in range(FIT_ROUNDS):
        own = np.argmax(unit @ refs.T, axis=1)
        sums = np.zeros_like(refs)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        refs = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), refs)
    return refs


def angles_to(vectors: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to each reference (zero vectors: a right angle; their scores are 0 in any case)."""
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    cosine = (vectors @ refs.T) / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.arccos(np.clip(cosine, -1, 1))


def score_bounds(norm_a: float, angles_a: np.ndarray, norms: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest scores that the stored angles allow (angles is rows by references); never too narrow."""
    nearest = np.maximum(np.abs(angles - angles_a).max(axis=1) - ANGLE_SLACK, 0)
    summed = angles + angles_a
    farthest = np.minimum(np.minimum(summed, 2 * np.pi - summed).min(axis=1) + ANGLE_SLACK, np.pi)
    size = norm_a * norms
    return size * np.cos(farthest) - size * SCORE_SLACK, size * np.cos(nearest) + size * SCORE_SLACK


class Block:
    """Rows of one reference in order of their angle to it, with what an anchor needs to score some of them."""

    def __init__(self, own: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norms: np.ndarray, angles: np.ndarray) -> None:
        order = np.lexsort((ids, angles[:, own]))
        self.own, self.ids, self.labels, self.vectors, self.norms, self.angles = own, ids[order], labels[order], vectors[order], norms[order], angles[order]
        self.longest = float(norms.max(initial=0))

    def run(self, norm: float, angle: float, least: float) -> tuple[int, int]:
        """Rows whose angle to the reference allows a score of least; all of them where that isn't positive."""
        size = norm * self.longest * (1 + SCORE_SLACK)
        if least <= 0:
            return 0, len(self.ids)
        if least > size:
            return 0, 0
        reach = np.arccos(least / size) + ANGLE_SLACK
        own = self.angles[:, self.own]
        return int(np.searchsorted(own, angle - reach)), int(np.searchsorted(own, angle + reach, "right"))

    def scores(self, rows: np.ndarray, anchor: np.ndarray, norm: float) -> np.ndarray:
        """Inner products, exact: in doubles where no partial sum can reach 2**53, else in 64-bit integers."""
        part, size = self.vectors[rows], norm * self.longest
        if size >= 2.0**62:
            raise OverflowError("scores don't fit in 64 bits")
        return (part @ anchor).astype(np.int64) if size < EXACT else part.astype(np.int64) @ anchor.astype(np.int64)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def best_of_block(block: Block, anchor_id: int, anchor: np.ndarray, norm: float, angles: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows with the highest scores, ties by id, the anchor itself left out; the nearest angles first."""
    angle = angles[block.own]
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    middle = int(np.searchsorted(block.angles[:, block.own], angle))
    done_lo = done_hi = middle
    step = STEP
    while done_lo > 0 or done_hi < len(block.ids):
        lo, hi = max(0, done_lo - step), min(len(block.ids), done_hi + step)
        step *= 2
        if len(ids) == k:
            a, b = block.run(norm, angle, float(scores[-1]))
            lo, hi = max(lo, min(a, done_lo)), min(hi, max(b, done_hi))
            if lo == done_lo and hi == done_hi:
                break
        rows = np.concatenate([np.arange(lo, done_lo), np.arange(done_hi, hi)])
        if len(ids) == k:
            _, most = score_bounds(norm, angles, block.norms[rows], block.angles[rows])
            rows = rows[most >= scores[-1]]
        rows = rows[block.ids[rows] != anchor_id]
        if len(rows):
            ids, scores = _first(np.concatenate([ids, block.ids[rows]]), np.concatenate([scores, block.scores(rows, anchor, norm)]), k)
        done_lo, done_hi = lo, hi
    return ids, scores


def windows_of_block(block: Block, label: int, anchor: np.ndarray, norm: float, angles: np.ndarray, windows: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(number, ids, scores) for each window (least, most) of scores: its k highest of other labels, ties by id."""
    a, b = block.run(norm, angles[block.own], float(windows[:, 0].min()))
    if a >= b:
        return []
    least, most = score_bounds(norm, angles, block.norms[a:b], block.angles[a:b])
    overlap = np.zeros(b - a, bool)
    for lo, hi in windows:
        overlap |= (most >= lo) & (least <= hi)
    rows = np.flatnonzero(overlap & (block.labels[a:b] != label)) + a
    if not len(rows):
        return []
    scores, ids, out = block.scores(rows, anchor, norm), block.ids[rows], []
    for i, (lo, hi) in enumerate(windows):
        fits = np.flatnonzero((scores >= lo) & (scores <= hi))
        if len(fits):
            out.append((i, *_first(ids[fits], scores[fits], k)))
    return out


MEASURED = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("cell", pa.int32()), ("vector", pa.list_(pa.int32())), ("norm", pa.float64()), ("angles", pa.list_(pa.float64()))])
MEASURED_DDL = "vec_id bigint, label int, cell int, vector array<int>, norm double, angles array<double>"


def usable(table: DataFrame, shift: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector) of the rows of table (vec_id, embedding, label) that take part.

    Rows with a null id, label or vector, or any null or non-finite component,
    take no part, nor do vectors of another length than the most frequent
    one.  Where vec_id is divisible by shift the label becomes the
    next of labels; components become floor(scale * x) (as 32-bit numbers: a
    larger one is an error in ANSI mode).
    """
    whole = F.coalesce(F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))
    label = F.when(F.pmod("vec_id", F.lit(shift)) == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("int"))
    table = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole & (F.size("embedding") > 0))
    lengths = table.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return table.where(F.size("embedding") == F.lit(lengths.n if lengths else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), vector.alias("vector"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def with_angles(rows: DataFrame) -> DataFrame:
    """rows with norms, angles to fitted references and the nearest one (cell); all vectors have one length."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(SAMPLE_ROWS).collect()  # the bound is SAMPLE_ROWS
    refs = fitted_references(np.array([r[0] for r in sample], float)) if sample else np.zeros((0, 0))
    if not len(refs):
        refs = np.eye(1, len(sample[0][0]) if sample else 1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            norm, angles = angles_to(_matrix(batch.column(2)), refs)
            edges = pa.array(np.arange(len(norm) + 1) * len(refs), pa.int32())
            columns = [batch.column(0), batch.column(1), pa.array(np.argmin(angles, axis=1).astype(np.int32)), batch.column(2), pa.array(norm), pa.ListArray.from_arrays(edges, pa.array(angles.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, schema=MEASURED)

    return rows.select("vec_id", "label", "vector").mapInArrow(measure, MEASURED_DDL)


def _blocks(rows: DataFrame, *by: str) -> DataFrame:
    """rows with the name of their block: rows of equal by, dealt by hash over several blocks where they are many."""
    size = max(1, min(BLOCK_ROWS, -(-rows.count() // LEAST_BLOCKS)))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.ceil(F.col("n") / size).cast("int").alias("parts"))
    parted = rows.join(sent_if_small(written(counts, "block-parts"), COUNT_BYTES), list(by))
    return parted.withColumn("block", F.concat_ws(":", *by, F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")))).drop("parts")


def _met(blocked: DataFrame, anchors: DataFrame, same_label: bool, work, ddl: str) -> DataFrame:
    """Rows that work(block, anchor) gives for each block and each anchor that it concerns; work's columns are as in ddl.

    Packs of anchors are sent to every block (to those of their label where
    same_label is true), and lie behind its rows in a sorted partition: a task
    holds one block and streams the anchors.  Beyond GROUP_ANCHORS anchors
    there are several groups, each with a copy of the block.
    """
    n = anchors.count()
    groups, packs = max(1, -(-n // GROUP_ANCHORS)), max(1, -(-n // PACK_ANCHORS))
    by = ["label"] if same_label else []
    packed = anchors.withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.lit(packs)).cast("int")).groupBy("pack", *by).agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors"))
    packed = packed.withColumn("part", F.pmod("pack", F.lit(groups))).drop("pack")
    part = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part")
    row = F.struct("vec_id", "label", "cell", "vector", "norm", "angles").alias("row")
    rows = blocked.select("block", part, row)
    places = blocked.select("block", *by).distinct().select("block", *by, part)
    sent = places.join(packed, ["part", *by]).select("block", "part", "anchors")
    both = rows.unionByName(sent, allowMissingColumns=True).withColumn("unit", F.concat_ws(":", "block", "part"))
    laid = both.repartition("unit").sortWithinPartitions("unit", F.col("row").isNull()).select("unit", "row", "anchors")
    names = [c.split()[0] for c in ddl.split(", ")]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit, block = [], None, None
        for batch in batches:
            units, is_row = batch.column(0).to_pylist(), batch.column(1).is_valid().to_pylist()
            for a, b in _runs(units, is_row):
                if units[a] != unit:
                    held, unit, block = [], units[a], None
                if is_row[a]:
                    held.append(batch.column(1).slice(a, b - a))
                    continue
                if block is None:
                    block, held = _block_of(pa.chunked_array(held)), []
                found = [row for pack in batch.column(2).slice(a, b - a) for anchor in pack.as_py() for row in work(block, anchor)]
                yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in found], pa.int64()) for i in range(len(names))], names=names)

    return laid.mapInArrow(meet, ddl)


def _runs(*columns: list) -> Iterator[tuple[int, int]]:
    """Bounds of runs of equal rows."""
    keys, a = list(zip(*columns, strict=True)), 0
    for b in range(1, len(keys) + 1):
        if b == len(keys) or keys[b] != keys[a]:
            yield a, b
            a = b


def _block_of(rows: pa.ChunkedArray) -> Block:
    rows = pa.Table.from_struct_array(rows)
    one = lambda name: rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)
    return Block(int(rows.column("cell")[0].as_py()), one("vec_id"), one("label"), _matrix(rows.column("vector")), one("norm"), _matrix(rows.column("angles")))


def _of(anchor: dict) -> tuple[np.ndarray, float, np.ndarray]:
    return np.array(anchor["vector"], float), anchor["norm"], np.array(anchor["angles"])


def mine_hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least_pct: int = 50, most_pct: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows has vec_id, label, vector (integers of one length); anchors are some
    of these rows.  A score is the inner product with the anchor; higher ones
    come first, ties by smaller vec_id.  An anchor's positives are its first
    other rows of the same label, all where there are fewer.  Rows that share
    the anchor's vec_id are not other rows, and the least (label, vector) of
    them is the anchor; other repeated rows stand as often as they are.  For each, the first rows of other labels whose score lies
    between least_pct and most_pct percent of the positive's are its
    negatives.  An anchor without positives, or a positive without negatives,
    has no rows, and so has an empty table.
    """
    measured = written(with_angles(rows), "angles")
    ids = sent_if_small(written(anchors.select(F.col("vec_id").alias("id")).distinct(), "anchor-ids"), COUNT_BYTES)
    chosen = measured.join(ids, F.col("vec_id") == F.col("id"), "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vector", "norm", "angles")).alias("a"))
    chosen = written(chosen.select("vec_id", "a.*"), "anchors")

    def nearest(block: Block, anchor: dict) -> Iterator[tuple]:
        for row in zip(*best_of_block(block, anchor["vec_id"], *_of(anchor), positives), strict=True):
            yield anchor["vec_id"], *row

    near = _met(_blocks(measured, "label", "cell"), chosen, True, nearest, "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    # Whole numbers s with least_pct * p <= 100 * s <= most_pct * p.
    floor = lambda x: (x - F.pmod(x, F.lit(100))) / 100
    p = F.col("positive_score")
    window = F.struct("positive_id", "positive_score", (-floor(-least_pct * p)).cast("long").alias("least"), floor(most_pct * p).cast("long").alias("most"))
    asked = near.select("anchor_id", window.alias("w")).where("w.least <= w.most").groupBy("anchor_id").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    looking = written(chosen.join(asked, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "anchors-with-windows")

    def inside(block: Block, anchor: dict) -> Iterator[tuple]:
        asked = anchor["windows"]
        bounds = np.array([(w["least"], w["most"]) for w in asked], np.int64)
        for i, ids, scores in windows_of_block(block, anchor["label"], *_of(anchor), bounds, negatives):
            for row in zip(ids, scores, strict=True):
                yield anchor["vec_id"], asked[i]["positive_id"], asked[i]["positive_score"], *row

    made = _met(_blocks(measured, "cell"), looking, False, inside, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
