"""Bottom-k sketches of word shingles as document fingerprints.

A sketch is the k smallest distinct hashes of a text's shingles, as hex text
in order.  Sketches of parts merge into the sketch of the whole; two sketches
estimate resemblance and containment, one estimates the distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import let
from fieldloom.llm.textnum import SLICE_BYTES, shingles

K, DIGITS = 128, 16
#: Rows that a sorted range holds about; the driver sees one boundary for each range.
ROWS_A_RANGE = 20_000


def sketch_texts(texts: list[bytes], k: int = K) -> list[np.ndarray]:
    """The k smallest distinct shingle hashes of each text, in order; a text without words has none."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    hashes, row = shingles(np.frombuffer(b"".join(texts), np.uint8), offsets)
    edge = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        h = hashes[a:b]
        if len(h) > 4 * k:
            near = np.unique(np.partition(h, 2 * k)[: 2 * k])
            h = near if len(near) >= k else h
        out.append(np.unique(h)[:k])
    return out


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance of two sketches' texts; 1 for two texts without words."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    twice = np.concatenate([both[1:] == both[:-1], [False]])
    first = np.concatenate([[True], ~twice[:-1]])
    least = twice[first][:k]
    return float(least.sum() / len(least))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def hashes_of(fingerprint: Column) -> Column:
    """The hashes of a fingerprint as an array of hex text."""
    return F.when(F.length(fingerprint) == 0, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(fingerprint, F.lit(f"(.{{{DIGITS}}})"), F.lit(1)))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of two parts together, from theirs (shingles that span the parts aside)."""
    return F.array_join(F.slice(F.array_sort(F.array_union(hashes_of(a), hashes_of(b))), 1, k), "")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated resemblance of two fingerprints, as likeness()."""
    least = F.slice(F.array_sort(F.array_union(hashes_of(a), hashes_of(b))), 1, k)
    return let(least, lambda x: F.when(F.size(x) == 0, 1.0).otherwise(F.size(F.array_intersect(x, F.array_intersect(hashes_of(a), hashes_of(b)))) / F.size(x)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has: of a's hashes up to the largest that both sketches cover."""
    def share(x, y):
        reach = F.least(F.when(F.size(x) < K, F.lit("g")).otherwise(F.array_max(x)), F.when(F.size(y) < K, F.lit("g")).otherwise(F.array_max(y)))
        own = F.filter(x, lambda h: h <= reach)
        return F.when(F.size(x) == 0, 1.0).otherwise(F.size(F.array_intersect(own, y)) / F.greatest(F.lit(1), F.size(own)))

    return let(hashes_of(a), lambda x: let(hashes_of(b), lambda y: share(x, y)))


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_shingles", pa.float64()),
])
RESULT_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"


def _report(rows: list[tuple[int | None, str]], after: str) -> pa.RecordBatch:
    """Results of consecutive rows; after is the text that follows the last."""
    texts = [t for _, t in rows] + [after]
    edited = []
    for t, n in zip(texts, texts[1:], strict=False):
        cut = len(t) // 3
        edited.append((t[: len(t) - cut] + n[:cut]).encode())
    own = sketch_texts([t.encode() for t in texts])
    new = sketch_texts(edited)
    columns = list(zip(*[
        (i, len(t), hashlib.sha256(e).hexdigest(), to_text(a), to_text(b), likeness(a, b), likeness(a, n), distinct_shingles(a))
        for (i, t), e, a, b, n in zip(rows, edited, own, new, own[1:], strict=False)
    ], strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], schema=RESULT)


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text.

    docs has doc_id and text; other columns are ignored.  The edited text has
    the last third (rounded down) of the code points replaced by the first as
    many, or all, of the next document in descending doc_id; after the last
    comes the first.  A null text is an empty one.  Rows that share a doc_id
    are in order of a hash of their text; rows without one come last.  An
    empty table gives no rows.

    Rows are dealt out by ranges of doc_id, cut at values counted on the ids
    alone; the row that begins a range is also sent to the range before, as
    the next of its last row.  Tasks stream through their sorted rows, so no
    group is held as a whole.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    ranges = max(1, -(-n // ROWS_A_RANGE))
    by_range = ids.where("doc_id is not null").repartitionByRange(ranges, F.desc("doc_id"))
    first = sorted({r[1] for r in by_range.groupBy(F.spark_partition_id()).agg(F.max("doc_id")).collect()}, reverse=True)
    up = np.array(first[::-1], np.int64)
    last = max(0, len(first) - 1)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(doc_id: pd.Series, is_null: pd.Series) -> pd.Series:
        """The row's range; then, as a negative number, the range that it follows, where it begins one."""
        value, none = doc_id.to_numpy(), is_null.to_numpy()
        at = np.where(none, last, np.maximum(0, len(up) - 1 - np.searchsorted(up, value, "left")))
        begins = np.isin(value, up) & ~none if len(up) else none
        return pd.Series([[int(p), -1 - (int(p) - 1 if p else last)] if b else [int(p)] for p, b in zip(at, begins, strict=True)])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(places(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull())).alias("p"))
    rows = rows.withColumns({"range": F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")), "halo": F.col("p") < 0})
    # By number, so no task gets two ranges while another has none.
    rows = rows.repartitionById(max(ranges, 1), F.col("range")).withColumn("h", F.xxhash64("text")).sortWithinPartitions("range", "halo", F.desc("doc_id"), "h")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, at, ended = 0, None, False
        for batch in batches:
            for i in range(batch.num_rows):
                doc, text, place, halo = (batch.column(c)[i].as_py() for c in range(4))
                if place != at:
                    held, size, at, ended = [], 0, place, False
                if ended:
                    continue
                if halo:
                    yield _report(held, text)
                    ended = True
                    continue
                if size > SLICE_BYTES:
                    yield _report(held, text)
                    held, size = [], 0
                held.append((doc, text))
                size += len(text)

    return rows.select("doc_id", "text", "range", "halo").mapInArrow(stream, RESULT_DDL)
