"""Mixing sources to target weights, by blocks of words.

Each source's documents are laid end to end, in pseudorandom order, and cut
into blocks of a fixed number of words.  Every output shard draws its counts
of blocks per source from a multinomial over what is left of the sources'
quotas; the slots of a source, numbered over all shards, go through a
pseudorandom permutation of its blocks (a new one for each epoch); slots and
blocks are joined by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import WORD, sent_if_small, written
from fieldloom.llm.textnum import mix as mixed_bits
from fieldloom.llm.textnum import slices, text_buffers, word_bounds

BLOCK_WORDS, OUTPUT_SHARDS, SEED, MAX_REPEATS = 64, 64, 17, 3
#: Rows of the table for each chunk that a source is laid out in; offsets are sums over chunks, then within one.
ROWS_A_CHUNK = 20_000
MIN_CHUNKS, MAX_CHUNKS = 64, 1_000_000
#: More sources than this raise an error: weights are given for each, so they are few.
MAX_SOURCES = 10_000
SOURCE_BYTES = 256
SLOTS_A_TASK = 250_000


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, where none is above cap times its size; what is above is shared among the rest by weight."""
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        all_weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / all_weight > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / all_weight
            break
        for i in over:
            target[i] = float(cap * sizes[i])
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def draw_counts(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) in each shard (rows): multinomial by what is left, so columns sum to the quotas."""
    rng, left = np.random.default_rng(seed), np.array(quotas, np.int64)
    out = np.zeros((n_shards, len(quotas)), np.int64)
    for i in range(n_shards):
        want = int(left.sum()) // (n_shards - i)
        while want > 0:
            drawn = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[i] += drawn
            left -= drawn
            want -= int(drawn.sum())
    return out


def permuted(at: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..n-1 chosen by key, elementwise: a Feistel network over the next power of 4, walked until below n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, key = at.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(4):
            left, right = right, left ^ (mixed_bits(right + k + np.uint64(0x9E37 * (r + 1))) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


@F.pandas_udf(T.LongType())
def _permuted(at: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(at.to_numpy(), n.to_numpy(), key.to_numpy()))


def lay_out(docs: DataFrame, block_words: int = BLOCK_WORDS, cap: float = MAX_REPEATS, keep_text: bool = False) -> tuple[DataFrame, list[dict]]:
    """(documents with rid and size; rid, copy, s and start within its source of each row, where rows that repeat each other share the first's rid; the sources in order)."""
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    columns = docs.columns if keep_text else ["doc_id", "source"]
    rows = written(docs.select(*[F.col(c).alias(f"in_{c}") for c in columns], F.monotonically_increasing_id().alias("rid"), size.alias("size"), F.xxhash64("doc_id", "text").alias("h"), F.xxhash64(*columns).alias("same")), "mix-documents")
    found = rows.groupBy(F.col("in_source").alias("source")).agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    weights = [1.0 + i % 3 for i in range(len(found))]
    targets = water_fill(sizes, weights, sum(sizes), cap)
    sources = [{"s": i, "source": r["source"], "size": z, "target": t, "blocks": -(-z // block_words)} for i, (r, z, t) in enumerate(zip(found, sizes, targets, strict=True))]
    schema = "s int, source string, source_size bigint, target double, blocks bigint"
    side = rows.sparkSession.createDataFrame([(x["s"], x["source"], x["size"], x["target"], x["blocks"]) for x in sources], schema)
    named = rows.join(sent_if_small(side, SOURCE_BYTES), F.col("in_source").eqNullSafe(F.col("source")), "inner").drop("source")
    # Rows that repeat each other are one row with a count: they don't meet in a window.
    alike = named.groupBy("s", "h", "in_doc_id", "size", "same", "source_size", "target").agg(F.min("rid").alias("rid"), F.count("*").alias("n"))
    chunks = max(MIN_CHUNKS, min(MAX_CHUNKS, -(-rows.count() // ROWS_A_CHUNK)))
    alike = alike.withColumn("chunk", F.pmod("h", F.lit(chunks)).cast("int")).withColumn("words", F.col("size") * F.col("n"))
    bases = alike.groupBy("s", "chunk").agg(F.sum("words").alias("w"))
    bases = bases.select("s", "chunk", (F.sum("w").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")).alias("base"))
    within = F.sum("words").over(Window.partitionBy("s", "chunk").orderBy("h", "in_doc_id", "size", "same").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    slim = alike.select("rid", "n", "in_doc_id", "s", "chunk", "size", "same", within.alias("within"), "source_size", "target")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("copy")
    placed = slim.join(bases, ["s", "chunk"]).select("rid", copies, F.col("in_doc_id").alias("doc_id"), "s", "size", (F.col("base") + F.col("within")).alias("start"), "source_size", "target")
    return rows, placed.withColumn("start", F.col("start") + F.col("copy") * F.col("size")), sources


def draw_spans(placed: DataFrame, sources: list[dict], block_words: int = BLOCK_WORDS, n_shards: int = OUTPUT_SHARDS, seed: int = SEED) -> DataFrame:
    """What the mix holds: shard, s, slot, epoch, block, rid, copy, word_from, word_to; a slot's rows are one block of words."""
    spark = placed.sparkSession
    quotas = []
    for x in sources:
        full = min(int(x["target"] // x["size"]), MAX_REPEATS) if x["size"] else 0
        rest = round((x["target"] - full * x["size"]) / block_words)
        quotas.append(full * x["blocks"] + min(rest, x["blocks"]))
    counts = draw_counts(quotas, n_shards, seed) if quotas else np.zeros((0, 0), np.int64)
    first = np.cumsum(counts, axis=0) - counts
    made = [(i, x["s"], int(counts[i, j]), int(first[i, j]), x["blocks"]) for j, x in enumerate(sources) for i in range(len(counts)) if counts[i, j]]
    runs = spark.createDataFrame(made, "shard int, s int, n bigint, first bigint, blocks bigint")
    runs = runs.withColumn("run", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {SLOTS_A_TASK}"))))
    # Tasks by the number of slots: the runs are few rows, and would else be merged into one task.
    runs = runs.repartition(max(1, -(-sum(m[2] for m in made) // SLOTS_A_TASK)), "shard", "s", "run")
    begin = F.col("run") * SLOTS_A_TASK
    slots = runs.select("shard", "s", "blocks", F.explode(F.sequence(F.col("first") + begin, F.col("first") + F.least(F.col("n"), begin + SLOTS_A_TASK) - 1)).alias("slot"))
    slots = slots.withColumn("epoch", F.expr("slot div blocks")).withColumn("block", _permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "s", "epoch")))
    w = F.lit(block_words).cast("long")
    pieces = placed.where("size > 0").select("rid", "copy", "s", "start", "size", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block"))
    pieces = pieces.select("rid", "copy", "s", "block", (F.greatest("start", F.col("block") * w) - F.col("start")).alias("word_from"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * w) - F.col("start")).alias("word_to"))
    # The plan's estimate of the slots is that of the few runs they come from: without the hint they would be broadcast.
    return slots.hint("merge").join(pieces, ["s", "block"]).select("shard", "s", "slot", "epoch", "block", "rid", "copy", "word_from", "word_to")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of docs (doc_id, text, source; other columns are ignored).

    A source's target is its share, by weights 1, 2, 3 in code point order of
    the sources (null last), of all words, and at most MAX_REPEATS times its
    words.  taken counts the words of the row that the mix holds, repeats
    too; at most MAX_REPEATS times its size.  A null or empty text has no
    words and is never taken.  Repeated rows are rows of their own.  Reruns
    agree.  An empty table gives no rows.
    """
    _, placed, sources = lay_out(docs, **options)
    spans = draw_spans(placed, sources, **options)
    taken = spans.groupBy("rid", "copy").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    return placed.join(taken, ["rid", "copy"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def cut_words(text: bytes, spans: list[tuple[int, int]], starts: np.ndarray) -> bytes:
    """The bytes of the words in spans (from, to), with the white space after each; the first word's run begins with the text."""
    edge = lambda k: 0 if k == 0 else len(text) if k >= len(starts) else int(starts[k])
    return b"".join(text[edge(a) : edge(b)] for a, b in spans)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of docs' columns: one for each document and epoch that it is taken in.

    text is the document's taken words in that epoch, in order, with the white
    space after them: the whole text where all words are taken.  n_chars, if
    there, is that text's.  Documents that aren't taken have no row: null and
    empty texts never have one.  Repeated rows are taken each for itself; ties
    in the order go by hash.  Other columns are passed on whatever their
    names.  An empty table gives no rows.
    """
    rows, placed, sources = lay_out(docs, keep_text=True)
    taken = draw_spans(placed, sources).groupBy("rid", "copy", "epoch").agg(F.sort_array(F.collect_list(F.struct("word_from", "word_to"))).alias("spans"))
    joined = rows.join(taken, "rid")
    whole = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.word_to - s.word_from) >= F.col("size")
    joined = joined.withColumn("cut", F.when(~whole, F.col("spans")))
    fields = [f for f in docs.schema.fields]
    text_at = [f.name for f in fields].index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column("cut").to_pylist()
            data, offsets = text_buffers(batch.column("in_text"))
            texts: list[bytes] = []
            for a, _, part, edges in slices(data, offsets):
                starts, _ = word_bounds(part, edges)
                at = np.searchsorted(starts, edges)
                for i in range(len(edges) - 1):
                    raw = part[edges[i] : edges[i + 1]].tobytes()
                    spans = cuts[a + i]
                    texts.append(raw if spans is None else cut_words(raw, [(s["word_from"], s["word_to"]) for s in spans], starts[at[i] : at[i + 1]] - edges[i]))
            new = pa.array(texts, pa.binary()).cast(pa.string())
            arrays = [new if k == text_at else batch.column(f"in_{f.name}") for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    out = joined.select(*[f"in_{f.name}" for f in fields], "cut").mapInArrow(cut, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
