"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is a weighted set of its shingles of five words; the weight is how
often one occurs, so an element's region is that many unit cells.  Each cell
has darts at hashed ranks (a Poisson process that depends on the cell alone);
a dart falls on a hashed coordinate, and the earliest dart of the text is the
coordinate's signature.  Two signatures agree on a coordinate with the
probability of the texts' weighted Jaccard similarity.  Only ranks up to
about (ln k + 2) / weight are thrown, so the work is near weight + k ln k.

Bands of the signature are joined by equality.  In each bucket members are
compared with a hub, not with each other; the compare is on the whole sets of
cells.  Links make classes by connected components.  Buckets that then hold
several classes are finished exactly, see _pivot_pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import free_name, let, sent_if_small, written
from fieldloom.llm.components import connected_components
from fieldloom.llm.textnum import U, mix, shingles, slices, text_buffers

BANDS, BAND_ROWS, SIMILARITY = 24, 5, 0.8
#: Buckets of several classes with at most this many members compare all of them; larger ones filter pairs by a pivot.
SMALL_BUCKET = 32
#: Members that meet a copy of their pivot's cells, about, and members that are asked for it.
PIVOT_MEMBERS, CONSENSUS = 1000, 32
#: Differences that a task puts in order at once; buckets of one row of their counts, and most buckets of a hub.
CHUNK_CELLS, SLICE, MOST_BUCKETS = 1 << 20, 1 << 13, 1 << 21
#: Bytes of a node (16, and an id) in a table that is sent whole.
NODE_BYTES = 64
_UNIT = 2.0**-53


def cells(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each unit cell: the n-th copy of a shingle in a text is its n-th cell."""
    order = np.argsort(mix(hashes ^ mix(row.astype(U) + U(1))))
    h, r = hashes[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(first)
    copy = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    return mix(h + copy.astype(U) * U(0xA24BAED4963EE407)), r


def dart_signatures(cell: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """Rank of the earliest dart on each of k coordinates (columns) for each row; infinite for rows without cells."""
    weight = np.bincount(row, minlength=n_rows)
    reach = (np.log(k) + 2) / np.maximum(weight, 1)
    gap = lambda c, n: -np.log(((mix(c + n * U(0x9E3779B97F4A7C15)) >> U(11)).astype(float) + 0.5) * _UNIT) / k
    number = np.zeros(len(cell), U)
    rank = gap(cell, number)
    best = np.full(n_rows * k, np.inf)
    live = np.flatnonzero(rank <= reach[row])
    while True:
        while len(live):
            c, n = cell[live], number[live]
            on = ((mix(c ^ mix(n + U(0x5851F42D4C957F2D))) >> U(32)) * U(k)) >> U(32)
            np.minimum.at(best, row[live] * k + on.astype(np.int64), rank[live])
            number[live] = n + U(1)
            rank[live] += gap(c, number[live])
            live = live[rank[live] <= reach[row[live]]]
        open_ = np.isinf(best.reshape(n_rows, k)).any(axis=1) & (weight > 0)
        if not open_.any():
            return best.reshape(n_rows, k)
        reach[open_] *= 1.5
        live = np.flatnonzero(open_[row] & (rank <= reach[row]))


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signatures.view(U).reshape(len(signatures), bands, rows)
    total = np.zeros(bits.shape[:2], U)
    for j in range(rows):
        total += mix(bits[:, :, j] + U(j + 1)) * U(2 * j + 3)
    return mix(total + (np.arange(bands, dtype=U) + U(1)) * U(0xD1342543DE82EF95)).astype(np.int64)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _banded(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for a, b, part, edges in slices(data, offsets):
                h, r = shingles(part, edges)
                sig = dart_signatures(*cells(h, r), b - a, bands * rows)
                hashes = band_hashes(sig, bands, rows)
                empty = np.isinf(sig[:, 0])
                counts = np.where(empty, 0, bands)
                made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(hashes[~empty].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), made], names=["doc_id", "node", "bands"])

    return docs.select("doc_id", text_key(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sign, "doc_id bigint, node binary, bands array<bigint>")


def _cell_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, cells) of the texts in nodes (node, rep): distinct 32-bit cell hashes."""
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = sent_if_small(nodes, NODE_BYTES)
    texts = keyed.join(chosen, (F.col("n") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b, part, edges in slices(data, offsets):
                c, r = cells(*shingles(part, edges))
                key = np.unique((r.astype(U) << U(32)) | (c >> U(32)))
                edge = np.searchsorted(key >> U(32), np.arange(b - a + 1).astype(U))
                low = (key & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                made = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(low))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), made], names=["node", "cells"])

    # A row that stands twice has one set.
    return texts.mapInArrow(sets, "node binary, cells array<int>").groupBy("node").agg(F.first("cells").alias("cells"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose texts are at least so similar, by their whole sets of cells."""
    left = sets.select(F.col("node").alias("a"), F.col("cells").alias("cells_a"))
    right = sets.select(F.col("node").alias("b"), F.col("cells").alias("cells_b"))
    shared = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("cells_a", "cells_b")).alias("n"), (F.size("cells_a") + F.size("cells_b")).alias("both"))
    return shared.where((F.col("both") == 0) | (F.col("n") >= similarity * (F.col("both") - F.col("n")) - 1e-9)).select("a", "b")


def _shared_differences(live: DataFrame) -> DataFrame:
    """(hub, slice, at, n): the buckets (slice * SLICE + at) that more than one of live's differences d falls into, and how many do."""
    schema = pa.schema([("hub", pa.binary()), ("slice", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[np.ndarray]] = {}
        size = 0

        def slices_of(full):
            rows = []
            for hub, parts in full.items():
                bucket, n = np.unique(np.concatenate(parts), return_counts=True)
                slice_, first = np.unique(bucket // SLICE, return_index=True)
                rows += [(hub, i, a, c) for i, a, c in zip(slice_, np.split(bucket % SLICE, first[1:]), np.split(n, first[1:]), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for hub, buckets, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.setdefault(hub, []).append(d.values.to_numpy(zero_copy_only=False) & (buckets - 1))
                size += len(d.values)
            if size > 4 << 20:
                yield slices_of(held)
                held.clear()
                size = 0
        yield slices_of(held)

    def total(key: tuple, table: pa.Table) -> pa.Table:
        at, n = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "n"))
        summed = np.bincount(at, weights=n, minlength=SLICE).astype(np.int64)
        shared = np.flatnonzero(summed > 1)
        row = [[key[0].as_py()], [key[1].as_py()], [shared], [summed[shared]]]
        return pa.table([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema).slice(0, min(1, len(shared)))

    made = "hub binary, slice int, at array<int>, n array<bigint>"
    return live.select("hub", "buckets", "d").mapInArrow(count, made).groupBy("hub", "slice").applyInArrow(total, made)


PREFIX = pa.schema([("cell", pa.int64()), ("node", pa.binary()), ("root", pa.binary()), ("e", pa.float64()), ("far", pa.bool_()), ("rest", pa.int32())])
PREFIX_DDL = "cell bigint, node binary, root binary, e double, far boolean, rest int"


def _prefixes(members: pa.Table, slices: pa.Table) -> pa.Table:
    """The first elements of each member's differences in the order of (count of its bucket, cell), but for those whose bucket holds no other."""
    if not len(members) or not len(slices):
        return PREFIX.empty_table()
    at, n = (slices.column(c).combine_chunks() for c in ("at", "n"))
    bucket = np.repeat(slices.column("slice").to_numpy().astype(np.int64) * SLICE, at.value_lengths().to_numpy()) + at.flatten().to_numpy()
    order = np.argsort(bucket)
    bucket, n = bucket[order], n.flatten().to_numpy()[order]
    d = members.column("d").combine_chunks()
    row = np.repeat(np.arange(len(members)), d.value_lengths().to_numpy())
    d = d.flatten().to_numpy()
    own = d & (members.column("buckets")[0].as_py() - 1)
    place = np.minimum(np.searchsorted(bucket, own), len(bucket) - 1)
    shared = bucket[place] == own
    alone = np.bincount(row[~shared], minlength=len(members))
    d, row, n = d[shared], row[shared], n[place[shared]]
    order = np.lexsort((d, n, row))
    d, row = d[order], row[order]
    left = np.bincount(row, minlength=len(members))
    nth = np.arange(len(row)) - (np.cumsum(left) - left)[row]
    take = nth < (members.column("first").to_numpy() - alone)[row]
    of = lambda name: members.column(name).take(pa.array(row[take]))
    return pa.table([pa.array(d[take]), of("node"), of("root"), of("e"), of("far"), pa.array((left[row] - nth)[take].astype(np.int32))], schema=PREFIX)


def _pivot_pairs(state: DataFrame, hubs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different classes in the buckets of hubs (band, n, hub) that may be similar; none that is goes missing.

    The members of all buckets with one hub, together, are compared with a
    consensus T: the cells of more than half of some 32 members, chosen by
    hash.  With D(x) = x xor T, a pair differs in D(x) xor D(y), and is
    similar if that is at most c (|x| + |y|), c = (1 - s) / (1 + s).  So
    |D(x) and D(y)| >= (e(x) + e(y)) / 2 with e(x) = |D(x)| - c |x|.  Let z be
    the member with the least e.  Where e(x) + e(z) <= 0, x is similar to z:
    one pair for each such x, and all of them are near.  The others are far;
    a pair with a far x has e(x) + e(y) > 0, so it shares an element.  Seen
    from a far x it shares at least (e(x) + e(z)) / 2 of them, seen from a
    near y at least (e(y) - e(z)) / 2.  With o of them to share and the rarest
    elements first, a pair meets in one of the first |D| - o + 1 of both:
    edits that both have, not the template they were made from.

    This holds for any T and any one order of the elements.  Rarity is the
    count of a hashed bucket of elements, summed in tasks before they meet; so
    no row is made for an element but for those of the prefixes.  A hub has
    some eight buckets for each element, so that one that no other member has
    (most of an edit's are) is mostly alone in its bucket, and left out; from
    MOST_BUCKETS on, more meet by chance and prefixes are longer again.
    """
    c = (1 - similarity) / (1 + similarity)
    members = written(state.join(hubs.select("band", "hub"), "band").select("hub", "node", "root").distinct(), "pivot-nodes")
    sizes = members.groupBy("hub").agg(F.count("*").alias("members")).select("*", (F.col("members") / PIVOT_MEMBERS).cast("bigint").alias("parts"))
    sizes = sent_if_small(written(sizes, "pivot-sizes"), NODE_BYTES)
    sized = members.join(sizes, "hub")
    every = F.greatest(F.lit(1), F.floor(F.col("members") / CONSENSUS))
    chosen = sized.where((F.pmod(F.xxhash64(F.lit(1), "node"), every) == 0) | (F.col("node") == F.col("hub"))).select("hub", "node")
    asked = chosen.join(sets, "node").groupBy("hub").agg(F.collect_list("cells").alias("all"))
    most = F.floor(F.size("all") / 2).cast("int")
    consensus = let(F.sort_array(F.flatten("all")), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + most) == x, F.lit(False)))))
    pivots = asked.select("hub", consensus.alias("pivot")).join(sizes, "hub").select("hub", "pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts"))).alias("part"))
    xor = lambda a, b: F.array_union(F.array_except(a, b), F.array_except(b, a))
    placed = sized.select("*", F.pmod(F.xxhash64("node"), F.col("parts") + 1).alias("part")).join(sets, "node").join(pivots, ["hub", "part"])
    turned = placed.select("hub", "node", "root", "members", F.size("cells").alias("size"), F.transform(xor("cells", "pivot"), lambda x: F.xxhash64("hub", x)).alias("d"))
    turned = written(turned.select("*", (F.size("d") - c * F.col("size")).alias("e")), "pivot-cells")
    least = turned.groupBy("hub").agg(F.min("e").alias("least"), F.min_by(F.struct("node", "root"), "e").alias("z"), F.sum(F.size("d")).alias("cells"))
    least = sent_if_small(written(least, "pivot-least"), 2 * NODE_BYTES)
    half = F.when(F.col("far"), F.col("e") + F.col("least")).otherwise(F.col("e") - F.col("least")) / 2
    seen = turned.join(least, "hub").withColumn("far", F.col("e") + F.col("least") > 1e-9)
    similar = seen.where("not far and root <> z.root").select(F.least("node", "z.node").alias("a"), F.greatest("node", "z.node").alias("b"))
    # Hubs whose members are all near are done.
    with_far = sent_if_small(written(seen.where("far").select("hub").distinct(), "pivot-far"), NODE_BYTES)
    live = seen.withColumn("first", F.size("d") + 1 - F.greatest(F.lit(1), F.ceil(half - 1e-6).cast("int"))).where("first > 0").join(with_far, "hub", "left_semi")
    buckets = F.least(F.lit(MOST_BUCKETS), F.greatest(F.lit(SLICE), F.pow(F.lit(2), F.ceil(F.log2(8 * F.col("cells")))))).cast("int")
    chunks = F.floor(F.col("cells") / CHUNK_CELLS)
    live = written(live.select("hub", F.pmod(F.xxhash64("node"), chunks + 1).alias("chunk"), chunks.alias("chunks"), "node", "root", "e", "far", "first", buckets.alias("buckets"), "d"), "pivot-members")
    counted = written(_shared_differences(live), "pivot-counts")
    spread = counted.join(sent_if_small(live.select("hub", "chunks").distinct(), NODE_BYTES), "hub").select("hub", "slice", "at", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks"))).alias("chunk"))
    # As many elements as follow in both, this one included, are the most that a pair shares from its first common one on.
    made = live.groupBy("hub", "chunk").cogroup(spread.groupBy("hub", "chunk")).applyInArrow(_prefixes, PREFIX_DDL)
    entries = written(made.select("cell", F.struct("node", "root", "e", "far", "rest").alias("x")), "pivot-prefixes")
    met = entries.where("x.far").withColumnRenamed("x", "a").join(entries.withColumnRenamed("x", "b"), "cell")
    met = met.where("a.root <> b.root and (not b.far or a.node < b.node) and least(a.rest, b.rest) >= (a.e + b.e) / 2 - 1e-6")
    return similar.union(met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")))


def near_duplicate_links(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """((doc_id, node) of every row, (node, root) of every node with a link); node is a text, root its class."""
    signed = written(_banded(docs, bands, rows), "signatures")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    banded = written(nodes.select("node", "rep", F.explode("bands").alias("band")), "bands")
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    live = written(banded.join(shared, "band").select("band", "node", "rep"), "buckets")
    sets = written(_cell_sets(docs, live.select("node", "rep").distinct()), "cells")

    # First each bucket's members meet one of them, by a hash; then the one with the most links so far.
    def meet(hubs: DataFrame, members: DataFrame) -> DataFrame:
        pairs = members.join(hubs, "band").where("node <> hub")
        return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    by_hash = live.groupBy("band").agg(F.max_by("node", F.xxhash64("band", "node")).alias("hub"))
    links = written(_verified(meet(by_hash, live), sets, similarity), "near-links")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    # Ties go to the same node in every band, so buckets share their hubs.
    central = F.max_by("node", F.struct(F.coalesce("degree", F.lit(0)), F.xxhash64("node")))
    hubs = written(live.join(degree, "node", "left").groupBy("band").agg(central.alias("hub")), "hubs")
    more = meet(hubs, live)
    links = links.union(written(_verified(more.join(links, ["a", "b"], "left_anti"), sets, similarity), "near-links"))
    roots = written(connected_components(links), "roots")

    # Buckets that still hold several classes: small ones compare all members, large ones all that the pivot leaves.
    rooted = live.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("n")).where("r1 <> r2").select("band", "n")
    state = written(rooted.join(several, "band"), "bucket-state")
    few = state.where(F.col("n") <= SMALL_BUCKET)
    other = few.select("band", F.col("node").alias("b"), F.col("root").alias("root_b"))
    pairs = few.join(other, "band").where("node < b and root <> root_b").select(F.col("node").alias("a"), "b")
    large = several.where(F.col("n") > SMALL_BUCKET)
    if not large.isEmpty():
        # Buckets whose hubs are of one class are filtered together, by one of these hubs: a member stands once for all of them.
        of_class = large.join(hubs, "band").join(roots.withColumnRenamed("node", "hub"), "hub", "left").withColumn("root", F.coalesce("root", "hub"))
        pivots = of_class.groupBy("root").agg(F.max_by("hub", F.struct("n", "hub")).alias("pivot"))
        large = written(of_class.join(pivots, "root").select("band", "n", F.col("pivot").alias("hub")), "pivots")
        pairs = pairs.union(_pivot_pairs(state, large, sets, similarity))
    found = written(_verified(pairs.distinct(), sets, similarity), "near-links")
    if not found.isEmpty():
        roots = written(connected_components(links.union(found)), "roots")
    return signed.select("doc_id", "node"), roots


def near_duplicate_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id and class_size of each row of docs (doc_id, text; other columns are ignored).

    Rows whose texts have a weighted Jaccard similarity of 0.8 or more on
    shingles of five words, and rows linked through others, share a class;
    class_id is its least doc_id (null where all are null).  Equal texts share
    a class.  A null text is an empty one; a text without words shares a class
    with its equals only.  Repeated rows are rows of their own.  An empty
    table gives no rows.  A pair at exactly 0.8 shares no band, and so may be
    missed, with a probability under 1 in 10,000.
    """
    rows, roots = near_duplicate_links(docs, **options)
    placed = rows.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    classes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return placed.join(classes, "root").select("doc_id", "class_id", "class_size")


def keep_one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that have the least doc_id of their class, one for each class; all columns are kept."""
    rows, roots = near_duplicate_links(docs, **options)
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    node, kept_node, kept_id = free_name(docs, "near_node"), free_name(docs, "kept_node"), free_name(docs, "kept_id")
    kept = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k")).select(F.col("k.node").alias(kept_node), F.col("k.doc_id").alias(kept_id))
    copies = rows.groupBy("node", "doc_id").agg(F.count("*").alias("n")).where("n > 1")
    kept = written(kept, "kept-rows")
    again = not copies.limit(1).isEmpty()
    keyed = docs.withColumn(node, text_key(F.col("text")))
    out = keyed.join(sent_if_small(kept, NODE_BYTES), (F.col(node) == F.col(kept_node)) & keyed["doc_id"].eqNullSafe(F.col(kept_id)), "left_semi")
    if again:
        out = out.dropDuplicates(["doc_id", node])
    return out.drop(node)
