"""Ranked lexical search by Block-Max MaxScore over sharded inverted indexes.

build_index makes one inverted index for each shard of the documents.  A
term's postings lie in blocks of 128, compressed, with each block's last
document and its front: the (occurrences, length) pairs that no other posting
of the block beats in both.  A score grows with the occurrences and falls with
the length, so the front gives the block's exact maximum for any collection's
statistics; these needn't be known when an index is made.

search ranks every query in every shard.  Terms are put in order of their
largest score in the shard.  Those whose sum can't pass the k-th score so far
are non-essential: only documents of the other lists are candidates.  A
candidate meets the non-essential lists from the largest bound down; it is
rejected when its score, the block's maximum and the bounds of the lists that
are left can't pass the k-th score, and only blocks that still have a candidate
are decompressed.  Shards' heaps are merged by a window that Spark limits
before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import dropped, sent_if_small, stored, written
from fieldloom.llm.textnum import slices, text_buffers, word_hashes

#: Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text and documents of a shard, about; one document may be longer.
SHARD_BYTES, SHARD_DOCS = 24 << 20, 1 << 18
#: Postings that are laid out at once; one term may have more.
CHUNK_POSTINGS = 1 << 18
BLOCK = 128
#: Documents of the first window of a shard (each next one has twice as many) and of the largest.
FIRST_WINDOW, LAST_WINDOW = 1 << 10, 1 << 14
#: Query terms that are searched together; bytes of one in a table that is sent whole.
BATCH_TERMS, TERM_BYTES = 100_000, 256
_IS_TERM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
NO_ID = np.iinfo(np.int64).max

INDEX = pa.schema(
    [("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("last", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("fronts", pa.list_(pa.int32())), ("front", pa.list_(pa.int64())), ("postings", pa.binary())]
    + [("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]
)
INDEX_DDL = "shard bigint, term string, df int, last array<int>, sizes array<int>, fronts array<int>, front array<bigint>, postings binary, n_docs bigint, n_terms bigint, doc_ids array<bigint>, lengths array<int>"


def term_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all terms; no term crosses a text's bounds."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    edge = inside[1:] != inside[:-1]
    both = cut & inside[1:] & inside[:-1]  # one term ends and the next begins
    return np.flatnonzero((edge & inside[1:]) | both), np.flatnonzero((edge & inside[:-1]) | both)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values in seven bits a byte, the lowest first, the last byte of each below 128; and the bytes of each."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= np.uint64(1 << bits)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for j in range(5):
        on = np.flatnonzero(size > j)
        part = (values[on] >> np.uint64(7 * j)) & np.uint64(127)
        out[at[on] + j] = part.astype(np.uint8) | np.where(size[on] > j + 1, 128, 0).astype(np.uint8)
    return out, size


def from_varints(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts) if len(ends) else np.zeros(0, np.int64)


def _lists(edges: np.ndarray, flat: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, kind))


def _bytes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given runs of data, as an array of strings."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    flat = data[np.arange(at[-1]) + np.repeat(starts - at[:-1], size)]
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.tobytes())])


class _Shard:
    """Collects the postings of a shard's documents, 16 bytes each, and gives its index as Arrow batches of some terms at a time."""

    def __init__(self) -> None:
        self.ids, self.known, self.lengths, self.hashes, self.docs, self.counts = [], [], [], [], [], []
        self.seen, self.terms, self.term_hashes = np.zeros(0, np.uint64), [], []
        self.n, self.bytes = 0, 0

    def add(self, ids: np.ndarray, known: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        data = _LOWERED[data]
        starts, ends = term_bounds(data, offsets)
        doc = np.searchsorted(offsets, starts, "right") - 1
        hashes = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(first)
        self.hashes.append(h[at])
        self.docs.append((d[at] + self.n).astype(np.uint32))
        self.counts.append(np.diff(np.append(at, len(h))).astype(np.uint32))
        fresh, where = np.unique(h[at], return_index=True)
        new = ~np.isin(fresh, self.seen, assume_unique=True)
        token = order[at[where[new]]]
        self.terms.append(_bytes_of(data, starts[token], ends[token]))
        self.term_hashes.append(fresh[new])
        self.seen = np.union1d(self.seen, fresh[new])
        self.ids.append(ids)
        self.known.append(known)
        self.lengths.append(np.bincount(doc, minlength=len(ids)))
        self.n += len(ids)
        self.bytes += len(data)

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        ids, known, lengths = np.concatenate(self.ids), np.concatenate(self.known), np.concatenate(self.lengths)
        by_id = np.lexsort((ids, ~known))
        number = np.empty(self.n, np.uint32)
        number[by_id] = np.arange(self.n, dtype=np.uint32)
        ids, lengths = ids[by_id], lengths[by_id]
        yield self._documents(shard, np.where(known[by_id], ids, NO_ID), lengths)
        hashes, doc, tf = np.concatenate(self.hashes), number[np.concatenate(self.docs)], np.concatenate(self.counts)
        self.hashes, self.docs, self.counts, self.seen = [], [], [], None
        if not len(hashes):
            return
        order = np.lexsort((doc, hashes))
        hashes, doc, tf = hashes[order], doc[order], tf[order]
        begin = np.append(np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])), len(doc))
        del order, hashes
        terms = pa.concat_arrays(self.terms).take(pa.array(np.argsort(np.concatenate(self.term_hashes))))
        a = 0
        while a < len(terms):
            b = max(a + 1, int(np.searchsorted(begin, begin[a] + CHUNK_POSTINGS, "right")) - 1)
            yield self._terms(shard, terms.slice(a, b - a), begin[a : b + 1] - begin[a], doc[begin[a] : begin[b]].astype(np.int64), tf[begin[a] : begin[b]].astype(np.int64), lengths)
            a = b

    def _terms(self, shard: int, terms: pa.Array, begin: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        df = np.diff(begin)
        previous = np.concatenate([[-1], doc[:-1]])
        previous[begin[:-1]] = -1
        is_first = (np.arange(len(doc)) - np.repeat(begin[:-1], df)) % BLOCK == 0
        block = np.cumsum(is_first) - 1
        first = np.flatnonzero(is_first)
        last = np.append(first[1:], len(doc)) - 1
        # The front of a block: most occurrences first, and of those that follow only the shorter ones.
        length = lengths[doc]
        order = np.lexsort((length, -tf, block))
        falling = length[order] - block[order] * (1 << 40)
        leads = np.ones(len(order), bool)
        leads[1:] = falling[1:] < np.minimum.accumulate(falling)[:-1]
        front = order[leads]
        encoded, size = varints(np.stack([doc - previous, tf], 1).ravel())
        ends = np.concatenate([[0], np.cumsum(size)])[::2]
        edges = np.concatenate([[0], np.cumsum(-(-df // BLOCK))])
        n_front = np.bincount(block[front], minlength=len(first))
        byte_at = np.append(ends[first], ends[-1])
        postings = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(byte_at[edges].astype(np.int32).tobytes()), pa.py_buffer(encoded.tobytes())])
        columns = [
            pa.array(np.full(len(terms), shard)), terms, pa.array(df, pa.int32()), _lists(edges, doc[last], pa.int32()), _lists(edges, np.diff(byte_at), pa.int32()), _lists(edges, n_front, pa.int32()),
            _lists(np.concatenate([[0], np.cumsum(n_front)])[edges], (tf[front] << 32) | length[front], pa.int64()), postings, *[pa.nulls(len(terms), INDEX.field(i).type) for i in range(8, 12)],
        ]
        return pa.RecordBatch.from_arrays(columns, schema=INDEX)

    def _documents(self, shard: int, ids: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        row = {"shard": shard, "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()), "doc_ids": ids, "lengths": lengths.astype(np.int32)}
        return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in INDEX], schema=INDEX)


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The inverted indexes of docs (doc_id, text; other columns are ignored): a row for each term of a shard, and one with its documents.

    Every row is indexed, whole; a null text has no terms; repeated rows are
    documents of their own.  A row whose term is null lists the shard's
    documents in order of doc_id (nulls last, as the largest number) with
    their lengths.  Terms are told apart in a shard by a 64-bit hash: of a
    million terms two meet with a probability under 1 in 10 million.  An empty
    table gives no rows.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), TaskContext.get().partitionId() << 24
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column(1))
            for a, b, part, edges in slices(data, offsets):
                if shard.n and (shard.bytes + len(part) > 2 * shard_bytes or shard.n + b - a > shard_docs):
                    yield from shard.batches(number)
                    shard, number = _Shard(), number + 1
                shard.add(ids[a:b], known[a:b], part, edges)
        if shard.n:
            yield from shard.batches(number)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").coalesce(max(1, -(-size // shard_bytes))).mapInArrow(index, INDEX_DDL)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, item_id, term, times) of queries (item_id, text): query is one for each different row."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    terms = F.regexp_extract_all(lowered, F.lit(f"({TERM})"), F.lit(1))
    distinct = queries.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    return distinct.select(F.sha2(F.concat_ws("\n", F.coalesce(F.col("item_id").cast("string"), F.lit("none")), F.lit(""), "text").cast("binary"), 256).alias("query"), "item_id", F.explode(terms).alias("term")).groupBy("query", "item_id", "term").agg(F.count("*").alias("times"))


class Postings:
    """A term's list in one shard: its blocks, their largest impacts, and their postings when asked."""

    def __init__(self, df: int, last: np.ndarray, sizes: np.ndarray, fronts: np.ndarray, front: np.ndarray, raw: np.ndarray, rate) -> None:
        self.last, self.raw, self.rate = last, raw, rate
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.count = np.full(len(last), BLOCK)
        self.count[-1] = df - BLOCK * (len(last) - 1)
        impacts = rate(front >> 32, front & 0xFFFFFFFF)
        #: With a zero for documents beyond the last block.
        self.most = np.append(np.maximum.reduceat(impacts, np.cumsum(fronts) - fronts), 0)
        self.top = int(self.most.max())

    def decode(self, blocks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks, in order."""
        raw = self.raw[self.begin[blocks[0]] : self.begin[blocks[-1] + 1]] if len(blocks) == blocks[-1] - blocks[0] + 1 else np.concatenate([self.raw[self.begin[b] : self.begin[b + 1]] for b in blocks])
        pairs = from_varints(raw).reshape(-1, 2)
        count = self.count[blocks]
        first = np.cumsum(count) - count
        reached = np.cumsum(pairs[:, 0])
        before = np.where(blocks > 0, self.last[blocks - 1], -1)
        docs = reached + np.repeat(before - reached[first] + pairs[first, 0], count)
        return docs, self.rate(pairs[:, 1], lengths[docs])


def block_max_maxscore(lists: list[tuple[int, Postings]], lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k documents with the highest scores above 0, equal scores by number; lists are (weight, postings)."""
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: x[0] * x[1].top)
    bound = np.cumsum([w * p.top for w, p in lists]) if lists else np.zeros(0, np.int64)
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    lo, width = 0, FIRST_WINDOW
    while lo < len(lengths):
        skipped = int(np.searchsorted(bound, least, "right"))
        if skipped == len(lists):
            break
        hi = min(len(lengths), lo + width)
        width = min(2 * width, LAST_WINDOW)
        total = np.zeros(hi - lo, np.int64)
        for w, p in lists[skipped:]:
            b = np.arange(np.searchsorted(p.last, lo), min(len(p.last), np.searchsorted(p.last, hi - 1) + 1))
            if len(b):
                d, impact = p.decode(b, lengths)
                a, z = np.searchsorted(d, (lo, hi))
                total[d[a:z] - lo] += w * impact[a:z]
        found = np.flatnonzero(total)
        score = total[found]
        found = found + lo
        for j in range(skipped - 1, -1, -1):
            keep = score + bound[j] > least
            found, score = found[keep], score[keep]
            if not len(found):
                break
            w, p = lists[j]
            block = np.searchsorted(p.last, found)
            keep = score + w * p.most[block] + (bound[j - 1] if j else 0) > least
            found, score, block = found[keep], score[keep], block[keep]
            block = np.unique(block[block < len(p.last)])
            if len(block):
                d, impact = p.decode(block, lengths)
                at = np.minimum(np.searchsorted(d, found), len(d) - 1)
                score = score + np.where(d[at] == found, w * impact[at], 0)
        keep = score > least
        docs, scores = np.concatenate([docs, found[keep]]), np.concatenate([scores, score[keep]])
        order = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[order], scores[order]
        least = int(scores[-1]) if len(scores) == k else 0
        lo = hi
    return docs, scores


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of index with the highest scores above 0 for each of queries (item_id, text).

    N documents have a term, L terms in all, n in one document; a term in df
    documents weighs floor(1000 ln((2N+2) / (2df+1))), and tf occurrences of it
    add weight * (1000000000 tf div (1000 tf + 8m)), m = 25 + 75 n N div L,
    for each time the query has it.  Equal scores are ranked by doc_id, nulls
    last.  Equal queries (item_id and text) count once; a query without terms
    that the documents have gets no rows, nor does any on an empty index.
    Other columns are ignored.
    """
    totals = index.where("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = int(totals[0] or 0), int(totals[1] or 0)
    asked = written(query_terms(queries), "query-terms")
    names = sent_if_small(asked.select("term").distinct(), TERM_BYTES)
    hits, path = stored(index.drop("n_docs", "n_terms", "doc_ids", "lengths").where("term is not null").join(names, "term", "left_semi"), "query-postings")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = hits.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight"))
    batches = max(1, -(-asked.count() // BATCH_TERMS))
    batch = F.pmod(F.xxhash64("query"), F.lit(batches)).cast("int").alias("batch")
    weighed = written(asked.join(sent_if_small(weights, TERM_BYTES), "term").select(batch, "query", "item_id", "term", (F.col("times") * F.col("weight")).alias("weight")), "query-weights")
    packs = weighed.groupBy("batch", "query", "item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).groupBy("batch").agg(F.collect_list(F.struct("query", "item_id", "terms")).alias("queries"))
    documents = index.where("term is null").select("shard", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), "doc_ids", "lengths").join(packs, "batch")
    wanted = hits.join(sent_if_small(weighed.select("batch", "term").distinct(), TERM_BYTES), "term")
    parts = documents.unionByName(wanted, allowMissingColumns=True)

    def rank(key: tuple, rows: pa.Table) -> pa.Table:
        head = rows.filter(pa.compute.is_valid(rows.column("queries")))
        if not len(head):
            return FOUND.empty_table()
        array = lambda value: value.values.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths, ids = array(head.column("lengths")[0]), array(head.column("doc_ids")[0])
        rate = lambda tf, n: (1_000_000_000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))
        lists = {}
        rows = rows.filter(pa.compute.is_valid(rows.column("term"))).select(["term", "df", "last", "sizes", "fronts", "front", "postings"])
        for term, df, last, sizes, fronts, front, postings in zip(*(c for c in rows.columns), strict=True):
            lists[term.as_py()] = Postings(df.as_py(), array(last), array(sizes), array(fronts), array(front), np.frombuffer(postings.as_buffer(), np.uint8), rate)
        made = []
        for q in head.column("queries")[0].as_py():
            docs, scores = block_max_maxscore([(t["weight"], lists[t["term"]]) for t in q["terms"] if t["term"] in lists], lengths, k)
            made += [(q["query"], q["item_id"], None if i == NO_ID else i, s) for i, s in zip(ids[docs].tolist(), scores.tolist(), strict=True)]
        return pa.table([pa.array([r[i] for r in made], f.type) for i, f in enumerate(FOUND)], schema=FOUND)

    FOUND = pa.schema([("query", pa.string()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    found = written(parts.groupBy("shard", "batch").applyInArrow(rank, "query string, item_id bigint, doc_id bigint, score bigint"), "shard-heaps")
    dropped(index.sparkSession, path)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """search over an index of docs that is made for it; nulls, ties, repeated rows and empty tables as in build_index and search."""
    return search(written(build_index(docs), "lexical-index"), queries, k)
