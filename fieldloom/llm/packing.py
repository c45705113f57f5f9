"""Best-fit packing of token pieces, improved by swap-based local search.

Documents become token ids; longer ones are cut into full pieces, the first
of which may be shorter.  Pieces are dealt evenly into groups of bounded size;
each group is packed best-fit, longest first, and its underfull bins are then
improved: pieces move, or are exchanged one for one or two for one, where
that raises the sum of squared fills, until bins are empty or nothing helps.
"""

from __future__ import annotations

import itertools
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import written
from fieldloom.llm.textnum import U, _MULT, mix, powers, slices, text_buffers

SEQUENCE, END_ID = 1024, 2
#: Pieces of a group: one task packs them; a group wastes less than one sequence or so.
GROUP_PIECES = 50_000
#: Most words whose ids a worker remembers: some 40 bytes each.
CACHE_WORDS = 400_000
#: Bytes of text that are split and looked up at once: its arrays stay in a core's cache.
LOOKUP_BYTES = 1 << 18
#: Code points up to here are split by table; texts with others go to the tokenizer whole.
TABLE_POINTS = 0x0590


# ---------------------------------------------------------------- tokens


class WordTokenizer:
    """Ids of whole texts from a byte-level BPE file, word by word with a memory.

    The tokenizer splits a text into words before it merges bytes, and words
    don't affect each other; so each distinct word is encoded once, by the
    tokenizer itself.  The split is done here on arrays: character classes
    come from the tokenizer's own splits of single characters.  Texts with
    code points beyond the table, or with special tokens, are encoded whole.
    """

    def __init__(self, path: str):
        # Tasks share the cores already; more threads would only take memory for each of their heaps.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        pre = self.tok.pre_tokenizer
        joins = lambda a, b: len(pre.pre_tokenize_str(a + b)) == 1
        kinds = np.zeros(TABLE_POINTS, np.uint8)  # 0 other, 1 letter, 2 number, 3 space
        for c in range(TABLE_POINTS):
            x = chr(c)
            kinds[c] = 1 if joins("a", x) else 2 if joins("1", x) else 0 if joins("!", x) else 3
        self.kinds = kinds
        self.keys = np.zeros(0, U)
        self.starts = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(byte starts of words, kept words' mark, rows that need the tokenizer) for texts side by side."""
        n = len(data)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        b = data[at].astype(np.int32)
        nxt = np.where(at + 1 < n, data[np.minimum(at + 1, n - 1)], 0).astype(np.int32)
        point = np.where(b < 0x80, b, np.where(b < 0xE0, ((b & 0x1F) << 6) | (nxt & 0x3F), TABLE_POINTS))
        far = point >= TABLE_POINTS
        kind = self.kinds[np.minimum(point, TABLE_POINTS - 1)]
        kind[far] = 0
        row_first = np.zeros(len(at) + 1, bool)
        edge = np.searchsorted(at, offsets)
        row_first[edge] = True
        row_first = row_first[:-1] if len(at) else row_first[:0]
        m = len(at)
        before = np.empty(m, np.uint8)
        before[0:1] = 9
        before[1:] = kind[:-1]
        change = (kind != before) | row_first
        # In a run of spaces that another character of the text follows, the last one stands apart.
        following = np.empty(m, np.uint8)
        following[-1:] = 9
        following[:-1] = kind[1:]
        text_last = np.ones(m, bool)
        text_last[:-1] = row_first[1:]
        tail = (kind == 3) & (following != 3) & ~text_last
        start = change | tail
        # A plain blank there joins what follows.
        glue = tail & (point == 32)
        start[1:] &= ~glue[:-1]
        # An apostrophe that begins a word may begin a contraction.
        quote = np.flatnonzero((point == 39) & start)
        if len(quote):
            one, two = np.full(len(quote), -1), np.full(len(quote), -1)
            ok = (quote + 1 < m) & ~row_first[np.minimum(quote + 1, m - 1)]
            one[ok] = point[np.minimum(quote + 1, m - 1)][ok]
            ok2 = ok & (quote + 2 < m) & ~row_first[np.minimum(quote + 2, m - 1)]
            two[ok2] = point[np.minimum(quote + 2, m - 1)][ok2]
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for hit, reach in ((single, 2), (double, 3)):
                q = quote[hit]
                start[q + 1] = False
                q = q[q + reach < m]
                start[q + reach] = True
        rows_far = np.zeros(len(offsets) - 1, bool)
        if far.any():
            rows_far[np.unique(np.searchsorted(edge, np.flatnonzero(far), "right") - 1)] = True
        return at[start], rows_far, edge

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text."""
        n_rows = len(offsets) - 1
        if not len(data):
            return [np.zeros(0, np.uint32)] * n_rows
        raw = data.tobytes()
        starts, whole, _ = self.words(data, offsets)
        if any(s in raw for s in self.special):
            for r in range(n_rows):
                whole[r] |= any(s in raw[offsets[r] : offsets[r + 1]] for s in self.special)
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(offsets, starts, "right") - 1
        if whole.any():
            keep = ~whole[row]
            starts, ends, row = starts[keep], ends[keep], row[keep]
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(len(data)), out=sums[1:])
        inverse = pow(_MULT, -1, 1 << 64)
        key = mix(((sums[ends] - sums[starts]) * powers(len(data), inverse)[starts]) ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            texts = [raw[starts[i] : ends[i]].decode() for i in first[new]]
            found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            self._learn(distinct[new], found)
            place = np.searchsorted(self.keys, distinct)
        begin, length = self.starts[place][back].astype(np.int64), self.lengths[place][back].astype(np.int64)
        upto = np.cumsum(length)
        total = int(upto[-1]) if len(upto) else 0
        flat = self.ids[np.repeat(begin - (upto - length), length) + np.arange(total)]
        edges = np.searchsorted(row, np.arange(n_rows + 1))
        cut = np.concatenate([[0], upto])[edges]
        out = [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for r in np.flatnonzero(whole):
            out[r] = np.array(self.tok.encode(raw[offsets[r] : offsets[r + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        if len(self.keys) > CACHE_WORDS:
            self.keys, self.starts, self.lengths, self.ids = self.keys[:0], self.starts[:0], self.lengths[:0], self.ids[:0]
        return out

    def _learn(self, keys: np.ndarray, found: list[list[int]]) -> None:
        """Adds sorted new keys where they belong among the known ones."""
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        starts = (np.cumsum(lengths, dtype=np.int64) - lengths + len(self.ids)).astype(np.int32)
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum()))])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.lengths = np.insert(self.keys, place, keys), np.insert(self.starts, place, starts), np.insert(self.lengths, place, lengths)


def piece_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for a shorter first."""
    first = n % size or min(n, size)
    return [(0, first)] + [(a, size) for a in range(first, n, size)]


def token_pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of docs' whole texts.

    A document is its text's ids, then end_id; a null text is an empty one and
    so one piece of one id.  Only documents over size ids are cut.  Repeated
    rows have pieces of their own.
    """
    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Made for each task (a fifth of a second): workers live on, and would keep it through every later stage.
        tok, end = WordTokenizer(path), np.array([end_id], np.uint32)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, offsets = text_buffers(batch.column(1))
            for a, _, part, edges in slices(data, offsets, LOOKUP_BYTES):
                rows = []
                for doc, ids in zip(doc_ids[a:], tok.encode(part, edges), strict=False):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    for k, (start, n) in enumerate(piece_bounds(len(ids), size)):
                        own = ids[start : start + n]
                        rows.append((doc, k, start, n, zlib.crc32(own.tobytes()), *([own.astype(np.int32).tolist()] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        tok = batch = data = offsets = part = None
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(cut, ddl)


# ---------------------------------------------------------------- packing


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins (indexes of pieces), longest piece first, each into the fullest bin that it fits."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set where a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            room = need + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            room -= need
        else:
            b, room = len(bins), size - need
            bins.append([i])
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Empties bins by moving and exchanging pieces of underfull ones.

    The bin with the least in it gives: each of its pieces moves to the
    fullest bin with room, or is exchanged for a smaller piece (one for one),
    or for a pair of fuller use (two for one), of a fuller bin.  Each step
    fills the fuller bin further, so the sum of squared fills grows and the
    search ends; it also ends at the least number of bins that the total needs.
    """
    full, open_ = [], []
    for b in bins:
        (full if sum(int(lengths[i]) for i in b) == size else open_).append(list(b))
    fill = [sum(int(lengths[i]) for i in b) for b in open_]
    least = -(-sum(fill) // size)
    closed: set[int] = set()  # bins that nothing could empty
    alive = {k for k in range(len(open_)) if fill[k]}
    holders: dict[int, set[int]] = defaultdict(set)
    for k, b in enumerate(open_):
        for i in b:
            holders[int(lengths[i])].add(k)
    order = sorted((fill[k], k) for k in alive)

    def put(k: int, out: list[int], into: list[int]) -> None:
        order.pop(bisect_left(order, (fill[k], k)))
        for i in out:
            open_[k].remove(i)
            n = int(lengths[i])
            if not any(int(lengths[j]) == n for j in open_[k]):
                holders[n].discard(k)
            fill[k] -= n
        for i in into:
            open_[k].append(i)
            holders[int(lengths[i])].add(k)
            fill[k] += int(lengths[i])
        if open_[k]:
            insort(order, (fill[k], k))
        else:
            alive.discard(k)

    def step(give: int) -> bool:
        for i in sorted(open_[give], key=lambda i: -int(lengths[i])):
            n = int(lengths[i])
            # Move: the fullest other bin that has room.
            at = bisect_left(order, (size - n + 1, -1)) - 1
            while at >= 0 and order[at][1] == give:
                at -= 1
            if at >= 0 and order[at][0] >= fill[give] - n:
                take = order[at][1]
                put(give, [i], [])
                put(take, [], [i])
                return True
        for i in sorted(open_[give], key=lambda i: -int(lengths[i])):
            n = int(lengths[i])
            # One for one: a smaller piece of a fuller bin, where the difference fits.
            for small in range(n - 1, 0, -1):
                for take in holders.get(small, ()):
                    if take != give and take in alive and fill[take] >= fill[give] and fill[take] + n - small <= size:
                        j = next(j for j in open_[take] if int(lengths[j]) == small)
                        put(take, [j], [i])
                        put(give, [i], [j])
                        return True
        own = sorted(open_[give], key=lambda i: int(lengths[i]))
        # Two for one: two pieces of the giver for one of a fuller bin that is smaller than both together.
        for x in range(len(own) - 1):
            i, j = own[x], own[x + 1]
            both = int(lengths[i]) + int(lengths[j])
            for one in range(both - 1, max(0, both - size), -1):
                for take in holders.get(one, ()):
                    if take != give and take in alive and fill[take] >= fill[give] and fill[take] + both - one <= size:
                        k = next(k for k in open_[take] if int(lengths[k]) == one)
                        put(take, [k], [i, j])
                        put(give, [i, j], [k])
                        return True
        return False

    while len(alive) > least:
        give = next((k for _, k in order if k not in closed), None)
        if give is None:
            break
        if not step(give):
            closed.add(give)
    return full + [open_[k] for k in sorted(alive)]


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """pieces (with length, 1 to size, and any other columns) with sequence_id and offset.

    A sequence holds at most size tokens; offsets run from 0 without gaps.
    Groups are partitions dealt round-robin, so neither a hot source nor a
    repeated document makes a large group.  An empty table gives no rows.
    """
    pieces = written(pieces, "token-pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        group = pa.Table.from_batches(held)
        part = group.column("group")[0].as_py()
        lengths = group.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(local_search(best_fit(lengths, size), lengths, size)):
            at = 0
            for i in b:
                sequence[i], offset[i] = (part << 32) + k, at
                at += int(lengths[i])
        group = group.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from group.to_batches(max_chunksize=20_000)

    return pieces.repartition(groups).withColumn("group", F.spark_partition_id().cast("long")).mapInArrow(pack, out)


def pack_documents(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text; other columns are ignored), packed into sequences; see token_pieces and pack_pieces."""
    return pack_pieces(token_pieces(docs, path, size, end_id, with_ids), size)
