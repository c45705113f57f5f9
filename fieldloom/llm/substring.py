"""Exact substring deduplication across documents, in bytes.

A byte is removed where a string of WINDOW bytes that covers it also starts in
a document with a smaller id.  The work is dealt out by sampled suffixes:

1. Documents are gathered into blocks of some MB.  In every window of WINDOW
   bytes the GRAM bytes with the least hash are its anchor, so equal windows
   have equal anchors; each block sends its sorted anchors to key ranges.
2. In a key range the blocks' sorted lists are merged by binary search;
   anchors that several documents have go back to their blocks.
3. Blocks send what lies around those anchors (all windows that the anchor
   stands for) to shards by the anchor.  In a shard, equal surroundings take
   the least document id; where an anchor has differing ones, a suffix array
   (Larsson-Sadakane) of them with common prefixes (Kasai) finds the equal
   windows.  Anchors of very many documents go window by window instead: a
   block sends each window's digest once, so no shard must hold them.
4. Blocks join the found spans and cut their texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD, dropped, free_name, scratch_path, sent_if_small, stored, written
from fieldloom.llm.suffix import common_prefixes, suffix_array
from fieldloom.llm.textnum import U, mix, powers, slices, text_buffers

WINDOW, GRAM = 50, 16
BLOCK_BYTES = 4 << 20
#: An anchor that this many documents have goes window by window.
HOT_DOCS = 5_000
#: Key ranges and shards are counted for about this much text in each.
RANGE_BYTES, SHARD_BYTES = 16 << 20, 4 << 20
#: Windows of hot anchors are dealt to parts for about this much text in each.
WINDOWS_BYTES = 64 << 20
#: A suffix array covers about this much of a shard; surroundings of one anchor stay together.
SORTED_BYTES = 512 << 10
#: Bytes of a text's key with an id in a table that is sent whole.
KEY_BYTES = 64
NO_ID = np.iinfo(np.int64).max
_MULT = 0xF1357AEA2E62A9C5 | 1
_WHERE = U(0xFFFFFF)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor hash, first window, windows) of the anchors of texts side by side; windows are counted in bytes from data's start.

    An anchor stands for the run of windows in which it has the least hash.
    """
    n, reach = len(data), WINDOW - GRAM
    lengths = np.diff(offsets)
    if n < WINDOW:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, U), z, z
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(n, _MULT), out=sums[1:])
    m = n - GRAM + 1
    gram = mix((sums[GRAM:] - sums[:m]) * powers(m, pow(_MULT, -1, 1 << 64)))
    parts = []
    # The place in the low 24 bits: texts beyond 16 MB are taken in overlapping stretches.
    step = 1 << 23
    for a in range(0, m - reach, step):
        own = gram[a : a + step + reach]
        key = (own & ~_WHERE) | np.arange(len(own), dtype=U)
        span, least = 1, key
        while span * 2 <= reach + 1:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        rest = reach + 1 - span
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        parts.append((least & _WHERE).astype(np.int64)[:step] + a)
    at = np.concatenate(parts)  # of each window of n - WINDOW + 1
    count = np.maximum(0, lengths - WINDOW + 1)
    row = np.repeat(np.arange(len(lengths)), count)
    window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][row]
    at = at[window]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(first)
    return row[start], mix(gram[at[start]] + U(1)), window[start], np.diff(np.append(start, len(at)))


def _block_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchors() of a block, slice by slice."""
    found = []
    for a, _, part, edges in slices(data, offsets):
        row, key, first, n = anchors(part, edges)
        found.append((row + a, key, first + offsets[a], n))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))


def shard_spans(doc: np.ndarray, key: np.ndarray, count: np.ndarray, around: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first, end): bytes to remove of each entry's surroundings, counted from its first window.

    An entry is an anchor in a document, with the count windows that it stands
    for: around holds count + WINDOW - 1 bytes.
    """
    ident, rep, back = {}, [], np.empty(len(around), np.int64)
    for i, x in enumerate(around):
        back[i] = ident.setdefault(x, len(rep))
        if back[i] == len(rep):
            rep.append(i)
    rep = np.array(rep, np.int64)
    least = np.full(len(rep), NO_ID)
    np.minimum.at(least, back, doc)
    whole = np.flatnonzero(doc > least[back])
    out = [(whole, np.zeros(len(whole), np.int64), count[whole] + WINDOW - 1)]
    # Anchors with several surroundings: which of their windows are equal?
    keys, n_around = np.unique(key[rep], return_counts=True)
    mixed = np.flatnonzero(n_around[np.searchsorted(keys, key[rep])] > 1)
    mixed = mixed[np.argsort(key[rep[mixed]], kind="stable")]
    kept = np.flatnonzero(doc == least[back])
    entries = kept[np.argsort(back[kept], kind="stable")]
    owners = back[entries]
    # Cut at anchors, so that an array stays in the cache and windows meet all that can equal them.
    size = count[rep[mixed]] + WINDOW - 1
    first = np.ones(len(mixed), bool)
    first[1:] = key[rep[mixed]][1:] != key[rep[mixed]][:-1]
    piece = (np.cumsum(size) - size)[first] // SORTED_BYTES
    edges = np.append(np.flatnonzero(first)[np.concatenate([[True], piece[1:] != piece[:-1]])], len(mixed)) if len(mixed) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = mixed[a:b]
        of, up, down = _equal_windows([around[rep[u]] for u in own], count[rep[own]], least[own])
        lo, hi = np.searchsorted(owners, own[of], "left"), np.searchsorted(owners, own[of], "right")
        n = hi - lo
        pick = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append((entries[pick], np.repeat(up, n), np.repeat(down + WINDOW - 1, n)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _equal_windows(texts: list[bytes], count: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, end) of runs of windows that equal one of a text with a smaller least; the first count places of a text are windows."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    order = suffix_array(data, WINDOW)
    shared = common_prefixes(data, order, WINDOW)
    group = np.cumsum(shared < WINDOW) - 1
    owner = np.repeat(np.arange(len(texts)), size)
    valid = np.arange(len(data)) - begin[owner] < count[owner]
    ids = np.where(valid, least[owner], NO_ID)
    low = np.full(group[-1] + 1, NO_ID)
    np.minimum.at(low, group, ids[order])
    hit = np.zeros(len(data), bool)
    hit[order] = low[group] < ids[order]
    hit &= valid  # the last WINDOW - 1 places of a text never are, so no run crosses texts
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    up, down = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return owner[up], up - begin[owner[up]], down - begin[owner[up]]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _gather(docs: DataFrame) -> DataFrame:
    """Blocks: block, rids, ids, sizes and the texts' bytes side by side."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def one():
            rids, ids, texts = zip(*held, strict=True)
            return pa.RecordBatch.from_pylist([{"block": number, "rids": rids, "ids": ids, "sizes": [len(t) for t in texts], "data": b"".join(texts)}], schema)

        schema = pa.schema([("block", pa.int64()), ("rids", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, (rid, doc) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("order_id").to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                if held and size + len(text) > BLOCK_BYTES:
                    yield one()
                    held, size, number = [], 0, number + 1
                held.append((rid, doc, text))
                size += len(text)
        if held:
            yield one()

    return docs.select("rid", "order_id", "text").mapInArrow(blocks, "block bigint, rids array<bigint>, ids array<bigint>, sizes array<bigint>, data binary")


def _bucketed(df: DataFrame, n: int) -> DataFrame:
    """df as a table of n buckets by block in the shared folder: joins with answers in as many partitions don't move it."""
    name = f"text_blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(n, "block").option("path", scratch_path(df.sparkSession, "blocks")).option("compression", "zstd").saveAsTable(name)
    table = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # from the catalogue; its files stay until the driver ends
    return table


def _answered(blocks: DataFrame, n: int, answers: DataFrame, how: str, **lists: Column) -> DataFrame:
    """blocks with the lists gathered from answers by block."""
    gathered = answers.repartition(n, "block").groupBy("block").agg(*[F.collect_list(c).alias(k) for k, c in lists.items()])
    return blocks.join(gathered.hint("shuffle_hash"), "block", how)


def _arrays(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rids, ids, sizes = (np.asarray(batch.column(c)[i].values) for c in ("rids", "ids", "sizes"))
    data = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8)
    return rids, ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), data


def _ranged(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> U(40)) * U(n) >> U(24)).astype(np.int64)


def _send_anchors(blocks: DataFrame, n_ranges: int) -> DataFrame:
    """For each range and block: the block's distinct anchors in order, and for those of several documents (place, count) pairs."""

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, offsets, data = _arrays(batch, i)
                row, key, _, _ = _block_anchors(data, offsets)
                # Each document counts once for an anchor.
                key = key >> U(8) & U((1 << 40) - 1)
                order = np.lexsort((ids[row], key))
                key, own = key[order], ids[row][order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
                key, n = np.unique(key[new], return_counts=True)
                # Keys are in order, so their ranges are too: only those that the block has are visited.
                own_ranges, begin = np.unique((key * U(n_ranges) >> U(40)).astype(np.int64), return_index=True)
                rows = [(int(r), slice(a, b)) for r, a, b in zip(own_ranges, begin, np.append(begin, len(key))[1:], strict=True)]
                several = [np.flatnonzero(n[part] > 1) for _, part in rows]
                counts = [np.stack([at, np.minimum(n[part][at], 2**32 - 1)], axis=1).astype("<u4").tobytes() for at, (_, part) in zip(several, rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([batch.column("block")[i].as_py()] * len(rows), pa.int64()), pa.array([_packed(key[part]) for _, part in rows], pa.binary()), pa.array(counts, pa.binary())], names=["range", "block", "keys", "counts"])

    return blocks.mapInArrow(send, "range int, block bigint, keys binary, counts binary")


def _packed(key: np.ndarray) -> bytes:
    """40-bit numbers as 5 bytes each."""
    return np.ascontiguousarray(key, "<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _forty(blob: bytes) -> np.ndarray:
    """40-bit numbers from 5 bytes each."""
    raw = np.zeros((len(blob) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return raw.view("<u8").ravel()


def _shared_anchors(sent: DataFrame, hot: int) -> DataFrame:
    """For each range and block: its anchors that several documents have, and those that very many have."""

    def meet(table: pa.Table) -> pa.Table:
        lists = [_forty(x.as_py()) for x in table.column("keys")]
        counts = []
        for own, blob in zip(lists, table.column("counts"), strict=True):
            n = np.ones(len(own), np.int64)
            pairs = np.frombuffer(blob.as_buffer(), "<u4").reshape(-1, 2)
            n[pairs[:, 0]] = pairs[:, 1]
            counts.append(n)
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        every = every[order]
        start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        n = np.add.reduceat(np.concatenate(counts)[order], start) if len(every) else np.zeros(0, np.int64)
        distinct = every[start]
        several, many = distinct[(n > 1) & (n < hot)], distinct[n >= hot]
        back = []
        for own in lists:
            # Binary search of the block's sorted anchors in the merged ones.
            both = []
            for found in (several, many):
                at = np.searchsorted(found, own)
                ok = at < len(found)
                ok[ok] = found[at[ok]] == own[ok]
                both.append(_packed(own[ok]))
            back.append(both)
        return pa.table([table.column("block"), pa.array([b[0] for b in back], pa.binary()), pa.array([b[1] for b in back], pa.binary())], names=["block", "several", "many"])

    return sent.groupBy("range").applyInArrow(meet, "block bigint, several binary, many binary").where((F.length("several") > 0) | (F.length("many") > 0))


def _surroundings(blocks: DataFrame, n_buckets: int, shared: DataFrame, n_shards: int) -> DataFrame:
    """What lies around shared anchors, one row for each block and shard; part tells shard, windows (hot anchors) and spans (settled in the block)."""
    joined = _answered(blocks, n_buckets, shared, "inner", several=F.col("several"), many=F.col("many"))

    def around(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rids, ids, offsets, data = _arrays(batch, i)
                row, key, first, count = _block_anchors(data, offsets)
                short = (key >> U(8)) & U((1 << 40) - 1)
                block = batch.column("block")[i].as_py()
                raw = data.tobytes()
                for kind, name in (("shard", "several"), ("windows", "many")):
                    wanted = np.sort(np.concatenate([np.zeros(0, "<u8"), *[_forty(x.as_py()) for x in batch.column(name)[i].values]]))
                    at = np.searchsorted(wanted, short)
                    ok = at < len(wanted)
                    ok[ok] = wanted[at[ok]] == short[ok]
                    pick = np.flatnonzero(ok)
                    if not len(pick):
                        continue
                    # Equal surroundings in the block: only those of its least document go on, larger ones are removed whole.
                    ident: dict[bytes, int] = {}
                    back = np.array([ident.setdefault(raw[f : f + c + WINDOW - 1], len(ident)) for f, c in zip(first[pick].tolist(), count[pick].tolist(), strict=True)])
                    least = np.full(len(ident), NO_ID)
                    np.minimum.at(least, back, ids[row[pick]])
                    later = pick[ids[row[pick]] > least[back]]
                    if len(later):
                        begin = first[later] - offsets[row[later]]
                        done = {"part": "spans", "shard": 0, "block": block, "keys": b"", "rows": row[later], "ids": [], "firsts": begin, "counts": begin + count[later] + WINDOW - 1, "around": b""}
                        yield pa.RecordBatch.from_pylist([done], AROUND)
                    pick = pick[ids[row[pick]] == least[back]]
                    # Hot anchors stay in one row, since their windows are dealt out one by one.
                    shard = _ranged(mix(key[pick]), n_shards) if kind == "shard" else np.zeros(len(pick), np.int64)
                    order = np.argsort(shard, kind="stable")
                    pick, shard = pick[order], shard[order]
                    cut = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
                    rows = []
                    for a, b in zip(cut[:-1], cut[1:], strict=True):
                        p = pick[a:b]
                        rows.append({
                            "part": kind, "shard": int(shard[a]), "block": block, "keys": key[p].astype("<u8").tobytes(), "rows": row[p], "ids": ids[row[p]],
                            "firsts": first[p] - offsets[row[p]], "counts": count[p], "around": b"".join(raw[f : f + c + WINDOW - 1] for f, c in zip(first[p].tolist(), count[p].tolist(), strict=True)),
                        })
                    yield pa.RecordBatch.from_pylist(rows, AROUND)

    return joined.mapInArrow(around, AROUND_DDL)


AROUND = pa.schema([("part", pa.string()), ("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("around", pa.binary())])
AROUND_DDL = "part string, shard bigint, block bigint, keys binary, rows array<bigint>, ids array<bigint>, firsts array<bigint>, counts array<bigint>, around binary"
SPANS_DDL = "block bigint, rows array<bigint>, starts array<bigint>, ends array<bigint>"


def _in_shards(around: DataFrame) -> DataFrame:
    def spans(table: pa.Table) -> pa.Table:
        flat = lambda c: np.concatenate([np.asarray(x.values) for x in table.column(c)])
        sizes = [len(x.values) for x in table.column("ids")]
        count, first, row = flat("counts"), flat("firsts"), flat("rows")
        key = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in table.column("keys")])
        texts, at = [], 0
        for x, n in zip(table.column("around"), sizes, strict=True):
            raw, b = x.as_py(), 0
            for c in count[at : at + n].tolist():
                texts.append(raw[b : b + c + WINDOW - 1])
                b += c + WINDOW - 1
            at += n
        entry, begin, end = shard_spans(flat("ids"), key, count, texts)
        source = np.repeat(np.arange(len(sizes)), sizes)[entry]
        order = np.argsort(source, kind="stable")
        entry, begin, end, source = entry[order], begin[order], end[order], source[order]
        cut = np.searchsorted(source, np.arange(len(sizes) + 1))
        pieces = [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table([table.column("block"), *[pa.array([x[p] for p in pieces], pa.list_(pa.int64())) for x in (row[entry], first[entry] + begin, first[entry] + end)]], names=["block", "rows", "starts", "ends"])

    return around.groupBy("shard").applyInArrow(spans, SPANS_DDL).where(F.size("rows") > 0)


def _occurrences(batch: pa.RecordBatch, i: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows of a block's hot surroundings and the least document of each; and the windows' places: which window, row, document, begin."""
    rows, ids, firsts, counts = (np.asarray(batch.column(c)[i].values) for c in ("rows", "ids", "firsts", "counts"))
    raw = batch.column("around")[i].as_py()
    own = np.repeat(np.arange(len(rows)), counts)
    step = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.repeat(np.cumsum(counts + WINDOW - 1) - counts - WINDOW + 1, counts) + step
    ident: dict[bytes, int] = {}
    back = np.array([ident.setdefault(raw[p : p + WINDOW], len(ident)) for p in begin.tolist()], np.int64)
    least = np.full(len(ident), NO_ID)
    np.minimum.at(least, back, ids[own])
    return list(ident), least, back, rows[own], ids[own], firsts[own] + step


def _dealt(windows: list[bytes], n_parts: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Two numbers of each window's MD5, and for each part that has some of the windows, which."""
    key = np.frombuffer(b"".join(hashlib.md5(w, usedforsecurity=False).digest() for w in windows), "<u8").reshape(-1, 2)
    part = _ranged(key[:, 0], n_parts)
    order = np.argsort(part, kind="stable")
    own, begin = np.unique(part[order], return_index=True)
    return key, [(int(p), order[a:b]) for p, a, b in zip(own, begin, np.append(begin, len(order))[1:], strict=True)]


def _by_window(around: DataFrame, n_parts: int) -> DataFrame:
    """Spans of hot anchors: a block sends each of its windows once, with its least document, and hears which have a smaller one elsewhere."""

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                windows, least, *_ = _occurrences(batch, i)
                key, parts = _dealt(windows, n_parts)
                block = batch.column("block")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array([key[at].tobytes() for _, at in parts], pa.binary()), pa.array([least[at].astype("<i8").tobytes() for _, at in parts], pa.binary())], names=["share", "block", "keys", "least"])

    def meet(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x.as_buffer(), "<i8") for x in table.column("least")]
        key = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in table.column("keys")]).reshape(-1, 2)
        least = np.concatenate(lists)
        order = np.lexsort((key[:, 1], key[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]).any(axis=1)
        start = np.flatnonzero(new)
        low = np.empty(len(order), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(least[order], start), np.diff(np.append(start, len(order))))
        hits = np.split(low < least, np.cumsum([len(x) for x in lists])[:-1])
        return pa.table([table.column("block"), table.column("share"), pa.array([np.flatnonzero(h).astype("<u4").tobytes() for h in hits], pa.binary())], names=["block", "share", "hits"])

    def spans(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                windows, least, back, row, doc, begin = _occurrences(batch, i)
                lost = np.zeros(len(windows), bool)
                parts = dict(_dealt(windows, n_parts)[1])
                for x in batch.column("answers")[i].as_py() or ():
                    lost[parts[x["share"]][np.frombuffer(x["hits"], "<u4")]] = True
                at = np.flatnonzero(lost[back] | (doc > least[back]))
                if not len(at):
                    continue
                # Neighbouring windows of one row are one span.
                row, begin = row[at], begin[at]
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (begin[1:] != begin[:-1] + 1)
                first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at)) - 1
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("block")[i].as_py()], pa.int64()), *[pa.array([x], pa.list_(pa.int64())) for x in (row[first], begin[first], begin[last] + WINDOW)]], names=["block", "rows", "starts", "ends"])

    hot = around.select("block", "rows", "ids", "firsts", "counts", "around")
    answers = hot.mapInArrow(send, "share bigint, block bigint, keys binary, least binary").groupBy("share").applyInArrow(meet, "block bigint, share bigint, hits binary").where(F.length("hits") > 0)
    answered = hot.join(answers.groupBy("block").agg(F.collect_list(F.struct("share", "hits")).alias("answers")), "block", "left")
    return answered.mapInArrow(spans, SPANS_DDL)


#: Name of the row numbers in the tables of this module's own.
ROW_ID = "substring_row"


def removed_spans(docs: DataFrame, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(all rows, marked where they copy a smaller document; the cut texts of the others); docs has ROW_ID, doc_id and text."""
    hot = hot or HOT_DOCS
    keyed = docs.select(F.col(ROW_ID).alias("rid"), F.coalesce("doc_id", F.lit(int(NO_ID))).alias("order_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    copies = written(keyed.groupBy("key").agg(F.min("order_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("key", "original"), "text-copies")
    keyed = keyed.join(sent_if_small(copies, KEY_BYTES), "key", "left").withColumn("copy", F.coalesce(F.col("original") < F.col("order_id"), F.lit(False)))
    first = keyed.where(~F.col("copy"))
    total = first.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = -(-total // BLOCK_BYTES)
    n_buckets = max(8, min(100_000, -(-n_blocks // 4)))
    blocks = _bucketed(_gather(first), n_buckets)
    spark = docs.sparkSession
    shared, shared_path = stored(_shared_anchors(_send_anchors(blocks, max(4, -(-total // RANGE_BYTES))), hot), "shared-anchors")
    around, around_path = stored(_surroundings(blocks, n_buckets, shared, max(8, -(-total // SHARD_BYTES))), "surroundings")
    dropped(spark, shared_path)
    settled = around.where("part = 'spans'").select("block", "rows", F.col("firsts").alias("starts"), F.col("counts").alias("ends"))
    spans = written(_in_shards(around.where("part = 'shard'")).union(_by_window(around.where("part = 'windows'"), max(8, -(-total // WINDOWS_BYTES)))).union(settled), "spans")
    dropped(spark, around_path)
    joined = _answered(blocks, n_buckets, spans, "left", found=F.struct("rows", "starts", "ends"))

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rids, ids, offsets, data = _arrays(batch, i)
                mine: dict[int, list[tuple[int, int]]] = {}
                found = batch.column("found")[i]
                for part in found.as_py() or ():
                    for r, a, b in zip(part["rows"], part["starts"], part["ends"], strict=True):
                        mine.setdefault(r, []).append((a, b))
                rows = []
                for r, rid in enumerate(rids.tolist()):
                    text = data[offsets[r] : offsets[r + 1]].tobytes()
                    merged = merge_spans(mine[r]) if r in mine else []
                    kept, at = [], 0
                    for a, b in merged:
                        kept.append(text[at:a])
                        at = b
                    rest = b"".join([*kept, text[at:]])
                    rows.append({"rid": rid, "doc_id": None if ids[r] == NO_ID else int(ids[r]), "n_bytes": len(text), "starts": [a for a, _ in merged], "ends": [b for _, b in merged], "kept_sha256": hashlib.sha256(rest).hexdigest(), "kept": rest})
                yield pa.RecordBatch.from_pylist(rows, CUT)

    return keyed, joined.select("block", "rids", "sizes", "ids", "data", "found").mapInArrow(cut, CUT_DDL)


CUT = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_sha256", pa.string()), ("kept", pa.binary())])
CUT_DDL = "rid bigint, doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept_sha256 string, kept binary"


def _cut_rows(docs: DataFrame, hot: int | None) -> DataFrame:
    """rid and the columns of deduplicate_substrings for each row of docs (ROW_ID, doc_id, text)."""
    keyed, cut = removed_spans(docs, hot)
    size = F.octet_length("text").cast("long")
    gone = size >= WINDOW
    none = F.array().cast("array<bigint>")
    copies = keyed.where("copy").select(
        "rid", F.nullif("order_id", F.lit(int(NO_ID))).alias("doc_id"), size.alias("n_bytes"), F.when(gone, F.array(F.lit(0).cast("long"))).otherwise(none).alias("starts"), F.when(gone, F.array(size)).otherwise(none).alias("ends"),
        F.sha2(F.when(gone, "").otherwise(F.col("text")).cast("binary"), 256).alias("kept_sha256"), F.when(gone, "").otherwise(F.col("text")).cast("binary").alias("kept"),
    )
    return cut.union(copies)


def deduplicate_substrings(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, starts, ends (of maximal removed runs), kept (the bytes left) and kept_sha256 of each row.

    docs has doc_id and text; other columns are ignored.  A null text is an
    empty one; zero characters are bytes like others.  A null doc_id is larger
    than all others, and none is smaller than itself: rows that share an id
    don't affect each other.  Matches never cross documents, and are judged on
    the texts as they came.  A text that equals one with a smaller id is
    removed whole if it has 50 bytes, and its work is skipped.  An empty table
    gives no rows.
    """
    return _cut_rows(docs.select("doc_id", "text", F.monotonically_increasing_id().alias(ROW_ID)), hot).drop("rid")


def remove_repeats(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """docs without the bytes that deduplicate_substrings removes; all columns are kept.

    Bytes of a character that was cut in two go with it.  Rows whose words
    are all removed go; n_chars, if there, is the new text's.  Null texts,
    null ids, repeated rows and empty tables are as there: a null or empty
    text loses nothing and stays, a null one as an empty text.
    """
    row, n_cut = free_name(docs, ROW_ID), free_name(docs, "n_cut")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "texts")
    cut = _cut_rows(numbered.select(F.col(row).alias(ROW_ID), "doc_id", "text"), hot)
    whole = F.size("starts") == 0
    text = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\uFFFD", "")
    cut = cut.select(F.col("rid").alias(row), F.size("starts").alias(n_cut), F.when(whole, F.col("kept").cast("string")).otherwise(text).alias("text"))
    joined = numbered.drop("text").join(cut, row)
    joined = joined.where((F.col(n_cut) == 0) | F.regexp_like("text", F.lit(WORD)))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)
