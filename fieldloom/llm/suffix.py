"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def _eight(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(data), np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + len(data)]
    return key


def suffix_array(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions of data, sorted by the bytes from there to the end.

    The first sort is by 8 bytes; the end is less than any byte, a zero too.
    Then, as Larsson and Sadakane refine, only groups that are still equal are
    sorted again, by the rank of the position that lies h further, and h
    doubles.  With a depth it ends when depth bytes are told apart: suffixes
    that share them are side by side, in any order.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    key = _eight(data)
    order = np.argsort(key, kind="stable")
    # Of equal keys those that the end cuts short come first, the shortest before all.
    short = np.arange(max(0, n - 7), n)
    left = np.full(n, 8, np.int8)
    left[short] = n - short
    ties = np.flatnonzero(np.isin(key[order], key[short]))
    order[ties] = order[ties][np.lexsort((left[order[ties]], key[order[ties]]))]
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (left[order][1:] != left[order][:-1])
    h = 8
    while True:
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's number is its first place
        rank = np.empty(n + 1, np.int64)
        rank[order] = group
        rank[n] = -1
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at) or (depth and h >= depth):
            break
        pos = order[at]
        following = rank[np.minimum(pos + h, n)]
        both = (group[at].astype(np.uint64) << np.uint64(32)) | (following + 1).astype(np.uint64)
        inner = np.argsort(both, kind="stable")
        order[at] = pos[inner]
        both = both[inner]
        new[at[1:]] |= both[1:] != both[:-1]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int, lanes: int = 16) -> np.ndarray:
    """Length, up to cap, of what each suffix shares with the one before it in order; 0 for the first.

    Kasai's rule: in text order a suffix shares at least one less than the
    suffix one place before.  Texts are cut into runs of lanes places; all
    runs advance together, each from what its last place gave.  That rule
    needs the two suffixes in true order: where they share cap bytes, an order
    of bounded depth may have them either way, so what they give is compared.
    """
    n = len(data)
    eight = _eight(data)
    # Places of the eight bytes that together are cap - 1; a smaller cap has none and starts from nothing.
    steps = [*range(0, cap - 9, 8), cap - 9] if cap > 8 else []
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    padded = np.concatenate([data, np.zeros(cap + 1, np.uint8)])
    for lane in range(min(lanes, n)):
        at = np.arange(lane, n, lanes)
        other = before[at]
        have = np.maximum(shared[at - 1] - 1, 0) if lane else np.zeros(len(at), np.int64)
        have[other < 0] = 0
        unsure = np.flatnonzero((have >= cap - 1) & (other >= 0))
        a, b = at[unsure], other[unsure]
        same = np.maximum(a, b) + cap - 1 <= n if steps else np.zeros(len(unsure), bool)
        for k in steps:
            same &= eight[np.minimum(a + k, n - 1)] == eight[np.minimum(b + k, n - 1)]
        have[unsure[~same]] = 0
        live = np.flatnonzero(other >= 0)
        while len(live):
            a, b, k = at[live], other[live], have[live]
            more = (k < cap) & (np.maximum(a, b) + k < n) & (padded[np.minimum(a + k, n)] == padded[np.minimum(b + k, n)])
            live = live[more]
            have[live] += 1
        shared[at] = have
    out = np.zeros(n, np.int64)
    out[:] = shared[order]
    return out
