"""Suffix arrays over the words of one shard of texts, and searching them, with NumPy."""

from __future__ import annotations

import numpy as np


def with_stops(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence with a 0 after each row, place of each row's first word); word hashes of 0 become 1."""
    rows = len(counts)
    ends = np.cumsum(counts)
    starts = ends - counts + np.arange(rows)
    seq = np.zeros(len(words) + rows, dtype=np.uint64)
    keep = np.ones(len(seq), dtype=bool)
    keep[ends + np.arange(rows)] = False
    seq[keep] = np.maximum(words, np.uint64(1))
    return seq, starts


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` words at least (prefix doubling).

    Each round doubles the words compared and sorts only the suffixes that are still tied.
    """
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    if not n:
        return order
    ranked = seq[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # Suffixes that begin at a stop stand first and need no order among themselves.
    stops = int(np.searchsorted(ranked, np.uint64(0), side="right"))
    new[:stops] = True
    k = 1
    while k < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        suffix = order[at]
        behind = suffix + k
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], 0)
        key = (rank[suffix] << 32) | second
        by = np.argsort(key, kind="stable")
        order[at], key = suffix[by], key[by]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        new[at] = fresh
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        k *= 2
    return order


def search(seq: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of words in queries: the stretch of ``order`` whose suffixes begin with it (binary search)."""
    n, width = len(order), queries.shape[1]
    padded = np.concatenate([seq, np.zeros(width, dtype=np.uint64)])
    found = []
    for upper in (False, True):
        lo, hi = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), n, dtype=np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            at = order[mid]
            right = np.full(len(open_), upper)
            live = np.arange(len(open_))
            for j in range(width):
                there, wanted = padded[at[live] + j], queries[open_[live], j]
                right[live[there < wanted]] = True
                right[live[there > wanted]] = False
                live = live[there == wanted]
                if not len(live):
                    break
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        found.append(lo)
    return found[0], found[1]


def common_length(seq: np.ndarray, at: np.ndarray, other: np.ndarray, other_at: np.ndarray) -> np.ndarray:
    """How many words two sequences share from these places on; a stop (0) ends a match."""
    out = np.zeros(len(at), dtype=np.int64)
    live = np.flatnonzero((at < len(seq)) & (other_at < len(other)))
    while len(live):
        a, b = at[live] + out[live], other_at[live] + out[live]
        inside = (a < len(seq)) & (b < len(other))
        live, a, b = live[inside], a[inside], b[inside]
        same = (seq[a] == other[b]) & (seq[a] != 0)
        live = live[same]
        out[live] += 1
    return out
