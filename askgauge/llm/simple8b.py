"""Simple-8b: word-aligned integer coding with escapes and per-block offsets, vectorised with NumPy.

A 64-bit word holds a selector in its top four bits and, below it, as many values as the selector says,
the first one lowest. Selector 0 is the escape: the next word is one raw 64-bit value. Values are coded in
blocks of BLOCK values that start on a word of their own, so a block can be decoded alone; the last
word of a block may hold fewer values than its selector has room for.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Values per word and bits per value, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_PAD = int(COUNTS.max())


def _run_and(fits: np.ndarray, n: int) -> np.ndarray:
    """At each place: do this and the following n - 1 values fit? By doubling."""
    out, have = fits, 1
    while have < n:
        step = min(have, n - have)
        out = out[:, : out.shape[1] - step] & out[:, step:]
        have += step
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, index of each block's first word) of an array of unsigned integers."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    kind = np.uint32 if values.max() < 1 << 32 else np.uint64
    grid = np.zeros((blocks, BLOCK + _PAD), dtype=kind)
    full = n // BLOCK
    grid[:full, :BLOCK] = values[: full * BLOCK].reshape(full, BLOCK)
    if full < blocks:
        grid[full, : n - full * BLOCK] = values[full * BLOCK :]
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK

    pick = np.full((blocks, BLOCK), 15, dtype=np.uint8)
    if kind is np.uint64:
        pick[grid[:, :BLOCK] >= np.uint64(1 << 60)] = 0
    for s in range(14, 0, -1):
        bits, count = int(BITS[s]), int(COUNTS[s])
        fits = grid < kind(1 << bits)
        if np.count_nonzero(fits) == blocks * _PAD:
            continue
        np.putmask(pick, _run_and(fits, count)[:, :BLOCK], s)

    at, live, found = np.zeros(blocks, dtype=np.int64), np.arange(blocks), []
    while len(live):
        chosen = pick[live, at[live]]
        found.append((live, at[live], chosen))
        at[live] += COUNTS[chosen]
        live = live[at[live] < lengths[live]]
    block = np.concatenate([f[0] for f in found])
    order = np.argsort(block, kind="stable")
    block, place, sel = block[order], np.concatenate([f[1] for f in found])[order], np.concatenate([f[2] for f in found])[order]

    width = 1 + (sel == 0)
    first = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), dtype=np.uint64)
    offsets = first[np.searchsorted(block, np.arange(blocks))]
    flat, row = grid.reshape(-1), block * grid.shape[1] + place
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == 0:
            words[first[mine] + 1] = flat[row[mine]]
            continue
        word = np.full(len(mine), int(s) << 60, dtype=np.uint64)
        if BITS[s]:
            for j in range(COUNTS[s]):
                word |= flat[row[mine] + j].astype(np.uint64) << np.uint64(BITS[s] * j)
        words[first[mine]] = word
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values back; any run of whole blocks can be decoded with its own offsets and count."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.uint8)
    head = np.ones(len(words), dtype=bool)
    escape = np.flatnonzero(sel == 0)
    if len(escape):
        # In a run of words that look like escapes, every second one is the raw value of the one before.
        start = np.ones(len(escape), dtype=bool)
        start[1:] = np.diff(escape) > 1
        lead = escape[start][np.cumsum(start) - 1]
        real = escape[(escape - lead) % 2 == 0]
        head[real + 1] = False
    at = np.flatnonzero(head)
    s = sel[at]
    counts = COUNTS[s]
    block = np.searchsorted(offsets, at, side="right") - 1
    before = np.cumsum(counts) - counts
    place = before - before[np.searchsorted(at, offsets)][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    for k in np.unique(s):
        mine = np.flatnonzero(s == k)
        if k == 0:
            out[place[mine]] = words[at[mine] + 1]
            continue
        bits, count = int(BITS[k]), int(COUNTS[k])
        if not bits:
            continue
        word, mask = words[at[mine]], np.uint64((1 << bits) - 1)
        room = stop[mine] - place[mine]
        for j in range(count):
            value = (word >> np.uint64(bits * j)) & mask
            if j and (room <= j).any():
                ok = room > j
                out[place[mine][ok] + j] = value[ok]
            else:
                out[place[mine] + j] = value
    return out
