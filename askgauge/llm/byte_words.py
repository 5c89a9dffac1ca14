"""Words of whole Arrow text columns as 64-bit hashes, with NumPy on the UTF-8 bytes.

Texts are cut into words on their bytes: every separator used here is an ASCII character, and the
bytes of all other characters are 0x80 and above, so byte rules and character rules agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEED = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of bytes other than blank, tab, and the line and page breaks.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of digits, small ASCII letters and all characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after a stage that needed much."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_blocks(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a batch into blocks of about max_bytes of text, at least one row each.

    Yields (first row, end row, UTF-8 bytes, row offsets into them). Null texts are empty.
    """
    array = batch.column(column)
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    if not n:
        return
    wide = array.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + n + 1]
    data = wide.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    give_back()


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time."""
    n = len(starts)
    h = mix((ends - starts).astype(np.uint64) + SEED)
    if not n:
        return h
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    loads = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    at, left = starts.astype(np.int64), (ends - starts).astype(np.int64)
    part = loads[at] & _KEEP[np.minimum(left, 8)]
    h = mix((h ^ part) * _ODD)
    live = np.flatnonzero(left > 8)
    while len(live):
        at_live, left_live = at[live] + 8, left[live] - 8
        at[live], left[live] = at_live, left_live
        part = loads[at_live] & _KEEP[np.minimum(left_live, 8)]
        h[live] = mix((h[live] ^ part) * _ODD)
        live = live[left_live > 8]
    return h


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and the number of words of each row; words never cross rows."""
    if not len(buf):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets) - 1, dtype=np.int64)
    inside = is_word[buf]
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1 : len(buf)]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1 : len(buf)]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of each row)."""
    if lower:
        buf = LOWER[buf]
    starts, ends, counts = word_spans(buf, offsets, is_word)
    return hash_spans(buf, starts, ends), counts


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and their number by row; a shorter row is one whole shingle.

    A row without words has none. Short rows are salted by their length, so that they only equal
    rows of as many words.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    out_counts = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), out_counts)
    out_starts = np.cumsum(out_counts) - out_counts
    at = starts[row] + np.arange(len(row)) - out_starts[row]
    length = np.minimum(counts[row], k).astype(np.uint64)
    total = length * SEED
    factor = SEED
    with np.errstate(over="ignore"):
        for j in range(k):
            factor = (factor * _ODD) | np.uint64(1)
            live = at + j < ends[row]
            if live.all():
                total += words[at + j] * factor
            else:
                total[live] += words[at[live] + j] * factor
    return mix(total), out_counts


def distinct_by_row(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each row with how often they occur: (values, times, counts)."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, row))
    v = values[order]
    fresh = np.ones(len(v), dtype=bool)
    fresh[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(v)))
    return v[at], times, np.bincount(row[at], minlength=len(counts))
