"""Repeated byte strings across documents, found by sorting suffixes over the cluster.

A string of ``WIDTH`` bytes is removed where it also starts in a document with a smaller id. Sorting every
suffix of every text would move each byte fifty times, so suffixes are picked by content first: in each
window of ``WIDTH`` bytes the stretch of ``GRAM`` bytes with the smallest hash is its anchor, equal windows have
equal anchors, and an anchor that no second document has takes no further part. The other anchors'
suffixes are range-partitioned by their leading bytes with sampled splitters; each bucket sorts the windows
around equal anchors by multikey quicksort, eight bytes at a time, and equal neighbours are repeats.

An anchor of very many windows would fill one bucket. Its windows are not gathered: each moves as a 128-bit hash,
the smallest id of each hash is an aggregate, and what has a larger id than that is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_words import hash_spans, mix, text_blocks
from .tables import bit_filter, bit_filters, read_table, stored, text_or_empty

WIDTH = 50
GRAM = 16
#: Windows that are sorted at a time in a bucket; more only when one anchor has more, but never more than HEAVY.
CHUNK = 150_000
#: Anchors of more windows than this are not gathered in a bucket; their windows are compared by hash.
HEAVY = 300_000
#: log2 of the bits of the bitmap of such anchors.
_HEAVY_BITS = 23
#: Anchor hashes that a task gathers before it sends them, each once.
HELD = 1_000_000
#: Bits of an anchor's hash that move; those above only choose the partition. Hashes that agree in both by chance let more through.
_MOVED_BITS = np.uint64(40)
_MOVED = np.uint64((1 << 40) - 1)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
#: Stands for a null id: after all others.
_LAST_ID = (1 << 63) - 1


def _loads(buf: np.ndarray, big: bool) -> np.ndarray:
    """Eight bytes from each place on, zeros behind the end; places up to len(buf) + 56 can be read."""
    padded = np.concatenate([buf, np.zeros(64, dtype=np.uint8)])
    return np.ndarray((len(padded) - 7,), dtype=">u8" if big else "<u8", buffer=padded, strides=(1,))


def anchor_runs(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor, anchor hash) of each run of windows that share their anchor.

    Windows lie within rows; the anchor is the leftmost smallest stretch of a window.
    """
    n, reach = len(buf), width - GRAM + 1
    none = np.zeros(0, dtype=np.int64)
    if n < width:
        return none, none, none, np.zeros(0, dtype=np.uint64)
    load = _loads(buf, big=False)
    with np.errstate(over="ignore"):
        key = load[:n].astype(np.uint64) * _A
        key ^= key >> np.uint64(29)
        key += load[8 : n + 8] * _B
        key ^= key >> np.uint64(32)
        key *= _B
    least = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    place = (least[: n - width + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: n - width + 1]
    start = np.flatnonzero(np.arange(n - width + 1) + width <= ends)
    if not len(start):
        return none, none, none, np.zeros(0, dtype=np.uint64)
    at = place[start]
    fresh = np.append(True, (at[1:] != at[:-1]) | (np.diff(start) > 1))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last], at[first], mix(key[at[first]])


def _blocks(batch: pa.RecordBatch, reps: np.ndarray, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row offsets, ids, tags) of the rows of a batch that may be the first of equal texts."""
    name = batch.column("name").to_numpy()
    at = name & mask
    keep = (reps[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    if not keep.all():
        batch = batch.filter(pa.array(keep))
    ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
    # A dozen arrays of eight bytes per byte of text are alive at a time.
    for first, end, buf, offsets in text_blocks(batch, "text", 1_000_000):
        yield buf, offsets, ids[first:end], tags[first:end]


def _packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], groups: int) -> pa.RecordBatch:
    """Hashes with their windows and whether two documents have them, as one row per group of hashes.

    An entry takes six bytes, which lie in planes: the low 40 bits of the hash, highest byte first, and up to 255 windows.
    The bits above choose the group. A hash of two documents takes two entries, one of many windows as many as it needs.
    """
    h, windows, shared = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h)
    h, windows, shared = h[order], windows[order], shared[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["group", "packed"])
    twice = np.logical_or.reduceat(shared, at) | (np.diff(np.append(at, len(h))) > 1)
    h, windows = h[at], np.add.reduceat(windows, at)
    entries = np.maximum(-(-windows // 255), 1 + twice)
    which = np.repeat(np.arange(len(h)), entries)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(entries) - entries, entries)
    group = ((h >> _MOVED_BITS) % np.uint64(groups)).astype(np.int32)
    order = np.lexsort((h & _MOVED, group))
    place = np.argsort(order)
    order = np.argsort(place[which], kind="stable")
    which, nth = which[order], nth[order]
    planes = h[which].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 4::-1]
    counts = np.clip(windows[which] - 255 * nth, 0, 255).astype(np.uint8)
    planes = np.column_stack([planes, counts])
    group = group[which]
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    rows = [planes[a:b].T.tobytes() for a, b in zip(cut, np.append(cut[1:], len(group)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(group[cut]), pa.array(rows, pa.binary())], names=["group", "packed"])


def _unpacked(group: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, windows) of a row of ``_packed``; the group stands above the 40 bits."""
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(6, -1)
    words = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    words[:, :5] = planes[4::-1].T
    return words.view("<u8").ravel().astype(np.int64) | (group << int(_MOVED_BITS)), planes[5]


def _anchor_hashes(sent, bits_log2: int, width: int, groups: int):
    """Anchor hashes with the number of their windows, each once per stretch of some million anchors, twice when two documents of it have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, mask = np.frombuffer(sent.value, dtype=np.uint8), (1 << bits_log2) - 1
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for buf, offsets, ids, _ in _blocks(batch, reps, mask):
                first, last, _, hashes = anchor_runs(buf, offsets, width)
                if not len(first):
                    continue
                doc = ids[np.searchsorted(offsets, first, side="right") - 1]
                order = np.lexsort((doc, hashes))
                h, doc = hashes[order], doc[order]
                new = np.append(True, h[1:] != h[:-1])
                other = ~new & np.append(False, doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                held.append((h[at], np.add.reduceat((last - first + 1)[order], at), np.logical_or.reduceat(other, at)))
                size += len(at)
                if size >= HELD:
                    yield _packed(held, groups)
                    held, size = [], 0
        if held:
            yield _packed(held, groups)

    return run


def _repeated(heavy: int):
    """Of a partition's hashes those that it holds more than once (kind 0) and those of more than so many windows (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_unpacked(g, x) for batch in batches for g, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if not own:
            return
        h, windows = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.argsort(h)
        h = h[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        if not len(at):
            return
        twice = h[at][np.diff(np.append(at, len(h))) > 1]
        many = h[at][np.add.reduceat(windows[order].astype(np.int64), at) > heavy]
        kind = np.repeat(np.array([0, 1], dtype=np.int32), [len(twice), len(many)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([twice, many])), pa.array(kind)], names=["h", "kind"])

    return run


def _holds(bits: np.ndarray, bits_log2: int, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64((1 << bits_log2) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


_RUN_SCHEMA = "lead long, next long, context binary, ahead int, id long, tag long, start long, end long"
_RUN_NAMES = ["lead", "next", "context", "ahead", "id", "tag", "start", "end"]


def _contexts(sent, bits_log2: int, hits, hit_bits: int, width: int, heavy=None):
    """Runs of windows whose anchor may be repeated and is not heavy, with their bytes.

    Equal runs of a block meet here already: only the smallest id's go on, the others are repeats for certain
    and are passed on as removed ranges, without bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, mask = np.frombuffer(sent.value, dtype=np.uint8), (1 << bits_log2) - 1
        bits = np.frombuffer(hits.value, dtype=np.uint8)
        many = None if heavy is None else np.frombuffer(heavy.value, dtype=np.uint8)
        for batch in batches:
            for buf, offsets, ids, tags in _blocks(batch, reps, mask):
                first, last, anchor, hashes = anchor_runs(buf, offsets, width)
                keep = _holds(bits, hit_bits, hashes)
                if many is not None:
                    keep &= ~_holds(many, _HEAVY_BITS, hashes)
                first, last, anchor = first[keep], last[keep], anchor[keep]
                if not len(first):
                    continue
                row = np.searchsorted(offsets, first, side="right") - 1
                stop = last + width
                same = mix(hash_spans(buf, first, stop) + (anchor - first).astype(np.uint64))
                _, which = np.unique(same, return_inverse=True)
                least = np.full(which.max() + 1, _LAST_ID)
                np.minimum.at(least, which, ids[row])
                sure = ids[row] > least[which]
                load = _loads(buf, big=True)
                # Signed order of the flipped words is the order of the bytes.
                flip = np.uint64(1 << 63)
                lead = (load[anchor].astype(np.uint64) ^ flip).view(np.int64)
                following = (load[anchor + 8].astype(np.uint64) ^ flip).view(np.int64)
                spread = mix(same + first.astype(np.uint64)).view(np.int64)
                lengths = np.where(sure, 0, stop - first)
                raw = buf[_gather(first, lengths)]
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                context = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(sure, spread, lead)), pa.array(np.where(sure, 0, following)), context, pa.array((anchor - first).astype(np.int32)),
                        pa.array(ids[row]), pa.array(tags[row]), pa.array(first - offsets[row]), pa.array(stop - offsets[row]),
                    ],
                    names=_RUN_NAMES,
                )

    return run


_WINDOW_SCHEMA = "w1 long, w2 long, id long, tag long, starts array<int>, ends array<int>"
_WINDOW_NAMES = ["w1", "w2", "id", "tag", "starts", "ends"]


def window_hashes(buf: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the windows from each place on, as two arrays."""
    load = _loads(buf, big=False)
    one, two = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
    for k in (*range(0, width - 8, 8), width - 8):
        part = load[at + k].astype(np.uint64)
        one, two = mix((one ^ part) * _A), mix((two + part) * _B)
    return one.view(np.int64), two.view(np.int64)


def _listed(at: np.ndarray, fresh: np.ndarray, width: int, offsets: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(first of each entry, starts, ends): the ranges of the windows at ``at``, in a list per entry; windows side by side are one range."""
    begin = np.flatnonzero(fresh | np.append(True, at[1:] != at[:-1] + 1))
    stop = np.append(begin[1:], len(at)) - 1
    cuts = pa.array(np.append(np.flatnonzero(fresh[begin]), len(begin)).astype(np.int32))
    own = offsets[row[begin]]
    starts, ends = (pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (at[begin] - own, at[stop] - own + width))
    return np.flatnonzero(fresh), starts, ends


def _windows(sent, bits_log2: int, heavy, width: int):
    """Hashes of all windows of heavy anchors with the ranges of each in a document.

    Equal windows of a block meet here: those of the smallest id go on, the others are repeats for certain and
    are passed on without a hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, mask = np.frombuffer(sent.value, dtype=np.uint8), (1 << bits_log2) - 1
        many = np.frombuffer(heavy.value, dtype=np.uint8)
        for batch in batches:
            for buf, offsets, ids, tags in _blocks(batch, reps, mask):
                first, last, _, hashes = anchor_runs(buf, offsets, width)
                keep = _holds(many, _HEAVY_BITS, hashes)
                if not keep.any():
                    continue
                at = _gather(first[keep], (last - first + 1)[keep])
                w1, w2 = window_hashes(buf, at, width)
                # Stable: the places of equal windows stay in order.
                order = np.lexsort((w2, w1))
                w1, w2, at = w1[order], w2[order], at[order]
                row = np.searchsorted(offsets, at, side="right") - 1
                new = np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))
                least = np.minimum.reduceat(ids[row], np.flatnonzero(new))[np.cumsum(new) - 1]
                sure = ids[row] > least
                new |= np.append(True, row[1:] != row[:-1])
                open_row = row[~sure]
                entry, starts, ends = _listed(at[~sure], new[~sure], width, offsets, open_row)
                own = open_row[entry]
                yield pa.RecordBatch.from_arrays([pa.array(w1[~sure][entry]), pa.array(w2[~sure][entry]), pa.array(ids[own]), pa.array(tags[own]), starts, ends], names=_WINDOW_NAMES)
                if sure.any():
                    at = np.sort(at[sure])
                    row = np.searchsorted(offsets, at, side="right") - 1
                    entry, starts, ends = _listed(at, np.append(True, row[1:] != row[:-1]), width, offsets, row)
                    own, none = row[entry], pa.nulls(len(entry), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(ids[own]), pa.array(tags[own]), starts, ends], names=_WINDOW_NAMES)

    return run


def late_windows(windows: DataFrame) -> DataFrame:
    """Ranges (id, tag, start, end) of the windows that a smaller id has, too. No window's rows meet in one task: the smallest id is summed up in the map tasks."""
    least = windows.where("w1 is not null").groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    late = windows.join(least, ["w1", "w2"]).where("id > least").select("id", "tag", "starts", "ends")
    every = late.unionByName(windows.where("w1 is null").select("id", "tag", "starts", "ends"))
    return every.select("id", "tag", F.explode(F.arrays_zip("starts", "ends")).alias("r")).select("id", "tag", F.col("r.starts").cast("long").alias("start"), F.col("r.ends").cast("long").alias("end"))


def multikey_order(keys: list) -> tuple[np.ndarray, np.ndarray]:
    """Sort by several keys, one after the other, each only among what is still tied.

    ``keys`` are functions from an array of places to their key values, most significant first. Returns the
    order and, for each place in it, whether it differs from the one before.
    """
    n = len(keys[0](slice(None)))
    first = keys[0](slice(None))
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])[:n]
    for key in keys[1:]:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(fresh[at])
        value = key(order[at])
        by = np.lexsort((value, group))
        order[at], value, group = order[at][by], value[by], group[by]
        fresh[at] = np.append(True, (value[1:] != value[:-1]) | (group[1:] != group[:-1]))
    return order, fresh


def repeated_ranges(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the byte ranges, within each run's document, whose windows occur under a smaller id.

    The table holds runs with their bytes; equal anchors must be together in it.
    """
    context = table.column("context").combine_chunks()
    if isinstance(context, pa.ChunkedArray):
        context = context.chunk(0)
    offsets = np.frombuffer(context.buffers()[1], dtype=np.int32)[context.offset : context.offset + len(context) + 1].astype(np.int64)
    buf = np.frombuffer(context.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lead, following = table.column("lead").to_numpy(), table.column("next").to_numpy()
    ahead, ids, start = (table.column(c).to_numpy() for c in ("ahead", "id", "start"))
    group = np.cumsum(np.append(True, (lead[1:] != lead[:-1]) | (following[1:] != following[:-1]))[: len(lead)])
    windows = np.diff(offsets) - width + 1
    row = np.repeat(np.arange(len(windows)), windows)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = offsets[:-1][row] + nth
    load = _loads(buf, big=True)
    place = group[row] * 256 + (ahead[row] - nth)
    words = [lambda i, k=k: load[at[i] + k] for k in (*range(0, width - 8, 8), width - 8)]
    order, fresh = multikey_order([lambda i: place[i], *words])
    first = np.flatnonzero(fresh)
    own = ids[row[order]]
    least = np.minimum.reduceat(own, first) if len(first) else own
    hit = np.zeros(len(row), dtype=bool)
    hit[order] = own > np.repeat(least, np.diff(np.append(first, len(order))))
    begin = hit & np.append(True, ~hit[:-1] | (row[1:] != row[:-1]))[: len(hit)]
    stop = hit & np.append(~hit[1:] | (row[1:] != row[:-1]), True)[: len(hit)]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop)
    return row[begin], start[row[begin]] + nth[begin], start[row[begin]] + nth[stop] + width


def _buckets(width: int):
    """Over runs sorted by their anchors' leading bytes: ranges to remove, a chunk of whole anchors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def ranges(row: np.ndarray, table: pa.Table, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            take = pa.array(row)
            return pa.RecordBatch.from_arrays(
                [table.column("id").take(take).combine_chunks(), table.column("tag").take(take).combine_chunks(), pa.array(start), pa.array(end)], names=["id", "tag", "start", "end"]
            )

        def solve(table: pa.Table) -> pa.RecordBatch:
            row, start, end = repeated_ranges(table, width)
            return ranges(row, table, start, end)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            bare = pa.compute.equal(pa.compute.binary_length(table.column("context")), 0)
            sure = table.filter(bare)
            if sure.num_rows:
                yield ranges(np.arange(sure.num_rows), sure, sure.column("start").to_numpy(), sure.column("end").to_numpy())
            table = table.filter(pa.compute.invert(bare))
            if not table.num_rows:
                continue
            held.append(table)
            size += int((table.column("end").to_numpy() - table.column("start").to_numpy() - width + 1).sum())
            if size < CHUNK:
                continue
            whole = pa.concat_tables(held)
            lead, following = whole.column("lead").to_numpy(), whole.column("next").to_numpy()
            # The last anchor may go on in the next batch.
            cut = int(np.argmax((lead == lead[-1]) & (following == following[-1])))
            # Chunks of whole anchors.
            windows = np.cumsum(whole.column("end").to_numpy() - whole.column("start").to_numpy() - width + 1)
            starts = np.flatnonzero(np.append(True, (lead[1:] != lead[:-1]) | (following[1:] != following[:-1])))
            at = 0
            while at < cut:
                done = windows[at - 1] if at else 0
                nxt = starts[(starts > at) & (windows[starts - 1] - done >= CHUNK)]
                stop = min(cut, int(nxt[0]) if len(nxt) else cut)
                yield solve(whole.slice(at, stop - at))
                at = stop
            held = [whole.slice(cut)]
            size = int(windows[-1] - (windows[cut - 1] if cut else 0))
        if held:
            yield solve(pa.concat_tables(held))

    return run


def _rows_hit(sent, bits_log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = np.frombuffer(sent.value, dtype=np.uint8), (1 << bits_log2) - 1
        for batch in batches:
            at = batch.column("tag").to_numpy() & mask
            keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            yield batch.filter(pa.array(keep)).select(["id", "tag", "text"])

    return run


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The union of byte ranges as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, kept = [], [], []
        for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True):
            raw, runs = text.encode(), merged(starts, ends)
            digest, at = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            removed.append(sum(b - a for a, b in runs))
            spans.append(len(runs))
            kept.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], names=["id", "tag", "n_removed", "n_spans", "kept_sha256"])


def suffix_runs(docs: DataFrame, width: int = WIDTH, bits_log2: int = 26, key: str = "doc_id", heavy: int = HEAVY) -> tuple[DataFrame, DataFrame | None]:
    """Runs of windows around repeated anchors, and the hashed windows of anchors with more than ``heavy`` windows (None when there are none).

    No anchor has more than ``heavy`` windows among the runs.
    """
    send = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST_ID)).alias("id"), text_or_empty().alias("text")).withColumn("tag", F.xxhash64("text"))
    first = rows.groupBy("tag", F.md5("text").alias("m")).agg(F.min("id").alias("id"), F.max(F.octet_length("text")).alias("n"))
    first = stored(first.where(F.col("n") >= width).select(F.xxhash64("id", "tag").alias("name"), "n"), "first-texts")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # About a million anchors per partition, whatever the size.
    parts = max(8, int(total / 16 / 1_000_000) + 1)
    reps = send(bit_filter(first, "name", bits_log2))
    texts = rows.withColumn("name", F.xxhash64("id", "tag"))
    packed = texts.mapInArrow(_anchor_hashes(reps, bits_log2, width, parts), "group int, packed binary")
    hashes = packed.repartitionById(parts, "group").mapInArrow(_repeated(heavy), "h long, kind int")
    twice, many = bit_filters(hashes, "h", "kind", [bits_log2 + 1, _HEAVY_BITS])
    found = send(many) if any(many) else None
    runs = texts.mapInArrow(_contexts(reps, bits_log2, send(twice), bits_log2 + 1, width, found), _RUN_SCHEMA)
    return runs, None if found is None else stored(texts.mapInArrow(_windows(reps, bits_log2, found, width), _WINDOW_SCHEMA), "windows")


def repeated_bytes(docs: DataFrame, width: int = WIDTH, bits_log2: int = 26, key: str = "doc_id", heavy: int = HEAVY) -> DataFrame:
    """Ranges (id, tag, start, end) of bytes covered by strings of ``width`` bytes that also start under a smaller id.

    ``tag`` is the hash of a row's text, ``id`` its key (null keys stand as the largest number). Texts equal
    to one under a smaller id have no ranges here: all of them is repeated, when they are long enough.
    """
    runs, windows = suffix_runs(docs, width, bits_log2, key, heavy)
    ordered = runs.repartitionByRange("lead", "next").sortWithinPartitions("lead", "next")
    ranges = ordered.mapInArrow(_buckets(width), "id long, tag long, start long, end long")
    return stored(ranges if windows is None else ranges.unionByName(late_windows(windows)), "ranges")


def remove_repeats(docs: DataFrame, width: int = WIDTH, bits_log2: int = 26, key: str = "doc_id", heavy: int = HEAVY) -> DataFrame:
    """Per row of docs: key, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of what is left.

    A byte goes when a string of ``width`` bytes that covers it also starts in a row with a smaller key; strings
    are judged on the input and never cross rows. Null texts are empty and keep nothing. A null key counts as
    larger than all others. Rows with equal keys do not remove each other's bytes. Texts shorter than
    ``width`` bytes stay whole. Other columns take no part.
    """
    send = docs.sparkSession.sparkContext.broadcast
    ranges = repeated_bytes(docs, width, bits_log2, key, heavy)
    hit = send(bit_filter(ranges, "tag", min(bits_log2, 24)))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST_ID)).alias("id"), text_or_empty().alias("text")).withColumn("tag", F.xxhash64("text"))
    texts = rows.select("id", "tag", "text").mapInArrow(_rows_hit(hit, min(bits_log2, 24)), "id long, tag long, text string")
    lists = ranges.groupBy("id", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    cut = texts.join(lists, ["id", "tag"]).mapInArrow(_cut, "id long, tag long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["id", "tag"])
    narrow = stored(rows.select("key", "id", "tag", F.md5("text").alias("m"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own_sha256")), "texts")
    least = narrow.groupBy("tag", "m").agg(F.min("id").alias("least"))
    copy = (F.col("id") > F.col("least")) & (F.col("n_bytes") >= width)
    out = narrow.join(least, ["tag", "m"]).join(cut, ["id", "tag"], "left")
    return out.select(
        F.col("key").alias(key),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
