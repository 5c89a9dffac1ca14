"""Benchmark decontamination with suffix arrays over shards of the training texts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_words import ALNUM, text_blocks, word_hashes
from .suffix_array import common_length, search, suffix_array, with_stops
from .tables import read_table, stored, text_or_empty

WINDOW = 10
#: Benchmark words that are searched in one pass over the texts (8 bytes each, broadcast).
PASS_WORDS = 4_000_000
#: An item longer than this is cut into overlapping segments, so that passes can share it.
SEGMENT_WORDS = 1_000_000


def _item_words(window: int, segment: int):
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, offsets in text_blocks(batch, "text"):
                hashes, counts = word_hashes(buf, offsets, ALNUM)
                stop = np.cumsum(counts)
                rows = []
                for i in range(end - first):
                    own = hashes[stop[i] - counts[i] : stop[i]]
                    for at in range(0, max(1, len(own) - window + 1), segment):
                        rows.append((i + first, own[at : at + segment + window - 1]))
                rows = [(i, w) for i, w in rows if len(w)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("item").take(pa.array([i for i, _ in rows], pa.int64())),
                        pa.array([len(w) for _, w in rows], pa.int64()),
                        pa.array([w.tobytes() for _, w in rows], pa.binary()),
                    ],
                    names=["item", "n", "words"],
                )

    return words


def item_passes(benchmark: DataFrame, window: int, pass_words: int, key: str) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """The benchmark's items as word hashes, in groups of about ``pass_words`` words.

    One group at a time reaches the driver. Items without words are left out.
    """
    segment = min(SEGMENT_WORDS, max(window, pass_words // 4))
    rows = benchmark.select(F.col(key).cast("string").alias("item"), text_or_empty().alias("text"))
    words = stored(rows.mapInArrow(_item_words(window, segment), "item string, n long, words binary"), "benchmark-words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    passes = -(-total // pass_words)
    for p in range(passes):
        own = words if passes == 1 else words.where(F.pmod(F.xxhash64("item", "words"), F.lit(passes)) == p)
        group, size = [], 0
        for row in own.toLocalIterator():
            group.append((row["item"], np.frombuffer(row["words"], dtype=np.uint64)))
            size += row["n"]
            # Hashing is uneven at times: the bound holds all the same.
            if size >= 2 * pass_words:
                yield group
                group, size = [], 0
        if group:
            yield group


class Windows:
    """All windows of a group of items, distinct, by length, and the items that have each."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int) -> None:
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        by_length: dict[int, tuple[list, list]] = {}
        for name, words in items:
            width = min(window, len(words))
            views = np.lib.stride_tricks.sliding_window_view(np.maximum(words, np.uint64(1)), width)
            rows, owners = by_length.setdefault(width, ([], []))
            rows.append(views)
            owners.append(np.full(len(views), number.get(name, -1)))
        self.groups = []
        for width, (rows, owners) in sorted(by_length.items()):
            distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(owners)], axis=1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            self.groups.append((width, distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))


def _expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def mark_shard(words: np.ndarray, counts: np.ndarray, windows: Windows) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(hit spans, item numbers) of each row of a shard; spans are flat word positions start, end, ..."""
    rows = len(counts)
    seq, starts = with_stops(words, counts)
    order = suffix_array(seq, max([g[0] for g in windows.groups], default=1))
    cover = np.zeros(len(seq) + 1, dtype=np.int64)
    pairs = []
    for width, distinct, item_at, owners in windows.groups:
        lo, hi = search(seq, order, distinct)
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        places = order[_expand(lo[hit], n)]
        np.add.at(cover, places, 1)
        np.add.at(cover, places + width, -1)
        row = np.searchsorted(starts, places, side="right") - 1
        seen = np.unique(row * len(distinct) + np.repeat(hit, n))
        row, window = seen // len(distinct), seen % len(distinct)
        n_items = item_at[window + 1] - item_at[window]
        own = owners[_expand(item_at[window], n_items)]
        pairs.append(np.stack([np.repeat(row, n_items), own], axis=1))
    covered = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    begin, stop = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(~covered[1:] & covered[:-1])
    # A stop is never covered, so a span lies within its row.
    row = np.searchsorted(starts, begin, side="right") - 1
    flat = np.stack([begin - starts[row], stop - starts[row]], axis=1)
    spans = [x.reshape(-1) for x in np.split(flat, np.searchsorted(row, np.arange(1, rows)))]
    own = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), dtype=np.int64)
    return spans, np.split(own[:, 1], np.searchsorted(own[:, 0], np.arange(1, rows)))


def _marker(group, window: int, last: bool):
    loaded = []

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not loaded:
            loaded.append(Windows(pickle.loads(group.value), window))
        windows = loaded[0]
        names = np.array([*windows.names, ""], dtype=object)
        for batch in batches:
            for first, end, buf, offsets in text_blocks(batch, "text"):
                words, counts = word_hashes(buf, offsets, ALNUM)
                spans, items = mark_shard(words, counts, windows)
                own = batch.slice(first, end - first)
                before = own.column("spans").to_pylist(), own.column("items").to_pylist()
                spans = [(a or []) + b.tolist() for a, b in zip(before[0], spans, strict=True)]
                items = [(a or []) + names[b].tolist() for a, b in zip(before[1], items, strict=True)]
                columns = {"doc_id": own.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
                if not last:
                    columns["text"] = own.column("text")
                yield pa.RecordBatch.from_pydict(columns)

    return mark


def _merged_spans(flat: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """Per row of docs: which of its words lie in an occurrence of a benchmark window.

    Words are lower-cased (A-Z) runs of digits, letters and characters beyond ASCII. A window is ``window``
    consecutive words of an item, or a whole shorter item. Every task cuts its texts into shards of about
    1 MB, builds the suffix array of a shard and binary-searches all benchmark suffixes in it; no text is
    shuffled. A benchmark of more than ``pass_words`` words is searched in several passes. Matches are by 64-bit
    word hashes. Null texts have no words, items with a null id count as hits but are not listed, repeated
    rows and items are fine; other columns take no part.

    Columns: key, n_words, n_hit, n_items, items (sorted distinct ids), items_sha256, longest (words of the
    longest hit span), spans (start, end, ... in words), contaminated.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty().alias("text"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, spans array<long>, items array<string>"
    groups, n = item_passes(benchmark, window, pass_words, item_key), 0
    group = next(groups, None) or []
    while True:
        following = next(groups, None)
        sent = spark.sparkContext.broadcast(pickle.dumps(group))
        rows = rows.mapInArrow(_marker(sent, window, following is None), kind if following is None else f"{kind}, text string")
        n += 1
        if following is None:
            break
        group, rows = following, stored(rows, "contamination-pass")
    flat = F.col("spans")
    if n > 1:
        merge = F.udf(_merged_spans, "array<long>")
        rows = rows.withColumn("spans", F.when(F.size(flat) > 2, merge(flat)).otherwise(flat))
    lengths = F.transform(F.filter(flat, lambda x, i: i % 2 == 1), lambda x, i: x - F.element_at(flat, (i * 2 + 1).cast("int")))
    out = rows.withColumn("lengths", lengths).withColumn("items", F.sort_array(F.array_distinct("items")))
    n_hit = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        F.col("doc_id").alias(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.coalesce(F.array_max("lengths"), F.lit(0)).cast("long").alias("longest"), "spans", (n_hit > 0).alias("contaminated"),
    )


def _clean_rows(group, window: int):
    loaded = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not loaded:
            loaded.append(Windows(pickle.loads(group.value), window))
        for batch in batches:
            clean = []
            for _, _, buf, offsets in text_blocks(batch, "text"):
                spans, _ = mark_shard(*word_hashes(buf, offsets, ALNUM), loaded[0])
                clean += [len(s) == 0 for s in spans]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS, item_key: str = "item_id") -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs; no text is shuffled."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty().alias("text"))
    for group in item_passes(benchmark, window, pass_words, item_key):
        sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(group))
        packed = packed.mapInArrow(_clean_rows(sent, window), packed.schema)
    return packed.select("row.*")


def _longest(group):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pickle.loads(group.value)
        tests, starts = with_stops(np.concatenate([w for _, w in items]), np.array([len(w) for _, w in items]))
        suffixes = np.flatnonzero(tests)
        owner = np.searchsorted(starts, suffixes, side="right") - 1
        names = np.array([name for name, _ in items], dtype=object)
        for batch in batches:
            for first, end, buf, offsets in text_blocks(batch, "text"):
                words, counts = word_hashes(buf, offsets, ALNUM)
                seq, begins = with_stops(words, counts)
                order = suffix_array(seq, len(seq))
                best = np.zeros(len(suffixes), dtype=np.int64)
                where = np.zeros(len(suffixes), dtype=np.int64)
                width = np.array([len(w) for _, w in items])[owner] - (suffixes - starts[owner])
                for size in np.unique(width).tolist():
                    mine = np.flatnonzero(width == size)
                    views = tests[suffixes[mine][:, None] + np.arange(size)]
                    lo, _ = search(seq, order, views)
                    for near in (lo - 1, lo):
                        at = order[np.clip(near, 0, len(order) - 1)]
                        n = common_length(seq, at, tests, suffixes[mine])
                        better = n > best[mine]
                        best[mine[better]], where[mine[better]] = n[better], at[better]
                hit = np.flatnonzero(best)
                row = np.searchsorted(begins, where[hit], side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[owner[hit]], pa.string()), pa.array(suffixes[hit] - starts[owner[hit]], pa.int64()), pa.array(best[hit], pa.int64()),
                        batch.column("doc_id").slice(first, end - first).take(pa.array(row)), pa.array(where[hit] - begins[row], pa.int64()),
                    ],
                    names=["item", "offset", "length", "doc_id", "position"],
                )

    return find


def longest_matches(docs: DataFrame, benchmark: DataFrame, min_words: int = WINDOW, pass_words: int = PASS_WORDS, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """Per benchmark suffix (item, offset in words) with a match of ``min_words`` or more: its longest verbatim
    match (length) and one place of it (doc_id, position), the smallest doc_id and position of that length.

    In a sorted suffix array the longest match of a suffix stands next to its place of insertion. Shards
    report their own best; the best of all comes from one aggregate over (item, offset).
    """
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty().alias("text"))
    kind = f"item string, offset long, length long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, position long"
    found = None
    for group in item_passes(benchmark, min_words, pass_words, item_key):
        one = rows.mapInArrow(_longest(docs.sparkSession.sparkContext.broadcast(pickle.dumps(group))), kind).where(F.col("length") >= min_words)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], kind)
    best = F.min_by(F.struct("length", "doc_id", "position"), F.struct(-F.col("length"), F.col("doc_id"), F.col("position")))
    return found.groupBy("item", "offset").agg(best.alias("b")).select("item", "offset", "b.length", "b.doc_id", "b.position")


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")


OP7_SQL = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), windows AS (
    SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
    SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), hits AS (SELECT g.r, g.i, g.n, w.item_id FROM grams g JOIN windows w ON g.n = w.n AND g.gram = w.gram),
spans AS (
    SELECT r, i, i + n AS e, max(i + n) OVER (PARTITION BY r ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM (SELECT DISTINCT r, i, n FROM hits)
), islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i, e) AS island FROM spans),
runs AS (SELECT r, island, max(e) - min(i) AS n FROM islands GROUP BY r, island),
hit AS (SELECT r, sum(n)::BIGINT AS n_hit, max(n)::BIGINT AS longest FROM runs GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""
