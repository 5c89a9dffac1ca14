"""Ranked lexical search over K2-treaps of the term-document grid.

Documents are cut into shards of at most 2**SIDE_LOG2. A shard's terms are cut into bands of as many rows as its
grid has columns, and each band is a quadtree: a node stands for a square cell and holds the point of largest
impact in it, which its children no longer hold; a cell without further points has no children. So a tree has as many
nodes as the grid has points, and a node's impact bounds all that lies below it.

For an item, the rows of its terms descend together over ranges of documents: the score of a range is at most the
sum over its terms of weight times the impact of the term's cell there (or of a point of the row met on the
way). Ranges with the highest bounds are halved first, until no open range can reach the tenth best score.
Indexes are tables of shards, built without a shuffle; searching returns ten rows a shard and item at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .byte_words import ALNUM, LOWER, give_back, text_blocks, word_hashes, word_spans
from .tables import read_table, stored, text_or_empty

SIDE_LOG2 = 12
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 8_000_000
#: Terms searched in one pass over the index.
PASS_TERMS = 20_000
#: Ranges of an item that are halved at a time.
AT_ONCE = 48
_CODEC = "zstd"
INDEX = "ids array<{id}>, n binary, terms binary, df binary, levels binary, mask binary, row binary, col binary, tf binary"


# --- building ---------------------------------------------------------------------------------------------------


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2**16, moved to the even places."""
    x = x.astype(np.int64)
    for shift, keep in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x | x << shift) & keep
    return x


def build_treap(row: np.ndarray, col: np.ndarray, rank: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the quadtrees over points (row, col), level by level, cells in quadrant order: (levels, point, mask).

    ``rank`` (non-negative, below 2**31) orders points by impact; rows of 2**height form a tree. levels counts the nodes of each
    level, point is the point a node holds, and bit q of mask tells whether its quadrant q has a child.
    """
    low = (1 << height) - 1
    code = (row.astype(np.int64) >> height) << (2 * height) | _spread(row & low) << 1 | _spread(col)
    order = np.argsort(code, kind="stable")
    code, rank = code[order], rank[order].astype(np.int64)
    left = np.arange(len(code))
    levels, points, masks = [], [], []
    for level in range(height + 1):
        cell = code[left] >> (2 * (height - level))
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, dtype=np.int64)
        if level:
            mask = np.zeros(levels[-1], dtype=np.uint8)
            np.bitwise_or.at(mask, np.searchsorted(cells, cell[starts] >> 2), (1 << (cell[starts] & 3)).astype(np.uint8))
            masks.append(mask)
        best = np.maximum.reduceat(rank[left] << 32 | left, starts) & 0xFFFFFFFF if len(starts) else starts
        cells = cell[starts]
        levels.append(len(best))
        points.append(best)
        left = np.delete(left, np.searchsorted(left, best))
    masks.append(np.zeros(levels[-1], dtype=np.uint8))
    return np.array(levels, dtype=np.int32), order[np.concatenate(points)], np.concatenate(masks)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _pack(values: np.ndarray, kind: str) -> bytes:
    raw = np.ascontiguousarray(values, dtype=kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec(_CODEC).compress(raw, asbytes=True)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.Codec(_CODEC).decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), dtype=kind)


def length_norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 10 + 90 * n * documents // max(terms, 1)


def _shard(ids: list, tokens: np.ndarray, counts: np.ndarray, documents: int, total: int) -> dict:
    """The index of some documents, as columns."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((doc, tokens))
    tokens, doc = tokens[order], doc[order]
    fresh = np.append(True, (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])) if len(tokens) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(fresh)
    tf = np.diff(np.append(at, len(tokens)))
    term, col = tokens[at], doc[at]
    terms, row, df = np.unique(term, return_inverse=True, return_counts=True)
    height = max(1, int(len(counts) - 1).bit_length())
    levels, point, mask = build_treap(row, col, impacts(tf, length_norms(counts, documents, total)[col]), height)
    # A node's coordinates count from the corner of its cell.
    below = (1 << (height - np.repeat(np.arange(height + 1), levels))) - 1
    return {
        "ids": ids, "n": _pack(counts, "<i8"), "terms": _pack(terms, "<u8"), "df": _pack(df, "<i4"), "levels": _pack(levels, "<i4"), "mask": _pack(mask, "u1"),
        "row": _pack(row[point] & below, "<u2"), "col": _pack(col[point] & below, "<u2"), "tf": _pack(tf[point], "<u4" if tf.max(initial=0) > 65535 else "<u2"),
    }


def _build(kind: pa.Schema, documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        tokens: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = pa.RecordBatch.from_pylist([_shard(ids, np.concatenate(tokens), np.concatenate(counts), documents, total)], schema=kind)
            ids.clear(), tokens.clear(), counts.clear()
            size = 0
            return out

        for batch in batches:
            for first, end, buf, offsets in text_blocks(batch, "text", 1_000_000):
                words, own = word_hashes(buf, offsets, ALNUM)
                own_ids = batch.column("id").slice(first, end - first).to_pylist()
                at = 0
                # Documents of a block may fill up one shard and begin the next.
                while at < len(own):
                    if ids and (size + len(buf) > SHARD_BYTES or len(ids) >= 1 << SIDE_LOG2):
                        yield flush()
                        give_back()
                    stop = min(len(own), at + (1 << SIDE_LOG2) - len(ids))
                    ids += own_ids[at:stop]
                    counts.append(own[at:stop])
                    tokens.append(words[own[:at].sum() : own[:stop].sum()])
                    size += int(offsets[stop] - offsets[at])
                    at = stop
        if ids:
            yield flush()
        give_back()

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = total = 0
    for batch in batches:
        for _, _, buf, offsets in text_blocks(batch, "text", 1_000_000):
            _, _, counts = word_spans(LOWER[buf], offsets, ALNUM)
            documents += int((counts > 0).sum())
            total += int(counts.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([total])], names=["documents", "terms"])


class Index:
    """A table of shards and the two numbers of the collection that impacts depend on."""

    def __init__(self, shards: DataFrame, documents: int, terms: int) -> None:
        self.shards, self.documents, self.terms = shards, documents, terms


def build_index(docs: DataFrame, key: str = "doc_id") -> Index:
    """Index every term of every text; each task cuts its documents into shards, nothing is shuffled.

    Terms are runs of ASCII digits and letters (A-Z lower-cased) and of all characters beyond ASCII, kept as 64-bit
    hashes. Null and empty texts have no terms; they take a column and nothing else. Rows with equal or null keys are
    documents of their own. Other columns take no part.
    """
    rows = docs.select(F.col(key).alias("id"), text_or_empty().alias("text"))
    documents, total = rows.select("text").mapInArrow(_lengths, "documents long, terms long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    schema = T._parse_datatype_string(INDEX.format(id=rows.schema["id"].dataType.simpleString()))
    arrow = pa.schema([pa.field("ids", pa.list_(to_arrow_type(rows.schema["id"].dataType))), *[pa.field(f.name, pa.binary()) for f in schema.fields[1:]]])
    return Index(stored(rows.mapInArrow(_build(arrow, documents, total), schema), "k2-shards"), documents, total)


# --- searching --------------------------------------------------------------------------------------------------


class Treap:
    """A shard unpacked for searching: for every node its point and impact, and where its children begin."""

    def __init__(self, shard: dict, documents: int, total: int) -> None:
        counts = _unpack(shard["n"], "<i8")
        self.terms = _unpack(shard["terms"], "<u8")
        self.levels, self.mask = _unpack(shard["levels"], "<i4"), _unpack(shard["mask"], "u1")
        self.height = len(self.levels) - 1
        raw = shard["tf"]
        nodes = len(self.mask)
        wide = int.from_bytes(raw[:8], "little") == 4 * nodes
        tf = _unpack(raw, "<u4" if wide else "<u2").astype(np.int64)
        children = np.array([bin(x).count("1") for x in range(16)])[self.mask]
        firsts = np.cumsum(np.append(0, self.levels))
        # Levels follow one another, so the first child of a node lies after the roots and all earlier nodes' children.
        self.child = self.levels[0] + np.cumsum(children) - children
        cell_row, cell_col = np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
        cell_row[: self.levels[0]] = np.arange(self.levels[0])
        for level in range(self.height):
            own = np.arange(firsts[level], firsts[level + 1])
            has = (self.mask[own][:, None] >> np.arange(4)) & 1 > 0
            node, quadrant = np.nonzero(has)
            at = slice(firsts[level + 1], firsts[level + 2])
            cell_row[at] = 2 * cell_row[own[node]] + (quadrant >> 1)
            cell_col[at] = 2 * cell_col[own[node]] + (quadrant & 1)
        below = self.height - np.repeat(np.arange(self.height + 1), self.levels)
        self.row = (cell_row << below) + _unpack(shard["row"], "<u2")
        self.col = (cell_col << below) + _unpack(shard["col"], "<u2")
        self.impact = impacts(tf, length_norms(counts, documents, total)[self.col])


_RANK = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)])


def _ranks(groups: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Place of each member within its group, along an order that keeps groups together."""
    own = groups[order]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, dtype=np.int64)
    out = np.empty(len(own), dtype=np.int64)
    out[order] = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return out


class _Ranges:
    """Open ranges of documents by item, and what each of the item's terms has in them.

    A part is one term's share in a range: the cell of the term's row (``node``, its impact the largest of the
    cell) or, with node -1, a point of the row that was met above (``doc``). Parts lie in the order of their ranges.
    """

    def __init__(self, item: np.ndarray, level: np.ndarray, prefix: np.ndarray, parts: dict[str, np.ndarray]) -> None:
        self.item, self.level, self.prefix, self.parts = item, level, prefix, parts
        # The best a term can have: the largest of its parts in the range. Parts of one term are neighbours.
        owner, slot, value = parts["range"], parts["slot"], parts["weight"] * parts["impact"]
        starts = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (slot[1:] != slot[:-1]))) if len(owner) else np.zeros(0, dtype=np.int64)
        best = np.maximum.reduceat(value, starts) if len(starts) else value
        self.bound = np.zeros(len(item), dtype=np.int64)
        np.add.at(self.bound, owner[starts], best)

    def take(self, live: np.ndarray) -> _Ranges:
        number = np.full(len(self.item), -1)
        number[live] = np.arange(int(live.sum()))
        kept = live[self.parts["range"]]
        parts = {k: v[kept] for k, v in self.parts.items()}
        parts["range"] = number[parts["range"]]
        return _Ranges(self.item[live], self.level[live], self.prefix[live], parts)

    def joined(self, other: _Ranges) -> _Ranges:
        parts = {k: np.concatenate([v, other.parts[k] + (len(self.item) if k == "range" else 0)]) for k, v in self.parts.items()}
        return _Ranges(*[np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("item", "level", "prefix")], parts)

    def halved(self, treap: Treap) -> _Ranges:
        """Both halves of every range; what holds none of the item's terms is left out."""
        p = self.parts
        depth = treap.height - self.level[p["range"]] - 1
        cells, points = np.flatnonzero(p["node"] >= 0), np.flatnonzero(p["node"] < 0)
        node = p["node"][cells]
        # A point of the term's own row goes on as a point, into the half that has its document.
        met = treap.row[node] == p["row"][cells]
        point = np.concatenate([points, cells[met]])
        doc = np.concatenate([p["doc"][points], treap.col[node[met]]])
        impact = np.concatenate([p["impact"][points], treap.impact[node[met]]])
        new = [(point, doc >> depth[point] & 1, np.full(len(point), -1), doc, impact)]
        upper = p["row"][cells] >> depth[cells] & 1
        for half in (0, 1):
            quadrant = 2 * upper + half
            mask = treap.mask[node]
            has = mask >> quadrant.astype(np.uint8) & 1 > 0
            child = treap.child[node[has]] + _RANK[mask[has], quadrant[has]]
            new.append((cells[has], np.full(int(has.sum()), half), child, np.full(int(has.sum()), -1), treap.impact[child]))
        source, half, child, doc, impact = (np.concatenate([x[i] for x in new]) for i in range(5))
        owner = 2 * p["range"][source] + half
        order = np.lexsort((p["slot"][source], owner))
        owner, source = owner[order], source[order]
        ranges, number = np.unique(owner, return_inverse=True)
        parts = {"range": number, "slot": p["slot"][source], "row": p["row"][source], "weight": p["weight"][source], "node": child[order], "doc": doc[order], "impact": impact[order]}
        return _Ranges(self.item[ranges >> 1], self.level[ranges >> 1] + 1, 2 * self.prefix[ranges >> 1] + (ranges & 1), parts)


def search_shard(treap: Treap, items: np.ndarray, terms: np.ndarray, weights: np.ndarray, ties: np.ndarray, best: int, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, column, score) of each item's ``best`` documents with a score above 0.

    Items are small numbers with a row for each of their terms; ties orders the columns of equal scores.
    """
    place = np.minimum(np.searchsorted(treap.terms, terms), max(len(treap.terms) - 1, 0))
    known = treap.terms[place] == terms if len(treap.terms) else np.zeros(len(terms), dtype=bool)
    items, row, weights = items[known], place[known], weights[known]
    many = int(items.max(initial=-1)) + 1
    order = np.argsort(items, kind="stable")
    items, row, weights = items[order], row[order], weights[order]
    root = row >> treap.height
    asked, number = np.unique(items, return_inverse=True)
    parts = {"range": number, "slot": np.arange(len(items)), "row": row, "weight": weights, "node": root, "doc": np.full(len(items), -1), "impact": treap.impact[root]}
    open_ranges = _Ranges(asked, np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=np.int64), parts)
    found = [np.zeros(0, dtype=np.int64)] * 3
    least = np.ones(many, dtype=np.int64)
    while len(open_ranges.item):
        # Best bounds first; ranges that may only tie with the last of the best are still looked at.
        order = np.lexsort((-open_ranges.level, -open_ranges.bound, open_ranges.item))
        chosen = _ranks(open_ranges.item, order) < at_once
        whole = open_ranges.level == treap.height
        done = chosen & whole
        if done.any():
            found = [np.concatenate(x) for x in zip(found, (open_ranges.item[done], open_ranges.prefix[done], open_ranges.bound[done]), strict=True)]
            order = np.lexsort((ties[found[1]], -found[2], found[0]))
            rank = _ranks(found[0], order)
            last = rank == best - 1
            least[found[0][last]] = np.maximum(found[2][last], 1)
            found = [x[rank < best] for x in found]
        halves = open_ranges.take(chosen & ~whole).halved(treap)
        rest = open_ranges.take(~chosen & (open_ranges.bound >= least[open_ranges.item]))
        open_ranges = rest.joined(halves.take(halves.bound >= least[halves.item]))
    return found[0], found[1], found[2]


def _frequencies(sent):
    """(term, df) of the asked terms in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.frombuffer(sent.value, dtype=np.uint64)
        seen = np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            for raw, raw_df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist(), strict=True):
                terms, df = _unpack(raw, "<u8"), _unpack(raw_df, "<i4")
                place = np.minimum(np.searchsorted(terms, asked), max(len(terms) - 1, 0))
                hit = terms[place] == asked if len(terms) else np.zeros(len(asked), dtype=bool)
                seen[hit] += df[place[hit]]
        yield pa.RecordBatch.from_arrays([pa.array(asked[seen > 0].view(np.int64)), pa.array(seen[seen > 0])], names=["term", "df"])

    return run


def _search(sent, kind: pa.DataType, documents: int, total: int, best: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, weights = sent.value
        for batch in batches:
            for shard in batch.to_pylist():
                treap = Treap(shard, documents, total)
                ids = pa.array(shard["ids"], kind)
                # Place of each document by its id, nulls last.
                ties = np.empty(len(ids), dtype=np.int64)
                ties[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                item, col, score = search_shard(treap, items, terms, weights, ties, best)
                yield pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(col)), pa.array(score)], names=["item", "doc", "score"])
                del treap, shard
            give_back()

    return run


def term_weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)


def _passes(items: DataFrame, key: str, pass_terms: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Items by blocks of about ``pass_terms`` distinct terms each: (ids, item number, term) with a row for each item's term."""
    ids, numbers, terms, size = [], [], [], 0
    for item, text in items.select(key, text_or_empty()).toLocalIterator():
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        own = np.unique(word_hashes(raw, np.array([0, len(raw)]), ALNUM)[0])
        if ids and size + len(own) > pass_terms:
            yield ids, np.concatenate(numbers), np.concatenate(terms)
            ids, numbers, terms, size = [], [], [], 0
        numbers.append(np.full(len(own), len(ids)))
        terms.append(own)
        ids.append(item)
        size += len(own)
    if ids:
        yield ids, np.concatenate(numbers), np.concatenate(terms)


def search(index: Index, items: DataFrame, best: int = 10, item_key: str = "item_id", key: str = "doc_id", pass_terms: int = PASS_TERMS) -> DataFrame:
    """Per row of items, its ``best`` documents with a score above 0: item key, rank (from 1), document key, score.

    Equal scores rank by ascending key, null keys last, documents of one key in any order. Items without terms (null or empty
    texts), or whose terms no document has, have no rows; rows with equal item keys are items of their own. Items are searched
    in blocks, each a pass over the index, so that what is sent to the tasks is bounded by ``pass_terms``.
    """
    spark = items.sparkSession
    send = spark.sparkContext.broadcast
    doc_type = index.shards.schema["ids"].dataType.elementType
    item_type = items.schema[item_key].dataType
    kind = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc", doc_type), T.StructField("score", T.LongType())])
    names = T.StructType([T.StructField("item", T.LongType()), T.StructField(item_key, item_type)])
    arrow = to_arrow_type(doc_type)
    out = spark.createDataFrame([], T.StructType([names[item_key], T.StructField("rank", T.IntegerType()), T.StructField(key, doc_type), T.StructField("score", T.LongType())]))
    for ids, numbers, terms in _passes(items, item_key, pass_terms):
        asked = np.unique(terms)
        counted = index.shards.select("terms", "df").mapInArrow(_frequencies(send(asked.tobytes())), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        rows = counted.collect()  # a number for each asked term at most
        known = np.array([r["term"] for r in rows], dtype=np.int64).view(np.uint64)
        weights = term_weights(np.array([r["df"] for r in rows]), index.documents)
        order = np.argsort(known)
        known, weights = known[order], weights[order]
        place = np.minimum(np.searchsorted(known, terms), max(len(known) - 1, 0))
        live = known[place] == terms if len(known) else np.zeros(len(terms), dtype=bool)
        live[live] = weights[place[live]] > 0
        sent = send((numbers[live], terms[live], weights[place[live]]))
        hits = index.shards.mapInArrow(_search(sent, arrow, index.documents, index.terms, best), kind)
        place_of = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
        ranked = hits.withColumn("rank", F.row_number().over(place_of)).where(F.col("rank") <= best)
        named = spark.createDataFrame(list(enumerate(ids)), names)
        ranked = ranked.join(named, "item").select(item_key, "rank", F.col("doc").alias(key), "score")
        out = out.unionByName(stored(ranked, "hits"))
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), asked AS (
    SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
    FROM benchmark
), collection AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, sum(len(w)) AS total FROM words),
postings AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM words)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), collection
), scored AS (
    SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term), collection GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
