"""Document fingerprints: SimHash of weighted word shingles, permuted block tables, neighbours in key order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_words import NOT_BLANK, distinct_by_row, mix, shingles, text_blocks, word_hashes
from .tables import read_table, stored, text_or_empty

BITS = 256
#: A term is a stretch of so many words.
TERM_WORDS = 2
#: Unlike bits of 256 up to which near_docs counts a document: nearly all texts of a five-word Jaccard likeness of 0.8.
RADIUS = 38
#: Blocks of a 64-bit word; table_keys pairs the blocks of all four words.
WORD_BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints of a block, tasks that compare blocks at most, queries that a task compares at a time.
BLOCK, BLOCK_TASKS, STRIP = 16_384, 4096, 8
_LOW_BITS = np.uint64(0x0101010101010101)


def fingerprints(batch: pa.RecordBatch, column: str = "text", bits: int = BITS) -> np.ndarray:
    """SimHash of every whole text of a batch as rows of bits / 8 bytes.

    Terms are stretches of two words (A-Z lower-cased; a single word is its own term), weighing the root of
    how often they occur. Each bit of a term's hash votes with its sign; a bit is 1 when the votes for it
    are positive. Texts without words have all bits 0.
    """
    out = np.zeros((batch.num_rows, bits // 8), dtype=np.uint8)
    for first, end, buf, offsets in text_blocks(batch, column, 1_000_000):
        words, counts = word_hashes(buf, offsets, NOT_BLANK)
        terms, times, sizes = distinct_by_row(*shingles(words, counts, TERM_WORDS))
        row = np.repeat(np.arange(end - first), sizes)
        once = times == 1
        votes = np.zeros((end - first, bits))
        _count_votes(votes, terms[once], row[once])
        for lo in range(0, np.count_nonzero(~once), 20_000):
            some = np.flatnonzero(~once)[lo : lo + 20_000]
            weighted = np.sqrt(times[some]).astype(np.float32)[:, None] * (2 * _term_bits(terms[some], bits).astype(np.float32) - 1)
            own, at = np.unique(row[some], return_index=True)
            votes[own] += np.add.reduceat(weighted, at, axis=0)
        out[first:end] = np.packbits(votes > 0, axis=1)
    return out


def _term_bits(terms: np.ndarray, bits: int) -> np.ndarray:
    """0/1 bytes: so many hash bits of each term."""
    with np.errstate(over="ignore"):
        hashed = np.stack([mix(terms + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for w in range(bits // 64)], axis=1)
    return np.unpackbits(hashed.view(np.uint8).reshape(len(terms), bits // 8), axis=1)


def _term_lanes(terms: np.ndarray, bits: int) -> np.ndarray:
    """The same bits as bytes of 64-bit words, so that eight are added at a time: by word of the hash, bit in the byte, byte."""
    with np.errstate(over="ignore"):
        hashed = np.stack([mix(terms + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for w in range(bits // 64)], axis=1)
    return ((hashed[:, :, None] >> np.arange(8, dtype=np.uint64)) & _LOW_BITS).reshape(len(terms), bits // 8)


def _count_votes(votes: np.ndarray, terms: np.ndarray, row: np.ndarray, step: int = 20_000) -> None:
    """Add one vote for each bit of each term: ones less zeros, counted in bytes over stretches of up to 255 terms."""
    bits = votes.shape[1]
    for lo in range(0, len(terms), step):
        own = row[lo : lo + step]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        lengths = np.diff(np.append(starts, len(own)))
        parts = -(-lengths // 255)
        part_row = np.repeat(np.arange(len(starts)), parts)
        nth = np.arange(len(part_row)) - np.repeat(np.cumsum(parts) - parts, parts)
        lanes = np.add.reduceat(_term_lanes(terms[lo : lo + step], bits), starts[part_row] + 255 * nth, axis=0)
        # Back into the order of _term_bits: bytes of a word, highest bit first.
        ones = lanes.view(np.uint8).reshape(-1, bits // 64, 8, 8)[:, :, ::-1].transpose(0, 1, 3, 2).reshape(-1, bits)
        ones = np.add.reduceat(ones.astype(np.int64), np.cumsum(parts) - parts, axis=0)
        votes[own[starts]] += 2 * ones - lengths[:, None]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the angle that the share of unlike bits stands for, 0 at least, by row; 1 for equal rows."""
    unlike = np.unpackbits(a ^ b, axis=1).sum(axis=1) / (8 * a.shape[1])
    return np.maximum(0.0, np.cos(np.pi * unlike))


def _hex(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().hex() for r in rows], pa.string())


def _prints(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), _hex(fingerprints(batch, "text", bits))], names=["id", "fingerprint"])

    return run


def fingerprint_documents(docs: DataFrame, bits: int = BITS, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key and fingerprint (lowercase hex); null texts count as empty."""
    rows = docs.select(F.col(key).alias("id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_prints(bits), f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", key)


def _chunks(fingerprint: Column, bits: int, blocks: int) -> list[Column]:
    """The fingerprint's hex digits cut into blocks of like length."""
    digits = bits // 4
    cuts = [digits * i // blocks for i in range(blocks + 1)]
    return [F.substring(fingerprint, a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def hamming(a: Column, b: Column, bits: int) -> Column:
    """Number of unlike bits of two hex fingerprints."""
    total = F.lit(0)
    for at in range(0, bits // 4, 8):
        x, y = (F.conv(F.substring(c, at + 1, 8), 16, 10).cast("long") for c in (a, b))
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 7, bits: int = BITS) -> DataFrame:
    """All (query, fingerprint, distance) with at most ``radius`` unlike bits.

    Both frames have a column fingerprint; equal ones are joined once. A fingerprint is cut into radius + 1
    blocks and enters one table per block, led by that block: two fingerprints within the radius agree in one
    block at least. A pair is reported by the first table that brings it together. Blocks are joined as
    keys, so frequent blocks are split by Spark's handling of skewed joins; nothing is capped.
    """
    blocks = radius + 1
    tables = lambda f: F.explode(F.array(*[F.struct(F.lit(i).alias("t"), b.alias("block")) for i, b in enumerate(_chunks(f, bits, blocks))]))
    every = prints.select("fingerprint").distinct().select("fingerprint", tables(F.col("fingerprint")).alias("k")).select("fingerprint", "k.t", "k.block")
    asked = queries.select(F.col("fingerprint").alias("query")).distinct().select("query", tables(F.col("query")).alias("k")).select("query", "k.t", "k.block")
    first = F.lit(blocks)
    for i, (a, b) in reversed(list(enumerate(zip(_chunks(F.col("query"), bits, blocks), _chunks(F.col("fingerprint"), bits, blocks), strict=True)))):
        first = F.when(a == b, F.lit(i)).otherwise(first)
    distance = hamming(F.col("query"), F.col("fingerprint"), bits)
    joined = asked.alias("q").join(every.alias("e"), (F.col("q.t") == F.col("e.t")) & (F.col("q.block") == F.col("e.block")) & (distance <= radius) & (first == F.col("q.t")))
    return joined.select("query", "fingerprint", distance.alias("distance"))


def block_masks() -> list[tuple[int, int, int]]:
    """(word, shift, bits) of each block."""
    return [(w, sum(WORD_BLOCKS[:i]), bits) for w in range(BITS // 64) for i, bits in enumerate(WORD_BLOCKS)]


def table_keys(words: np.ndarray) -> np.ndarray:
    """A key per table for each row of four words: the table's two blocks and their numbers, nothing hashed."""
    blocks = np.stack([(words[:, w] >> np.uint64(at)) & np.uint64((1 << bits) - 1) for w, at, bits in block_masks()], axis=1).astype(np.int64)
    a, b = np.triu_indices(blocks.shape[1], 1)
    return (a << 37) | (b << 32) | (blocks[:, a] << 16) | blocks[:, b]


def _print_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hex fingerprints as rows of up to BLOCK fingerprints in bytes, numbered."""
    part, number, held = TaskContext.get().partitionId(), 0, []
    block = lambda: pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([bytes.fromhex("".join(held))], pa.binary())], names=["block", "prints"])
    for batch in batches:
        held += batch.column(0).to_pylist()
        while len(held) >= BLOCK:
            held, rest = held[:BLOCK], held[BLOCK:]
            yield block()
            held, number = rest, number + 1
    if held:
        yield block()


def _near_in_blocks(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None
        for batch in batches:
            for side, prints in zip(batch.column("side").to_pylist(), batch.column("prints"), strict=True):
                rows = np.frombuffer(prints.as_py(), dtype=np.uint8).reshape(-1, BITS // 8)
                if side == 0:
                    asked = rows
                    continue
                columns = np.ascontiguousarray(rows.view(np.uint64).T)
                words = asked.view(np.uint64)
                unlike = np.empty((STRIP, len(rows)), dtype=np.uint64)
                for at in range(0, len(asked), STRIP):
                    some = words[at : at + STRIP]
                    apart = np.zeros((len(some), len(rows)), dtype=np.int16)
                    for w in range(BITS // 64):
                        np.bitwise_xor(some[:, w][:, None], columns[w], out=unlike[: len(some)])
                        apart += np.bitwise_count(unlike[: len(some)])
                    found = np.flatnonzero((apart <= radius) & (apart > 0))
                    if len(found):
                        q, e = np.divmod(found, len(rows))
                        yield pa.RecordBatch.from_arrays([_hex(asked[at + q]), _hex(rows[e]), pa.array(apart.ravel()[found].astype(np.int32))], names=["query", "fingerprint", "distance"])

    return run


def near_prints(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All (query, fingerprint, distance): 256-bit fingerprints that differ in 1 to ``radius`` bits.

    At such a radius no blocks of bits must agree that would be selective, so every query is compared with
    every distinct fingerprint: both are packed into blocks, and a task compares two blocks at a time. The work
    grows with queries times fingerprints, memory does not; nothing is left out.
    """
    packed = {}
    for name, frame in (("asked", queries), ("held", prints)):
        rows = stored(frame.select("fingerprint").distinct(), f"{name}-prints")
        whole = rows.coalesce(max(1, -(-rows.count() // BLOCK)))
        packed[name] = stored(whole.mapInArrow(_print_blocks, "block long, prints binary"), f"{name}-blocks")
    numbers = lambda name, i: packed[name].select(F.col("block").alias(i))
    pairs = stored(numbers("asked", "i").crossJoin(numbers("held", "j")), "block-pairs")
    tasks = max(1, min(BLOCK_TASKS, pairs.count()))
    sides = [
        packed[name].join(pairs, F.col("block") == F.col(i)).select("i", "j", F.lit(side).alias("side"), "prints") for side, (name, i) in enumerate((("asked", "i"), ("held", "j")))
    ]
    meeting = sides[0].unionByName(sides[1]).repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "side")
    return meeting.mapInArrow(_near_in_blocks(radius), "query string, fingerprint string, distance int")


_EDIT_SCHEMA = (
    "kind string, part int, doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
)
_NAMES = ["kind", "part", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text"]


def edit_texts(own: pa.Array, following: pa.Array) -> pa.Array:
    """Each text with its last floor(n / 2) characters replaced by as many first ones (or all) of the next."""
    sizes = pc.utf8_length(own).to_numpy(zero_copy_only=False)
    out = []
    for text, n, other in zip(own.to_pylist(), sizes.tolist(), following.to_pylist(), strict=True):
        out.append(text[: n - n // 2] + other[: n // 2])
    return pa.array(out, pa.string())


def _compare(ids: pa.Array, own: pa.Array, following: pa.Array, part: int, bits: int, prints: np.ndarray, next_prints: np.ndarray) -> pa.RecordBatch:
    edited = edit_texts(own, following)
    changed = fingerprints(pa.RecordBatch.from_arrays([edited], names=["text"]), "text", bits)
    n = len(ids)
    hashes = [hashlib.sha256(t.encode()).hexdigest() for t in edited.to_pylist()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(["row"] * n), pa.array([part] * n, pa.int32()), ids, pc.cast(pc.utf8_length(own), pa.int64()), pa.array(hashes, pa.string()), _hex(prints), _hex(changed),
            pa.array(likeness(prints, changed)), pa.array(likeness(prints, next_prints)), pa.nulls(n, pa.string()),
        ],
        names=_NAMES,
    )


def _edge(kind: str, part: int, ids: pa.Array, text: pa.Array) -> pa.RecordBatch:
    none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([part], pa.int32()), ids, *none, pc.cast(text, pa.string())], names=_NAMES)


def _neighbours(bits: int, step: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                if held is None:
                    yield _edge("first", part, batch.column("id").slice(0, 1), batch.column("text").slice(0, 1))
                else:
                    batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                n = batch.num_rows
                if n > 1:
                    prints = fingerprints(batch, "text", bits)
                    text = batch.column("text")
                    yield _compare(batch.column("id").slice(0, n - 1), text.slice(0, n - 1), text.slice(1), part, bits, prints[:-1], prints[1:])
                held = batch.slice(n - 1)
        if held is not None:
            yield _edge("last", part, held.column("id"), held.column("text"))

    return run


def _across(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, following = batch.column("text"), batch.column("following")
            prints = fingerprints(batch, "text", bits)
            other = fingerprints(batch, "following", bits)
            yield _compare(batch.column("doc_id"), own, following, 0, bits, prints, other)

    return run


def compare_with_edits(docs: DataFrame, bits: int = BITS, key: str = "doc_id") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and their likeness to the edited and the next text.

    Rows follow each other by descending key, null keys last, equal keys by text; after the last comes the
    first. Texts are shuffled once, into key ranges; each task streams its range. Only the first and last
    row of each range are compared afterwards, so no range is ever in one piece. A single row is its own
    next. Null texts count as empty; two texts without words have likeness 1.
    """
    rows = docs.select(F.col(key).alias("id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange(F.col("id").desc_nulls_last()).sortWithinPartitions(F.col("id").desc_nulls_last(), "text")
    kind = _EDIT_SCHEMA.format(id=rows.schema["id"].dataType.simpleString())
    found = stored(ordered.mapInArrow(_neighbours(bits), kind), "edits")
    edges = found.where("kind <> 'row'")
    # One number per key range reaches the driver.
    parts = sorted(r["part"] for r in edges.where("kind = 'first'").select("part").collect())
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    result = found.where("kind = 'row'").select(*out)
    if parts:
        follows = F.create_map(*[F.lit(p) for a, b in zip(parts, [*parts[1:], parts[0]], strict=True) for p in (a, b)])
        last = edges.where("kind = 'last'").select("doc_id", "text", F.element_at(follows, F.col("part")).alias("at"))
        first = edges.where("kind = 'first'").select(F.col("part").alias("at"), F.col("text").alias("following"))
        result = result.unionByName(last.join(first, "at").select("doc_id", "text", "following").mapInArrow(_across(bits), kind).select(*out))
    return result.withColumnRenamed("doc_id", key)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also near_docs: for ids divisible by 20, how many other documents' fingerprints near_prints finds within 38 bits, equal ones included."""
    found = stored(compare_with_edits(read_table(spark, sf_dir, "documents")), "fingerprints")
    sizes = found.groupBy("fingerprint").agg(F.count("*").alias("docs"))
    queries = found.where(F.col("doc_id") % 20 == 0).select("fingerprint").distinct()
    unlike = near_prints(sizes, queries).join(sizes, "fingerprint").groupBy("query").agg(F.sum("docs").alias("near"))
    equal = sizes.join(queries, "fingerprint", "left_semi").select("fingerprint", F.col("docs") - 1)
    every = unlike.select(F.col("query").alias("fingerprint"), F.col("near").alias("near_docs")).unionAll(equal)
    counted = every.groupBy("fingerprint").agg(F.sum("near_docs").alias("near_docs")).select("fingerprint", F.lit(0).cast("long").alias("m"), "near_docs")
    asked = found.withColumn("m", F.col("doc_id") % 20).join(counted, ["fingerprint", "m"], "left")
    return asked.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_docs")
