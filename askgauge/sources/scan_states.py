"""Records of files that may be cut anywhere, found with scan states that compose.

A file is read in short pieces by the splitting text reader: lines for CSV, stretches
up to a closing brace for JSON.  Whether a piece starts inside quotes depends on all
text before it, so each piece says what it makes of either state, and how far it moves
the nesting depth in either case.  Blocks are summed up for both states, the sums are
chained along a file (one row per block), and every block then knows the state it
starts in and cuts its own records.  Text moves only for records that cross a block
border.  Blocks are stored as chunks of some thousand pieces, which count as blocks
from there on.  A record is held as one string: a value whose quote never closes
takes in the rest of its file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askgauge.session import cut_lineage, small_side

MAX_BLOCKS_SENT = 1_000_000

# How the steps of a stretch of pieces are packed.
_STEPS = {"step": "<i1", "rise_0": "<i4", "rise_1": "<i4"}
_CHUNK = "_file string, _block long, end_0 long, end_1 long, sum_0 long, sum_1 long, step binary, rise_0 binary, rise_1 binary, pieces string"
_CHUNK_NAMES = [field.split()[0] for field in _CHUNK.split(", ")]

# One CSV field and its closing comma; a quote opens a value only at the start of a field.
CSV_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|),'
CSV_OPEN_VALUE = r'"(?:[^"]++|"")*+$'
JSON_STRING = r'(?s)"(?:[^"\\]++|\\.)*+"'
# The rest of a string that an earlier piece began, up to its closing quote.
JSON_STRING_END = r'(?s)^(?:[^"\\]++|\\.)*+"'


def _csv_step(line: Column) -> tuple[Column, Column, Column]:
    """Step and depth moves of a line.  Bit 1 of the step: a line that starts a record
    ends inside quotes; bit 2: a line that starts inside quotes ends there."""
    from_start = line.rlike(rf"^(?:{CSV_FIELD})*+{CSV_OPEN_VALUE}")
    from_quoted = line.rlike(r'^(?:[^"]++|"")*+$') | line.rlike(
        rf'^(?:[^"]++|"")*+"[^,]*+,(?:{CSV_FIELD})*+{CSV_OPEN_VALUE}'
    )
    plain = ~line.contains('"')
    step = F.when(plain, 2).otherwise(from_start.cast("int") + 2 * from_quoted.cast("int"))
    return step, F.lit(0), F.lit(0)


def _json_step(text: Column) -> tuple[Column, Column, Column]:
    """The same for a stretch of JSON and the closing brace that ends it."""

    def outside(piece: Column) -> tuple[Column, Column]:
        bare = F.regexp_replace(piece, JSON_STRING, "")
        kept = F.substring_index(bare, '"', 1)
        open_string = bare.contains('"')
        count = lambda signs: F.length(kept) - F.length(F.translate(kept, signs, ""))
        return open_string, count("{[") - count("]") - F.when(open_string, 0).otherwise(1)

    open_0, rise_0 = outside(text)
    closes = text.rlike(JSON_STRING_END)
    open_1, rise_1 = outside(F.regexp_replace(text, JSON_STRING_END, ""))
    stays = ~closes | open_1
    return open_0.cast("int") + 2 * stays.cast("int"), rise_0, F.when(closes, rise_1).otherwise(0)


def _states(step: np.ndarray, entry: int) -> np.ndarray:
    """State after each piece: the last piece that leaves no choice, turned by the swaps since."""
    turned = np.cumsum(step == 1) & 1
    place = np.arange(len(step))
    fixed = np.maximum.accumulate(np.where((step == 0) | (step == 3), place, -1))
    base = np.where(fixed < 0, entry, (step[fixed] & 1) ^ turned[fixed])
    return base ^ turned


def _moves(pieces: Sequence[np.ndarray], entry: int) -> tuple[np.ndarray, np.ndarray]:
    """State after each piece, and the depth it adds, from the pieces' steps and rises."""
    step, rise_0, rise_1 = pieces
    after = _states(step, entry)
    before = np.concatenate([[entry], after[:-1]])
    return after, np.where(before == 0, rise_0, rise_1)


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """Runs of rows of one block of a file, as (block, first row, row after the last)."""
    files, blocks = batch.column("_file").dictionary_encode(), batch.column("_block").to_numpy()
    number = files.indices.to_numpy()
    new = np.flatnonzero((np.diff(number) != 0) | (np.diff(blocks) != 0)) + 1
    edges = [0, *new.tolist(), len(blocks)]
    for low, high in zip(edges, edges[1:]):
        if high > low:
            yield (files.dictionary[number[low]].as_py(), int(blocks[low])), low, high


def _pack_chunks(joiner: str):
    """One row per stretch of pieces of a block: the pieces, joined by what cut them, their steps, and end state and depth added for either state at its start.

    A piece has a byte at least, so the block's start and the number of a stretch's first piece add up to a place of its own.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number = None, 0
        for batch in batches:
            rows = []
            for here, low, high in _stretches(batch):
                key, number = here, number if here == key else 0
                pieces = [batch.column(n).to_numpy()[low:high] for n in _STEPS]
                moves = [_moves(pieces, entry) for entry in (0, 1)]
                ends = [int(after[-1]) for after, _ in moves] + [int(rise.sum()) for _, rise in moves]
                steps = [x.astype(k).tobytes() for x, k in zip(pieces, _STEPS.values())]
                rows.append((here[0], here[1] + number, *ends, *steps, joiner.join(batch.column("value").slice(low, high - low).to_pylist())))
                number += high - low
            kinds = [pa.string()] + [pa.int64()] * 5 + [pa.binary()] * 3 + [pa.large_string()]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=_CHUNK_NAMES)

    return pack


def _enter_blocks(sums: DataFrame) -> DataFrame:
    """State and depth at the start of each block: the sums chained along the file."""
    so_far = Window.partitionBy("_file").orderBy("_block")
    step = F.col("end_0") + 2 * F.col("end_1")
    turned = (F.sum((step == 1).cast("int")).over(so_far) % 2).cast("int")
    fixed = F.when(step.isin(0, 3), F.col("end_0").cast("int").bitwiseXOR(turned))
    after = F.coalesce(F.last(fixed, True).over(so_far), F.lit(0)).bitwiseXOR(turned)
    before = F.coalesce(F.lag("after").over(so_far), F.lit(0))
    entered = sums.withColumn("after", after).withColumn("entry", before)
    rise = F.when(F.col("entry") == 0, F.col("sum_0")).otherwise(F.col("sum_1"))
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    return entered.select("_file", "_block", "entry", F.coalesce(F.sum(rise).over(earlier), F.lit(0)).alias("entry_depth"))


def _cut_chunks(level: int, joiner: str):
    """Records of each chunk: a piece ends a record where it leaves state 0 at the given depth."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(n).to_pylist() for n in ("_file", "_block", "entry", "entry_depth", *_STEPS)]
            for at, (file, block, state, depth, *packed) in enumerate(zip(*columns)):
                texts = batch.column("pieces")[at].as_py().split(joiner)
                after, rise = _moves([np.frombuffer(x, dtype=k) for x, k in zip(packed, _STEPS.values())], state)
                depths = depth + np.cumsum(rise)
                begun = block == 0 or (state == 0 and depth == level)
                number, start = 0, 0
                for stop in (np.flatnonzero((after == 0) & (depths == level)) + 1).tolist():
                    text = joiner.join(texts[start:stop])
                    # A blank line between records is none.
                    if text.strip() or not begun:
                        rows.append((file, block, number, text, begun, True))
                        number += 1
                    start, begun = stop, True
                if start < len(texts):
                    rows.append((file, block, number, joiner.join(texts[start:]), False, False))
            yield _records_batch(rows)

    return cut


def _records_batch(rows: Sequence[tuple]) -> pa.RecordBatch:
    names = ["_file", "_block", "_number", "text", "_whole", "ended"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.large_string(), pa.bool_(), pa.bool_()]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)


def _records(pieces: DataFrame, steps: tuple[Column, Column, Column], level: int, joiner: str) -> DataFrame:
    step, rise_0, rise_1 = steps
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    marked = pieces.select("value", *place, step.cast("int").alias("step"), rise_0.cast("int").alias("rise_0"), rise_1.cast("int").alias("rise_1"))
    # Stored as chunks: a piece of its own row would carry the path of its file.
    chunks = cut_lineage(marked.mapInArrow(_pack_chunks(joiner), _CHUNK))
    blocks = cut_lineage(_enter_blocks(chunks.select("_file", "_block", "end_0", "end_1", "sum_0", "sum_1")))
    placed = chunks.join(F.broadcast(blocks) if blocks.count() <= MAX_BLOCKS_SENT else blocks, ["_file", "_block"])
    cut = cut_lineage(
        placed.select("_file", "_block", "entry", "entry_depth", *_STEPS, "pieces").mapInArrow(
            _cut_chunks(level, joiner),
            "_file string, _block long, _number long, text string, _whole boolean, ended boolean",
        )
    )
    # A block's open record has the number after its last one, and the next block's first part number 0.
    along = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("_file", "_block")
        .agg(F.coalesce(F.max(F.when(F.col("ended"), F.col("_number") + 1)), F.lit(0)).alias("_n"))
        .select("_file", "_block", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_start"))
    )
    numbered = cut.join(small_side(starts), ["_file", "_block"]).withColumn("line_no", F.col("_start") + F.col("_number"))
    parts = F.array_sort(F.collect_list(F.struct("_block", "text")))
    crossing = (
        numbered.filter("not _whole")
        .groupBy("_file", "line_no")
        .agg(F.array_join(F.transform(parts, lambda p: p["text"]), joiner).alias("text"), F.max("ended").alias("ended"))
    )
    return numbered.filter("_whole").select("_file", "line_no", "text", "ended").unionByName(crossing.select("_file", "line_no", "text", "ended"))


def csv_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``_file, line_no, text`` of CSV records whose quoted values may hold line breaks.

    ``line_no`` counts the records of a file from 0; blank lines between records are none.
    A quote opens a value at the start of a field only, and a doubled quote inside stays in it.
    Line breaks inside values are kept as they are.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select("value", "_metadata")
    found = _records(lines, _csv_step(F.col("value")), 0, "\n")
    return found.select("_file", "line_no", F.regexp_replace("text", r"\r\z", "").alias("text"))


def array_objects(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``_file, line_no, text`` of the objects of files that hold one JSON array each.

    Anything but objects, commas between them and the two brackets raises when the rows are
    read.  A blank file has no objects.
    """
    pieces = spark.read.option("lineSep", "}").text(paths).select("value", "_metadata")
    found = _records(pieces, _json_step(F.col("value")), 1, "}")
    text, first = F.col("text"), F.col("line_no") == 0
    # What stands before an object, or after the last.
    lead = F.when(F.col("ended"), F.regexp_extract(text, r"^[^{]*", 0)).otherwise(text)
    wanted = F.when(F.col("ended"), F.when(first, r"^\s*\[\s*$").otherwise(r"^\s*,\s*$")).otherwise(
        F.when(first, r"^\s*(\[\s*\]\s*)?$").otherwise(r"^\s*\]\s*$")
    )
    closed = found.groupBy("_file").agg(F.max((~F.col("ended")).cast("int")).alias("closed")).filter("closed = 0")
    unclosed = small_side(closed.select("_file", F.lit(True).alias("_unclosed")))
    problem = F.raise_error(F.concat(F.lit("no array of objects: "), "_file", F.lit(", object "), F.col("line_no").cast("string")))
    checked = found.join(unclosed, "_file", "left").withColumn(
        "text",
        F.when(~F.regexp_like(lead, wanted) | F.coalesce("_unclosed", F.lit(False)), problem.cast("string")).when(
            F.col("ended"), F.concat(F.regexp_replace(text, r"^[^{]*", ""), F.lit("}"))
        ),
    )
    return checked.filter("text is not null").select("_file", "line_no", "text")
