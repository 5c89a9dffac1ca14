"""Token-id output: whole texts as Simple-8b coded ids in Parquet files, and reading them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import simple8b
from .byte_words import give_back
from .piece_tokens import PieceTokenizer
from .tables import read_table, text_or_empty

#: One row of the files: the documents of one stretch of text and their ids, coded together.
FILE_SCHEMA = "shard int, start long, n_ids long, doc_ids array<long>, lengths array<long>, block_words binary, words binary"
def _coder(path: str, end_id: int | None):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, shard, start = PieceTokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column(0)
            for first, end, ids, counts in tokenizer.encode(batch, "text"):
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                words, offsets = simple8b.encode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int32()),
                        pa.array([start], pa.int64()),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([keys.slice(first, end - first)], pa.list_(pa.int64())),
                        pa.array([counts], pa.list_(pa.int64())),
                        pa.array([offsets.astype("<u4").tobytes()], pa.binary()),
                        pa.array([words.astype("<u8").tobytes()], pa.binary()),
                    ],
                    names=["shard", "start", "n_ids", "doc_ids", "lengths", "block_words", "words"],
                )
                start += len(ids)
        give_back()

    return code


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, key: str = "doc_id") -> None:
    """Encode every whole text and write the ids in ascending key order.

    Rows are range-partitioned by key, each task streams its rows in order (null keys first, equal keys by
    text) and writes rows of FILE_SCHEMA: about 1 MB of text each, its ids coded by ``simple8b`` in blocks of
    1024, ``block_words`` (unsigned 32-bit) giving each block's first word. ``start`` counts ids within the
    shard, shards follow key order. Null and empty texts have the end id only. Other columns take no part.
    The tokenizer file must lie at the same path on every executor; a row takes up one text at least.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    ordered.mapInArrow(_coder(tokenizer_path, end_id), FILE_SCHEMA).write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start`` counted over all shards; only one count per shard reaches the driver."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = dict(rows.groupBy("shard").agg(F.sum("n_ids")).collect())
    before, total = [], 0
    for shard in sorted(sizes):
        before.append((shard, total))
        total += sizes[shard]
    return rows.join(F.broadcast(spark.createDataFrame(before, "shard int, before long")), "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")


def decoded_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(start, keys, ids per key, ids) of every row of the files."""
    for row in range(batch.num_rows):
        get = lambda name, row=row: batch.column(name)[row]
        words = np.frombuffer(get("words").as_buffer(), dtype="<u8")
        offsets = np.frombuffer(get("block_words").as_buffer(), dtype="<u4").astype(np.int64)
        ids = simple8b.decode(words, offsets, get("n_ids").as_py())
        yield get("start").as_py(), get("doc_ids").as_py(), get("lengths").values.to_numpy(zero_copy_only=False), ids


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, keys, lengths, ids in decoded_rows(batch):
            raw = ids.astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(start + starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def token_digests(packed: DataFrame) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids)."""
    return packed.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, keys, lengths, ids in decoded_rows(batch):
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], names=["doc_id", "ids"])


def token_ids(packed: DataFrame) -> DataFrame:
    """Per document, decoded from the files: doc_id, ids."""
    return packed.mapInArrow(_unpack, "doc_id long, ids array<long>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    write_ids(read_table(spark, sf_dir, "documents"), path, default_tokenizer())
    return token_digests(read_packed(spark, path))
