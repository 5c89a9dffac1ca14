"""Reading the input tables and keeping narrow intermediate results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bit_filter(df: DataFrame, hash_col: str, bits_log2: int = 26) -> bytes:
    """A bitmap of 2**bits_log2 bits with the low bits of every hash set (no false negatives).

    Built in Spark from 4 KB pieces; what reaches the driver is at most 2**bits_log2 / 8 bytes,
    whatever the number of rows. The caller broadcasts it and must treat a hit as "perhaps".
    """
    return bit_filters(df.select(hash_col, F.lit(0).alias("kind")), hash_col, "kind", [bits_log2])[0]


def bit_filters(df: DataFrame, hash_col: str, kind_col: str, bits_log2: list[int]) -> list[bytes]:
    """One such bitmap for each kind 0, 1, ... of rows, of 2**bits_log2[kind] bits, in one pass."""
    mask = F.element_at(F.array(*[F.lit((1 << b) - 1).cast("long") for b in bits_log2]), F.col(kind_col) + 1)
    at = F.col(hash_col).bitwiseAND(mask)
    pieces = (
        df.select(F.col(kind_col).alias("kind"), F.shiftright(at, 15).alias("piece"), at.bitwiseAND(F.lit(32767)).alias("bit"))
        .groupBy("kind", "piece")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = [bytearray(1 << (b - 3)) for b in bits_log2]
    for row in pieces.toLocalIterator():
        out[row["kind"]][row["piece"] * 4096 : (row["piece"] + 1) * 4096] = row["bits"]
    return [bytes(x) for x in out]
