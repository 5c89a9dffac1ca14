"""Position of every record inside its file, without sorting whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgauge.session import cut_lineage, small_side


def mark_position(scan: DataFrame) -> DataFrame:
    """Add file path, block start and reading order to a fresh file scan.

    The marks are stored with the records: a second scan could cut the files
    into other blocks when the number of executors has changed in between.
    """
    return cut_lineage(
        scan.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_seq"),
        )
    )


def dense_position(marked: DataFrame, name: str = "line_no") -> DataFrame:
    """Turn the marks into 0-based record numbers per file.

    Reading order is consecutive inside a block, so a record's place there is a
    difference of two numbers.  Only the block totals (one row per block) are
    summed up; records are neither sorted nor shuffled.
    """
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        marked.groupBy("_file", "_block")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        marked.join(small_side(blocks), ["_file", "_block"])
        .withColumn(name, F.col("_start") + F.col("_seq") - F.col("_first"))
        .drop("_start", "_first", "_block", "_seq")
    )
