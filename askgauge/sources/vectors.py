"""Embedding sets and lists of workload pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors: Parquet with an ``embedding`` column, or JSON lists."""
    if path.rstrip("/").endswith(".json"):
        text = spark.read.text(path, wholetext=True)
        rows = text.select(F.from_json("value", "array<array<float>>").alias("m"))
        return rows.select(F.posexplode("m").alias("vec_id", "embedding")).withColumn(
            "vec_id", F.col("vec_id").cast("bigint")
        )
    return spark.read.parquet(path)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def pair_vectors(
    pairs: DataFrame, vectors: DataFrame, workload_col: str = "workload"
) -> DataFrame:
    """Vectors of both sides of every listed pair: ``pair_id, side, embedding``.

    ``pairs`` is the training list (``pair_id, source, target``), one row per observed
    accuracy; ``vectors`` holds the sets of all workloads under their names.
    """
    sides = pairs.select(
        "pair_id",
        F.inline(
            F.array(
                F.struct(F.lit("source").alias("side"), F.col("source").alias(workload_col)),
                F.struct(F.lit("target").alias("side"), F.col("target").alias(workload_col)),
            )
        ),
    )
    return vectors.join(sides, workload_col).select("pair_id", "side", "embedding")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Training list of ``{source, target, metric}`` objects, numbered in file order."""
    listed = (
        spark.read.schema("source string, target string, metric double")
        .option("multiLine", True)
        .json(path)
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    order = Window.partitionBy(F.lit(0)).orderBy("_seq")
    return listed.withColumn("pair_id", F.row_number().over(order)).drop("_seq")
