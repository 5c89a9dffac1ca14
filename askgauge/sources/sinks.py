"""Reports, datasets, tables and training rows on shared storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askgauge.functions.text import clean_name
from askgauge.operators.cells import table_headers
from askgauge.session import scratch_path, small_side
from askgauge.sources.tables import with_running_suffix


# Cells that one task sorts into the folders of their tables, on average.
STAGED_CELLS = 1_000_000


def write_report(samples: DataFrame, summary: DataFrame, path: str) -> None:
    """Per-record scores and the one-row summary, as JSON lines."""
    samples.write.mode("overwrite").json(f"{path}/samples")
    summary.write.mode("overwrite").json(f"{path}/summary")


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    samples = spark.read.schema("id string, db_id string, execution_accuracy double").json(f"{path}/samples")
    summary = spark.read.schema("execution_accuracy double, num_samples bigint").json(f"{path}/summary")
    return samples, summary


def write_aligned(records: DataFrame, path: str) -> None:
    records.select("id", "db_id", "gold_sql", "pred_sql").write.mode("overwrite").json(path)


def write_dataset(examples: DataFrame, path: str) -> None:
    examples.select("id", "db_id", "question", "gold_sql").write.mode("overwrite").json(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, db_id string, question string, gold_sql string").json(path)


def write_shift_samples(sets: DataFrame, membership: DataFrame, path: str, **settings: int) -> None:
    """Training rows and subset members, the settings repeated as columns of the rows."""
    tagged = sets.withColumns({name: F.lit(value) for name, value in settings.items()})
    tagged.write.mode("overwrite").parquet(f"{path}/sets")
    membership.write.mode("overwrite").parquet(f"{path}/membership")


def table_stems(tables: DataFrame) -> DataFrame:
    """Catalog name of each table: its file stem, numbered where two stems of one database collide.

    A number that would give another table's name is followed by a hash of the table's own id.
    """
    stem = F.regexp_extract(F.col("table_id"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    safe = F.regexp_replace(F.lower(stem), r"[^a-z0-9_]", "_")
    twin = Window.partitionBy("db_id", "stem").orderBy("table_id")
    nth = F.row_number().over(twin)
    numbered = F.when(nth > 1, F.concat_ws("_", "stem", nth.cast("string"))).otherwise(F.col("stem"))
    named = tables.withColumn("stem", safe).withColumn("table_name", numbered)
    shared = F.count(F.lit(1)).over(Window.partitionBy("db_id", "table_name")) > 1
    told = F.concat_ws("_", "table_name", F.substring(F.md5("table_id"), 1, 12))
    return named.withColumn("shared", shared).withColumn(
        "table_name", F.when(F.col("shared") & (F.col("table_name") != F.col("stem")), told).otherwise(F.col("table_name"))
    ).drop("stem", "shared")


def clean_header(header: Column) -> Column:
    """Cleaned column names of one table, with a running suffix where two collide."""
    return with_running_suffix(F.transform(header, clean_name), "_")


def table_view(cells: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    """One table back in wide form from its cells (a single grouped pass)."""
    pick = lambda i: F.max(F.when(F.col("col_idx") == i, F.col("value")))
    return (
        cells.groupBy("row_idx").agg(*[pick(i).alias(name) for i, name in columns]).drop("row_idx")
    )


def typed_view(table: DataFrame) -> DataFrame:
    """Give each text column the narrowest type that every value fits."""
    tests = table.agg(
        *[
            F.struct(
                F.bool_and(F.col(c).isNull() | F.expr(f"try_cast(`{c}` as bigint) is not null")).alias("whole"),
                F.bool_and(F.col(c).isNull() | F.expr(f"try_cast(`{c}` as double) is not null")).alias("real"),
            ).alias(c)
            for c in table.columns
        ]
    ).head()
    kind = lambda c: "bigint" if tests[c]["whole"] else "double" if tests[c]["real"] else "string"
    return table.select(*[F.col(c).cast(kind(c)).alias(c) for c in table.columns])


def materialize_tables(cells: DataFrame, databases: DataFrame, typed: bool = True) -> list[str]:
    """Save every table of every database as a catalog table, replacing older ones.

    ``databases`` holds ``table_id, db_id``.  The list of tables and columns is
    catalog data and is read by the driver; the rows are not.
    """
    spark = cells.sparkSession
    names = table_stems(databases.select("table_id", "db_id"))
    catalog = (
        names.join(table_headers(cells), "table_id")
        .select("db_id", "table_name", clean_header(F.col("header")).alias("columns"))
        .orderBy("db_id", "table_name")
    )
    # One pass sorts the cells into a folder per table; each table then reads its own folder. Tables are
    # cut into as many slots as the cells need, so that no task holds more of a large table than of a small one.
    staged = scratch_path(spark, "tables")
    small = small_side(names)
    placed = cells.join(small, "table_id").select("db_id", "table_name", "row_idx", "col_idx", "value")
    slots = max(8, -(-cells.count() // STAGED_CELLS))
    slot = F.pmod(F.xxhash64("row_idx"), F.lit(slots))
    placed.repartition(slots, "db_id", "table_name", slot).write.partitionBy("db_id", "table_name").parquet(staged)
    saved = []
    for row in catalog.collect():
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{row['db_id']}`")
        folder = f"{staged}/db_id={row['db_id']}/table_name={row['table_name']}"
        one = table_view(
            spark.read.schema("row_idx bigint, col_idx int, value string").parquet(folder),
            list(enumerate(row["columns"])),
        )
        name = f"`{row['db_id']}`.`{row['table_name']}`"
        (typed_view(one) if typed else one).write.mode("overwrite").saveAsTable(name)
        saved.append(f"{row['db_id']}.{row['table_name']}")
    return saved
