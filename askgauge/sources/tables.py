"""Tables as cells: many unlike tables in one long frame.

A cell is ``table_id, row_idx, col_idx, col_name, value``.  ``row_idx`` orders
the rows of a table; it is dense for files and may be any ordering key for
tables that already have one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgauge.session import small_side
from askgauge.sources.lines import dense_position, mark_position
from askgauge.sources.scan_states import csv_records

CELL_COLUMNS = ("table_id", "row_idx", "col_idx", "col_name", "value")
WIKI_TABLE_SCHEMA = "id string, header array<string>, rows array<array<string>>"
# Texts that a data frame reader takes for a missing value.
MISSING_MARKS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def discover_csv_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Every ``*.csv`` below the roots, each path once, in path order."""
    scan = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(list(roots))
    )
    return scan.select("path", "length").dropDuplicates(["path"]).orderBy("path")


def csv_to_cells(
    spark: SparkSession,
    paths: Sequence[str],
    max_columns: int | None = None,
    multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Cells of many CSV files with unlike headers, and the files that could not be read.

    All files go through one scan with a schema as wide as the widest line
    (or ``max_columns``).  The first record of each file is its header.  A file
    is left out, with an error row, when a record has more fields than its
    header or the header more than ``max_columns``; nothing is cut off.  Set
    ``multi_line`` for values that contain line breaks; files split into blocks
    either way.
    """
    options = {"header": "false", "escape": '"', "emptyValue": "", "nullValue": "\u0000", "mode": "PERMISSIVE"}
    lines = csv_records(spark, list(paths)) if multi_line else None
    if max_columns is None:
        plain = spark.read.text(list(paths)).select("value") if lines is None else lines.select(F.col("text").alias("value"))
        max_columns = plain.agg(F.max(F.size(F.split("value", ",")))).head()[0] or 1
    # One column more than allowed, so that a wider record shows.
    names = [f"_c{i}" for i in range(max_columns + 1)]
    wide = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # Trailing nulls are fields the record does not have.
    last = F.array_max(F.transform("fields", lambda v, i: F.when(v.isNotNull(), i + 1).otherwise(0)))
    if lines is None:
        scan = spark.read.schema(wide).options(**options).csv(list(paths))
        packed = scan.select(F.array(*names).alias("fields"), "_metadata").select(
            F.slice("fields", F.lit(1), last).alias("fields"), "_metadata"
        )
        numbered = dense_position(mark_position(packed).drop("_metadata"))
    else:
        parsed = lines.select("_file", "line_no", F.from_csv("text", ", ".join(f"{n} string" for n in names), options).alias("r"))
        numbered = parsed.select("_file", "line_no", F.array(*[F.col("r")[n] for n in names]).alias("fields")).select(
            "_file", "line_no", F.slice("fields", F.lit(1), last).alias("fields")
        )
    headers = small_side(
        numbered.filter("line_no = 0").select("_file", _unique_names("fields").alias("header")), 100_000
    )
    body = numbered.filter("line_no > 0").join(headers, "_file")
    wide_headers = headers.filter(F.size("header") > max_columns).select(
        F.col("_file").alias("table_id"), F.lit("header has too many fields").alias("error")
    )
    wide_records = (
        body.filter(F.size("fields") > F.size("header"))
        .groupBy(F.col("_file").alias("table_id"))
        .agg(F.min("line_no").alias("line_no"))
        .select("table_id", F.concat(F.lit("record "), "line_no", F.lit(" has too many fields")).alias("error"))
    )
    errors = small_side(wide_records.unionByName(wide_headers))
    value = F.get("fields", F.col("col_idx"))
    cells = (
        body.withColumnRenamed("_file", "table_id")
        .join(errors.select("table_id"), "table_id", "left_anti")
        .select(
            "table_id",
            (F.col("line_no") - 1).alias("row_idx"),
            F.posexplode("header").alias("col_idx", "col_name"),
            "fields",
        )
        .withColumn("value", F.when(~value.isin(MISSING_MARKS), value))
    )
    return cells.select(*CELL_COLUMNS), errors


def with_running_suffix(names: Column, joiner: str) -> Column:
    """Make the names of an array distinct: a repeat gets the number of earlier ones, or the
    next number whose name is still free.  The first of equal names keeps its own."""

    def add(done: Column, name: Column) -> Column:
        numbered = lambda k: F.concat_ws(joiner, name, k.cast("string"))
        # Among so many numbers one is free: at most all names are taken.
        tries = F.sequence(F.lit(1), F.size(names) + 1)
        repeats = F.size(F.filter(F.slice(names, 1, F.size(done)), lambda other: other == name))
        free = F.filter(tries, lambda k: (k >= repeats) & ~F.array_contains(done, numbered(k)) & ~F.array_contains(names, numbered(k)))
        taken = (repeats > 0) | F.array_contains(done, name)
        return F.array_append(done, F.when(taken, numbered(F.get(free, F.lit(0)))).otherwise(name))

    return F.aggregate(names, F.array().cast("array<string>"), add)


def _unique_names(header: str) -> Column:
    """Blank headers get a position name; repeated headers a running suffix."""
    named = F.transform(
        header,
        lambda h, i: F.when(
            F.coalesce(h, F.lit("")) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))
        ).otherwise(h),
    )
    return with_running_suffix(named, ".")


def load_first_tables(
    spark: SparkSession, roots: Sequence[str], max_tables: int | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """Cells of all CSV files below the roots, or of the first ``max_tables`` by path."""
    listed = discover_csv_files(spark, roots)
    if max_tables is not None:
        listed = listed.limit(max_tables)
    return csv_to_cells(spark, [row["path"] for row in listed.collect()], **options)


def wikisql_errors(tables: DataFrame) -> DataFrame:
    """``table_id, error`` of the records with a row longer than their header."""
    long = F.exists("rows", lambda r: F.coalesce(F.size(r) > F.size("header"), F.lit(False)))
    return tables.filter(long).select(F.col("id").alias("table_id"), F.lit("a row has too many fields").alias("error"))


def wikisql_to_cells(tables: DataFrame) -> DataFrame:
    """Cells of records that hold a whole table each.

    A record with a row longer than its header is left out as a whole, as with CSV files;
    ``wikisql_errors`` names it.
    """
    long = F.exists("rows", lambda r: F.coalesce(F.size(r) > F.size("header"), F.lit(False)))
    tables = tables.filter(~F.coalesce(long, F.lit(False)))
    rows = tables.select("id", "header", F.posexplode("rows").alias("row_idx", "fields"))
    cells = rows.select(
        F.col("id").alias("table_id"),
        F.col("row_idx").cast("bigint").alias("row_idx"),
        "fields",
        F.posexplode("header").alias("col_idx", "col_name"),
    )
    return cells.withColumn("value", F.get("fields", F.col("col_idx"))).select(*CELL_COLUMNS)


def read_wikisql_cells(spark: SparkSession, path: str) -> DataFrame:
    return wikisql_to_cells(spark.read.schema(WIKI_TABLE_SCHEMA).json(path))


def cell_text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string")


def table_to_cells(
    df: DataFrame,
    table_id: str,
    row_idx: Column,
    text: Callable[[DataFrame, str], Column] = cell_text,
) -> DataFrame:
    """Unpivot one table in a single narrow pass; ``text`` says how a column reads as text.

    Rows are multiplied first and the value picked by position afterwards: a
    query that does not look at the values then reads only the row key.
    """
    names = F.array(*[F.lit(n) for n in df.columns])
    spot = F.col("col_idx")
    value = F.when(spot == 0, text(df, df.columns[0]))
    for i, name in enumerate(df.columns[1:], start=1):
        value = value.when(spot == i, text(df, name))
    return df.select("*", F.posexplode(names).alias("col_idx", "col_name")).select(
        F.lit(table_id).alias("table_id"), row_idx.cast("bigint").alias("row_idx"), "col_idx", "col_name", value.alias("value")
    )


def union_cells(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
