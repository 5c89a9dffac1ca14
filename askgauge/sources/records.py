"""Gold, prediction and instruction records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgauge.functions.schema_text import SCHEMA_TYPE, record_prompt
from askgauge.functions.text import filled, first_filled, or_blank
from askgauge.sources.lines import dense_position, mark_position
from askgauge.sources.scan_states import array_objects

RECORD_SCHEMA = (
    "id string, db_id string, question string, text string, sql string, query string,"
    f" gold_sql string, pred_sql string, prediction string, schema {SCHEMA_TYPE}"
)
# Field names under which each dataset stores its gold and predicted query.
DATASET_FIELDS = {
    "spider": {"gold": ("gold_sql", "query", "sql"), "pred": ("pred_sql", "prediction", "query")},
    "spider2": {"gold": ("gold_sql", "query", "sql"), "pred": ("pred_sql", "prediction", "query")},
    "bird": {"gold": ("gold_sql", "query", "sql"), "pred": ("pred_sql", "prediction", "query")},
    "wikisql": {"gold": ("gold_sql", "query", "sql"), "pred": ("pred_sql", "prediction", "query")},
    "sparc": {"gold": ("gold_sql", "query", "sql"), "pred": ("pred_sql", "prediction", "query")},
    "cosql": {"gold": ("gold_sql", "query", "sql"), "pred": ("pred_sql", "prediction", "query")},
}


def read_records(
    spark: SparkSession, path: str | Sequence[str], schema: str = RECORD_SCHEMA, mode: str = "FAILFAST"
) -> DataFrame:
    """JSON lines with a fixed schema; absent fields are null."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_json_array(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str = RECORD_SCHEMA,
    limit: int | None = None,
) -> DataFrame:
    """Objects of a top-level JSON array; malformed input raises.

    A large file is cut into blocks like any other: see :func:`array_objects`; objects that cross a
    block border come after the others.  ``limit`` keeps the first objects: files in the order of
    their paths, then by place in the file.
    """
    placed = _array_records(spark, path, schema)
    if limit is not None:
        placed = placed.orderBy("_file", "line_no").limit(limit)
    return placed.drop("_file", "line_no")


def _array_records(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    record = F.from_json("text", schema, {"mode": "FAILFAST"})
    return array_objects(spark, path).select("_file", "line_no", record.alias("r")).select("_file", "line_no", "r.*")


def array_to_lines(spark: SparkSession, path: str, out: str, schema: str = RECORD_SCHEMA) -> None:
    """One-time conversion of array files to Parquet."""
    read_json_array(spark, path, schema).write.mode("overwrite").parquet(out)


def _field(names: Sequence[str], df: DataFrame) -> Column:
    have = [F.col(n) for n in names if n in df.columns]
    return first_filled(*have) if have else F.lit(None).cast("string")


def align_by_id(gold: DataFrame, pred: DataFrame, id_col: str = "id") -> DataFrame:
    """Every gold record with its prediction; a missing prediction reads as blank."""
    return gold.join(pred, id_col, "left").withColumn("pred_sql", or_blank(F.col("pred_sql")))


def align_by_position(gold: DataFrame, pred: DataFrame, position: str = "line_no") -> DataFrame:
    """Alignment of files without ids: the n-th prediction belongs to the n-th gold record."""
    return align_by_id(gold, pred.select(position, "pred_sql"), position)


def read_lines_or_array(spark: SparkSession, path: str | Sequence[str], schema: str = RECORD_SCHEMA) -> DataFrame:
    """Records of JSON lines or of one top-level array, told apart by the first character.

    Malformed input raises in either form.
    """
    if _holds_array(spark, path):
        return read_json_array(spark, path, schema)
    return read_records(spark, path, schema)


def _holds_array(spark: SparkSession, path: str | Sequence[str]) -> bool:
    start = spark.read.option("lineSep", "\n").text(path).select(F.substring(F.regexp_replace("value", r"^[\ufeff\s]+", ""), 1, 1).alias("c"))
    first = start.filter("c != ''").limit(1).collect()
    return bool(first) and first[0]["c"] == "["


def _with_positions(spark: SparkSession, path: str | Sequence[str], schema: str = RECORD_SCHEMA) -> DataFrame:
    """The same records with ``line_no``, their number in the file from 0."""
    if _holds_array(spark, path):
        return _array_records(spark, path, schema)
    return dense_position(mark_position(read_records(spark, path, schema)))


def _check_ids(records: DataFrame, side: str) -> None:
    """Raise on a missing or repeated id: either would score records against the wrong query."""
    bad = records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("id is null or n > 1").limit(1).collect()
    if bad:
        what = "no id" if bad[0]["id"] is None else f"the id {bad[0]['id']!r} {bad[0]['n']} times"
        raise ValueError(f"the {side} records have {what}; align by position or give every record its own id")


def load_aligned(
    spark: SparkSession,
    gold_path: str,
    pred_path: str,
    fields: Mapping[str, Sequence[str]] = DATASET_FIELDS["spider"],
    by: str | None = None,
) -> DataFrame:
    """``id, db_id, question, gold_sql, pred_sql`` from a gold and a prediction file.

    Files hold JSON lines or one array.  ``by`` is ``id`` or ``position``; by default ids are
    used unless no gold record has one.  Missing or repeated ids raise.
    """
    gold = read_lines_or_array(spark, gold_path)
    pred = read_lines_or_array(spark, pred_path)
    if by is None:
        by = "position" if gold.filter("id is not null").isEmpty() else "id"
    if by == "id":
        _check_ids(gold, "gold")
        _check_ids(pred, "predicted")
    if by == "position":
        gold, pred = _with_positions(spark, gold_path), _with_positions(spark, pred_path)
        key = "line_no"
    else:
        key = "id"
    left = gold.select(
        key,
        *([] if key == "id" else [F.coalesce("id", F.col(key).cast("string")).alias("id")]),
        or_blank(F.col("db_id")).alias("db_id"),
        or_blank(F.col("question")).alias("question"),
        or_blank(_field(fields["gold"], gold)).alias("gold_sql"),
    )
    right = pred.select(key, _field(fields["pred"], pred).alias("pred_sql"))
    return align_by_id(left, right, key).select("id", "db_id", "question", "gold_sql", "pred_sql")


def load_dataset(
    spark: SparkSession, dataset: str, gold_path: str, pred_path: str, by: str | None = None
) -> DataFrame:
    """Aligned records of a named benchmark dataset."""
    return load_aligned(spark, gold_path, pred_path, DATASET_FIELDS[dataset], by)


def prompt_records(records: DataFrame) -> DataFrame:
    """Records that give a prompt and carry both a database and a query."""
    prompt = record_prompt(F.col("question"), F.col("text"), F.col("schema"))
    return (
        records.select("db_id", prompt.alias("prompt"), F.col("sql").alias("gold_sql"))
        .filter("prompt is not null and db_id is not null and gold_sql is not null")
    )


def text_field(records: DataFrame, field: str) -> DataFrame:
    """Text to embed: ``sql`` takes the gold query or else the dataset's query, any other
    field the question; records without text are dropped."""
    names = ("gold_sql", "query") if field == "sql" else ("question",)
    return records.select(_field(names, records).alias("text")).filter("text is not null")


def field_text(records: DataFrame, field: str) -> Column:
    """Text of one field, or the combined prompt for ``prompt``; null where blank."""
    if field == "prompt":
        return record_prompt(F.col("question"), F.col("text"), F.col("schema"))
    if not isinstance(records.schema[field].dataType, T.StringType):
        return F.lit(None).cast("string")
    return F.when(filled(F.col(field)), F.col(field))


def collect_texts(
    records: DataFrame, field: str, limit: int | None = None, order: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Texts of a field and a one-row count of kept and skipped records.

    ``limit`` counts scanned records, kept or not, in the given order.
    """
    scanned = records.orderBy(*order) if order else records
    if limit is not None:
        scanned = scanned.limit(limit)
    value = scanned.withColumn("_text", field_text(records, field))
    counts = value.agg(
        F.count_if(F.col("_text").isNotNull()).alias("kept"),
        F.count_if(F.col("_text").isNull()).alias("skipped"),
    )
    return value.filter("_text is not null").select(F.col("_text").alias("text")), counts
