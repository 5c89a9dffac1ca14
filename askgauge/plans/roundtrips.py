"""Registered queries that write derived data to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from askgauge.operators import accuracy, cells, models, shift
from askgauge.plans import catalog, inputs, jobs
from askgauge.plans.catalog import register
from askgauge.session import cut_lineage, scratch_path
from askgauge.sources import records, sinks, tables, vectors

CSV_TABLES = ("customer", "orders", "part")


@register("read_records")
def read_records(spark, d):
    path = scratch_path(spark, "records")
    inputs.instruct_records(spark, d).drop("full_schema").write.json(path)
    back = records.read_records(spark, path)
    return records.prompt_records(back)


@register("load_aligned")
def load_aligned(spark, d):
    gold_path, pred_path = scratch_path(spark, "gold"), scratch_path(spark, "pred")
    turns = inputs.workload_records(spark, d)
    turns.filter("role = 'user'").select(
        "id", "db_id", F.col("text").alias("question"), F.col("text").alias("query")
    ).write.json(gold_path)
    turns.filter("role = 'assistant'").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("id"),
        F.col("text").alias("prediction"),
    ).write.json(pred_path)
    return records.load_dataset(spark, "bird", gold_path, pred_path).drop("question")


@register("csv_to_cells")
def csv_to_cells(spark, d):
    root = _csv_folder(spark, d)
    found, _ = tables.load_first_tables(spark, [root])
    return (
        found.withColumn("table_name", F.element_at(F.split("table_id", "/"), -2))
        .groupBy("table_name", "col_idx", "col_name")
        .agg(
            F.count("value").alias("n_values"),
            F.sum(F.length("value")).alias("n_chars"),
            F.countDistinct("value").alias("n_distinct"),
        )
    )


@register("wikisql_to_cells")
def wikisql_to_cells(spark, d):
    links = F.regexp_extract_all("html", F.lit(r'<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1))
    whole = inputs.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), links.alias("header"))
    shaped = whole.withColumn("rows", F.array("header", F.transform("header", lambda h: F.translate(h, "aeiou", "AEIOU")), F.slice("header", 1, 2)))
    path = scratch_path(spark, "wiki")
    shaped.write.json(path)
    return tables.read_wikisql_cells(spark, path)


@register("write_report")
def write_report(spark, d):
    path = scratch_path(spark, "report")
    samples = catalog.QUERIES["exec_accuracy_samples"](spark, d)
    sinks.write_report(samples, accuracy.accuracy_summary(samples), path)
    return sinks.read_report(spark, path)[0]


@register("write_aligned")
def write_aligned(spark, d):
    path = scratch_path(spark, "aligned")
    sinks.write_aligned(catalog.QUERIES["align_gold_pred"](spark, d), path)
    return records.read_records(spark, path).select("id", "db_id", "gold_sql", "pred_sql")


@register("write_dataset")
def write_dataset(spark, d):
    path = scratch_path(spark, "dataset")
    sinks.write_dataset(catalog.QUERIES["question_templates"](spark, d), path)
    return sinks.read_dataset(spark, path)


@register("write_embeddings")
def write_embeddings(spark, d):
    path = scratch_path(spark, "vectors")
    vectors.write_embeddings(inputs.table(spark, d, "embeddings"), path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return vectors.read_embeddings(spark, path).select(
        "vec_id", F.size("embedding").alias("dim"), F.round(total, 6).alias("total")
    )


@register("write_shift_samples")
def write_shift_samples(spark, d):
    path = scratch_path(spark, "samples")
    rows = catalog.training_rows(spark, d)
    sinks.write_shift_samples(
        rows, catalog.membership(spark, d), path, seed=0, size=catalog.SET_SIZE, num_sets=catalog.SETS
    )
    back = spark.read.parquet(f"{path}/sets")
    return inputs.rounded(back, *shift.DESCRIPTORS, "accuracy")


@register("model_roundtrip")
def model_roundtrip(spark, d):
    path = scratch_path(spark, "model")
    rows = catalog.training_rows(spark, d)
    models.save_model(models.fit_accuracy(rows, calibrate=False), path)
    scored = models.predict_accuracy(models.load_model(path), rows)
    return scored.select("set_id", F.round("predicted", 6).alias("predicted"))


def _csv_folder(spark, d):
    root = scratch_path(spark, "csv")
    for name in CSV_TABLES:
        plain = inputs.table(spark, d, name)
        texts = plain.select(*[inputs.cell_text(plain, c).alias(c) for c in plain.columns])
        texts.write.option("header", True).csv(f"{root}/{name}")
    return root


ARRAY_CONVERSATIONS = 1000


@register("read_json_array")
def read_json_array(spark, d):
    """User turns written as arrays of a thousand conversations a file, read back with the array reader."""
    path = scratch_path(spark, "arrays")
    record = F.struct(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("question"))
    turns = inputs.table(spark, d, "conversations").filter("role = 'user'")
    arrays = turns.groupBy(F.floor(F.col("conv_id") / ARRAY_CONVERSATIONS)).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return records.read_json_array(spark, path).select("id", "question")


@register("csv_line_breaks")
def csv_line_breaks(spark, d):
    """Documents written with a line break for each blank, read back from CSV blocks."""
    root = scratch_path(spark, "breaks")
    text = F.translate(F.coalesce("text", F.lit("")), " \r", "\n")
    marked = F.concat(F.lit("<"), text, F.lit(">")).alias("text")
    inputs.table(spark, d, "documents").select("doc_id", marked).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(root)
    found, _ = tables.csv_to_cells(spark, [root], max_columns=2, multi_line=True)
    value = lambda column: F.max(F.when(F.col("col_idx") == column, F.col("value")))
    whole = found.groupBy("table_id", "row_idx").agg(value(0).cast("bigint").alias("doc_id"), value(1).alias("text"))
    return whole.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("discover_csv_files")
def discover_csv_files(spark, d):
    """Folders below the root and whether each holds files."""
    found = tables.discover_csv_files(spark, [_csv_folder(spark, d)])
    name = F.element_at(F.split("path", "/"), -2).alias("table_name")
    return found.groupBy(name).agg((F.countDistinct("path") == F.count(F.lit(1))).alias("distinct_paths"), F.bool_and(F.col("path").endswith(".csv")).alias("all_csv"))


@register("materialize_tables")
def materialize_tables(spark, d):
    """Three tables saved to the catalog from their cells and read back: rows and one sum each."""
    kept = inputs.cells(spark, d).filter(F.col("table_id").isin(*CSV_TABLES))
    db_id = "saved_" + scratch_path(spark, "db").rsplit("-", 1)[1]
    members = kept.select("table_id").distinct().withColumn("db_id", F.lit(db_id))
    sinks.materialize_tables(kept, members)
    sums = {"customer": "c_acctbal", "orders": "o_totalprice", "part": "p_retailprice"}
    parts = [
        spark.table(f"{db_id}.{name}").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(column), 2).alias("total")).select(F.lit(name).alias("table_name"), "n", "total")
        for name, column in sums.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("english_tables")
def english_tables(spark, d):
    return cells.english_tables(inputs.page_headers(spark, d))


@register("evaluate_files")
def evaluate_files(spark, d):
    """Execution accuracy of queries over every customer, read from an array file and a line file."""
    gold_path, pred_path = scratch_path(spark, "gold"), scratch_path(spark, "pred")
    few = inputs.table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.lit("tpc").alias("db_id"),
        F.concat(F.lit("SELECT COUNT(*) FROM customer WHERE c_nationkey = "), F.col("n_nationkey").cast("string")).alias("query"),
        F.concat(F.lit("select count(c_custkey) from customer where c_nationkey = "), F.floor(F.col("n_nationkey") / 2).cast("string")).alias("prediction"),
    )
    gold = F.to_json(F.collect_list(F.struct("id", "db_id", "query")))
    few.agg(gold.alias("value")).write.text(gold_path)
    few.select("id", "prediction").write.json(pred_path)
    with accuracy.view_runner(spark, inputs.databases(spark, d)) as run:
        samples, _ = jobs.evaluate(spark, gold_path, pred_path, run)
        return cut_lineage(samples)
