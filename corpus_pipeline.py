"""A training-data pipeline: documents in, token-id files out.

Each stage reads what the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askgauge.llm.contamination import drop_contaminated
from askgauge.llm.jaccard_join import keep_one_of_each
from askgauge.llm.mixing import mixed_rows
from askgauge.llm.packed_ids import default_tokenizer, read_packed, token_digests, write_ids
from askgauge.llm.tables import read_table, stored
from askgauge.llm.toxic_kernel import drop_toxic, fit_toxicity
from askgauge.session import scratch_path


#: Rows that go to a Python worker at a time: a batch is held by the executor and by the worker, and texts are long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch by BATCH_ROWS, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    asked = int(spark.conf.get(name, "10000"))
    if asked <= 0 or asked > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, by a model fitted on the labelled ones among them."""
    small_batches(spark)
    return drop_toxic(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles of likeness 0.8 or more connect."""
    small_batches(spark)
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item, or a whole shorter item."""
    small_batches(spark)
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    small_batches(spark)
    return mixed_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of all rows, and what reading them back gives per row."""
    small_batches(spark)
    path = scratch_path(spark, "pipeline-ids")
    write_ids(docs, path, default_tokenizer())
    return token_digests(read_packed(spark, path))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mix),
    ("token_ids", token_output),
]

#: The toxicity model cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
