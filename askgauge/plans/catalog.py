"""Every registered query: name -> function of (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgauge.functions import schema_text as schemas
from askgauge.functions import text as texts
from askgauge.operators import accuracy, cells, dedup, models, pooling, sampling, shift, subsets, workload
from askgauge.functions.vectors import unit_directions
from askgauge.plans import inputs
from askgauge.session import cut_lineage
from askgauge.sources import records as record_source
from askgauge.sources.vectors import pair_vectors

Query = Callable[[SparkSession, str], DataFrame]
SLICES = 64
SETS, SET_SIZE, SET_SLICES = 20, 100, 16
JOINT_CAP = 200

QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


# --- shift descriptors -------------------------------------------------------------------

@register("shift_delta")
def shift_delta(spark, d):
    return inputs.rounded(shift.delta(inputs.vectors(spark, d), SLICES), *shift.DESCRIPTORS)


@register("shift_frechet")
def shift_frechet(spark, d):
    return inputs.rounded(shift.mean_scale_shift(inputs.vectors(spark, d)), "mean_shift", "scale_shift")


@register("shift_mahalanobis")
def shift_mahalanobis(spark, d):
    return inputs.rounded(shift.distance_profile(inputs.vectors(spark, d)), "dist_mean", "dist_std")


@register("shift_swd")
def shift_swd(spark, d):
    found = shift.sliced_distance(inputs.vectors(spark, d), unit_directions(64, SLICES))
    return inputs.rounded(found, "swd")


@register("shift_swd_hybrid")
def shift_swd_hybrid(spark, d):
    found = shift.sliced_distance_hybrid(inputs.vectors(spark, d), id_cols=("vec_id",))
    return inputs.rounded(found, "swd")


@register("shift_swd_quantile")
def shift_swd_quantile(spark, d):
    found = shift.sliced_distance_by_quantile(inputs.vectors(spark, d), unit_directions(64, SLICES))
    return inputs.rounded(found, "swd")


@register("shift_report")
def shift_report(spark, d):
    return inputs.rounded(shift.shift_report(inputs.vectors(spark, d), slices=SLICES), *shift.DESCRIPTORS)


@register("shift_multi_pairs")
def shift_multi_pairs(spark, d):
    named = inputs.table(spark, d, "embeddings").select(
        F.concat(F.lit("w"), F.col("label").cast("string")).alias("workload"), "label", "embedding"
    )
    name = lambda number: F.concat(F.lit("w"), number.cast("string"))
    pairs = named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("label").alias("pair_id"),
        name(F.col("label")).alias("source"),
        name((F.col("label") + 1) % 10).alias("target"),
    )
    found = shift.delta(pair_vectors(pairs, named), SET_SLICES, ["pair_id"])
    return inputs.rounded(found, *shift.DESCRIPTORS)


@register("pca_directions")
def pca_directions(spark, d):
    found = shift.pca_directions(inputs.vectors(spark, d), 8)
    rows = [(k, i, round(float(x), 6)) for k, row in enumerate(found) for i, x in enumerate(row)]
    return spark.createDataFrame(rows, "component int, dim int, loading double")


@register("joint_subsample")
def joint_subsample(spark, d):
    return shift.joint_subsample(inputs.vectors(spark, d), JOINT_CAP, ["vec_id"]).select("vec_id", "side")


@register("scan_embeddings")
def scan_embeddings(spark, d):
    return inputs.table(spark, d, "embeddings").select(
        "vec_id",
        F.size("embedding").alias("dim"),
        F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@register("mean_pool")
def mean_pool(spark, d):
    tokens = inputs.table(spark, d, "embeddings").withColumn("mask", (F.get("embedding", F.lit(0)) > 0).cast("int"))
    pooled = pooling.mean_pool(tokens, ["label"])
    return pooled.select("label", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round("value", 6)
    )


# --- subsets and regression --------------------------------------------------------------

def _target(spark, d):
    return inputs.vectors(spark, d).filter("side = 'target'").select(
        F.col("vec_id").alias("rec_id"), "embedding", (F.col("label") % 2).cast("double").alias("accuracy")
    )


def membership(spark, d):
    return sampling.sample_sets(_target(spark, d).select("rec_id"), SETS, SET_SIZE)


@register("sample_sets")
def sample_sets(spark, d):
    return membership(spark, d)


@register("sample_set_accuracy")
def sample_set_accuracy(spark, d):
    return inputs.rounded(sampling.set_accuracy(membership(spark, d), _target(spark, d)), "accuracy")


@register("shift_by_set")
def shift_by_set(spark, d):
    source = inputs.vectors(spark, d).filter("side = 'source'")
    members = sampling.cut_sets(membership(spark, d))
    found = subsets.shift_by_set(members, _target(spark, d), source, SET_SIZE, SET_SLICES)
    return inputs.rounded(found, *shift.DESCRIPTORS)


@register("shift_by_set_hybrid")
def shift_by_set_hybrid(spark, d):
    source = inputs.vectors(spark, d).filter("side = 'source'")
    members = sampling.cut_sets(membership(spark, d))
    found = subsets.shift_by_set(members, _target(spark, d), source, SET_SIZE, hybrid=True)
    return inputs.rounded(found, *shift.DESCRIPTORS)


@register("holdout_split")
def holdout_split(spark, d):
    held = sampling.holdout_split(inputs.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return held.select("o_orderkey", F.col("is_holdout").cast("int").alias("is_holdout"))


def training_rows(spark, d):
    members = sampling.cut_sets(membership(spark, d))
    source = inputs.vectors(spark, d).filter("side = 'source'")
    deltas = subsets.shift_by_set(members, _target(spark, d), source, SET_SIZE, SET_SLICES)
    return cut_lineage(subsets.training_rows(deltas, sampling.set_accuracy(members, _target(spark, d))))


@register("regress_accuracy")
def regress_accuracy(spark, d):
    rows = training_rows(spark, d)
    model = models.fit_accuracy(rows, calibrate=False)
    return models.predict_accuracy(model, rows).select("set_id", "accuracy", F.round("predicted", 6).alias("predicted"))


@register("calibrate_isotonic")
def calibrate_isotonic(spark, d):
    rows = training_rows(spark, d)
    model = models.fit_accuracy(rows, calibrate=True)
    return models.predict_accuracy(model, rows).select("set_id", "accuracy", F.round("predicted", 6).alias("predicted"))


@register("predict_accuracy")
def predict_accuracy(spark, d):
    model = models.fit_accuracy(training_rows(spark, d))
    fresh = shift.delta(inputs.vectors(spark, d), SET_SLICES)
    return models.predict_accuracy(model, fresh).select(F.round("predicted", 6).alias("predicted"))


@register("mae_report")
def mae_report(spark, d):
    lines = inputs.table(spark, d, "lineitem")
    found = models.error_report(lines, ["l_returnflag", "l_linestatus"], "l_discount", "l_tax")
    return inputs.rounded(found, "mae", "ci95")


@register("embed_texts_hashed")
def embed_texts_hashed(spark, d):
    said = inputs.table(spark, d, "conversations")
    vectors = models.embed_texts(said, dim=64)
    return vectors.select("conv_id", "turn", F.size("embedding").alias("dim"),
                          F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@register("generate_text")
def generate_text(spark, d):
    prompts = inputs.table(spark, d, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("SELECT "), F.col("turn").cast("string"), F.lit(" STOP "), F.col("text")).alias("prompt")
    )
    settings = models.GenerationSettings(stop=["<end>", "STOP"])
    return models.generate_text(prompts, echo_model, settings=settings).select("conv_id", "turn", "output")


def echo_model(settings):
    """Stand-in model: repeats each prompt."""

    def answer(batch):
        return batch

    return answer


# --- execution accuracy ------------------------------------------------------------------

def _samples(spark, d):
    with accuracy.view_runner(spark, inputs.databases(spark, d)) as runner:
        return accuracy.accuracy_samples(inputs.query_pairs(spark), runner)


@register("exec_accuracy_samples")
def exec_accuracy_samples(spark, d):
    return accuracy.ordered_samples(_samples(spark, d))


@register("exec_accuracy_summary")
def exec_accuracy_summary(spark, d):
    return inputs.rounded(accuracy.accuracy_summary(_samples(spark, d)), "execution_accuracy")


@register("bag_compare")
def bag_compare(spark, d):
    lines = inputs.table(spark, d, "lineitem")
    drift = F.when(F.col("l_linenumber") % 2 == 1, 1e-9).otherwise(0.01)
    sides = F.array(
        F.struct(F.lit(1).alias("cnt"), F.col("l_extendedprice").alias("price")),
        F.struct(F.lit(-1).alias("cnt"), (F.col("l_extendedprice") + drift).alias("price")),
    )
    both = lines.select(F.col("l_linenumber").alias("pair_id"), "l_orderkey", "l_returnflag", F.inline(sides))
    key = accuracy.row_key(both, ["l_orderkey", "l_returnflag", "price"])
    found = accuracy.bag_differences(both.withColumn("row_key", key))
    return found.select("pair_id", F.col("equal").cast("int").alias("equal"))


@register("unique_queries")
def unique_queries(spark, d):
    return accuracy.unique_queries(inputs.query_log(spark, d)).select("query_id", "db_id", "norm", "sql", "uses")


@register("align_gold_pred")
def align_gold_pred(spark, d):
    turns = inputs.workload_records(spark, d)
    gold = turns.filter("role = 'user'").select("id", "db_id", F.col("text").alias("gold_sql"))
    pred = turns.filter("role = 'assistant'").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("id"),
        F.col("text").alias("pred_sql"),
    )
    return record_source.align_by_id(gold, pred)


# --- text --------------------------------------------------------------------------------

@register("sql_normalize")
def sql_normalize(spark, d):
    return inputs.query_log(spark, d).select("event_id", texts.sql_key(F.col("sql")).alias("norm"))


@register("sql_components")
def sql_components(spark, d):
    return texts.feature_counts(inputs.query_log(spark, d))


@register("sql_columns")
def sql_columns(spark, d):
    return texts.column_uses(inputs.query_log(spark, d))


@register("extract_sql")
def extract_sql(spark, d):
    answers = inputs.model_answers(spark, d)
    return answers.select("conv_id", "turn", texts.extract_sql(F.col("answer")).alias("sql"))


@register("select_text_field")
def select_text_field(spark, d):
    turns = inputs.workload_records(spark, d).select(
        F.when(F.col("role") == "assistant", F.col("text")).otherwise("").alias("gold_sql"),
        F.when(F.col("role") == "user", F.concat(F.lit("q "), "text")).alias("query"),
    )
    return record_source.text_field(turns, "sql")


@register("field_texts_skipped")
def field_texts_skipped(spark, d):
    turns = inputs.workload_records(spark, d).withColumn(
        "text", F.when(F.col("role") == "system", F.lit(" \n ")).otherwise(F.col("text"))
    )
    return record_source.collect_texts(turns, "text")[1]


@register("language_filter")
def language_filter(spark, d):
    docs = inputs.table(spark, d, "documents")
    return docs.select("doc_id", "lang", texts.detect_language(F.col("text")).alias("detected"))


@register("language_accuracy")
def language_accuracy(spark, d):
    docs = inputs.table(spark, d, "documents")
    hit = texts.detect_language(F.col("text")) == F.col("lang")
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits")
    )


@register("clean_names")
def clean_names(spark, d):
    raw = F.concat(F.lit("  "), F.initcap("p_name"), F.lit(" "), F.col("p_type"), F.lit(" "))
    return inputs.table(spark, d, "part").select("p_partkey", texts.clean_name(raw).alias("clean_name"))


@register("schema_to_prompt")
def schema_to_prompt(spark, d):
    parts = inputs.instruct_records(spark, d)
    return parts.select("id", schemas.schema_text(F.col("full_schema")).alias("schema_text"))


@register("record_prompt")
def record_prompt(spark, d):
    parts = inputs.instruct_records(spark, d)
    return parts.select("id", schemas.record_prompt(F.col("question"), F.col("text"), F.col("schema")).alias("prompt"))


@register("prompt_records")
def prompt_records(spark, d):
    return record_source.prompt_records(inputs.instruct_records(spark, d))


@register("chat_prompts")
def chat_prompts(spark, d):
    turns = inputs.table(spark, d, "conversations").filter("role = 'user'")
    return workload.chat_prompts(turns.select("conv_id", "turn", F.col("text").alias("prompt"))).drop("prompt")


@register("output_lines")
def output_lines(spark, d):
    turns = inputs.table(spark, d, "conversations")
    lines = F.posexplode_outer(texts.output_lines(F.col("text"))).alias("idx", "line")
    return turns.select("conv_id", "turn", lines).filter("idx is not null")


@register("qa_pairs")
def qa_pairs(spark, d):
    answers = inputs.qa_answers(spark, d)
    pair = F.explode_outer(texts.qa_pairs(F.col("output"))).alias("pair")
    return answers.select("conv_id", "turn", pair).filter("pair is not null").select("conv_id", "turn", "pair.*")


# --- cells -------------------------------------------------------------------------------

@register("table_profile")
def table_profile(spark, d):
    return cells.table_profile(inputs.cells(spark, d))


@register("structural_filter")
def structural_filter(spark, d):
    return cells.structural_filter(inputs.cells(spark, d))


@register("semantic_richness")
def semantic_richness(spark, d):
    return inputs.rounded(cells.semantic_richness(inputs.cells(spark, d)), "richness")


@register("header_hash")
def header_hash(spark, d):
    return cells.header_hash(inputs.page_headers(spark, d))


@register("infer_foreign_keys")
def infer_foreign_keys(spark, d):
    return inputs.rounded(cells.infer_foreign_keys(inputs.cells(spark, d)), "overlap")


@register("richness_prompts")
def richness_prompts(spark, d):
    return workload.richness_prompts(inputs.cells(spark, d))


# --- near duplicates ---------------------------------------------------------------------

@register("header_near_dups")
def header_near_dups(spark, d):
    return inputs.rounded(dedup.header_near_dups(inputs.page_headers(spark, d)), "ratio")


@register("cluster_tables")
def cluster_tables(spark, d):
    return dedup.cluster_tables(inputs.page_headers(spark, d))


@register("assign_db_ids")
def assign_db_ids(spark, d):
    return dedup.assign_db_ids(dedup.cluster_tables(inputs.page_headers(spark, d)))


@register("near_dup_filter")
def near_dup_filter(spark, d):
    return dedup.near_dup_filter(dedup.cluster_tables(inputs.page_headers(spark, d)))


# --- query templates and examples --------------------------------------------------------

@register("tmpl_select")
def tmpl_select(spark, d):
    return workload.select_column(inputs.table(spark, d, "customer"), "c_custkey")


@register("tmpl_count")
def tmpl_count(spark, d):
    return workload.count_rows(inputs.table(spark, d, "lineitem"))


@register("tmpl_group_avg")
def tmpl_group_avg(spark, d):
    events = inputs.table(spark, d, "events").withColumn("text_value", F.when(F.col("value") > 1, F.col("value").cast("string")).otherwise("n/a"))
    return inputs.rounded(workload.group_average(events, "event_type", "text_value"), "avg_value")


@register("tmpl_join")
def tmpl_join(spark, d):
    return workload.join_on_column(inputs.table(spark, d, "labels"), inputs.table(spark, d, "documents"), "doc_id")


@register("tmpl_nested_having")
def tmpl_nested_having(spark, d):
    return workload.repeated_values(inputs.table(spark, d, "orders"), "o_custkey")


def _workload(spark, d):
    return workload.sql_workload(inputs.page_catalog(spark, d)).withColumn("db_id", F.lit("web"))


@register("sqlgen_workload")
def sqlgen_workload(spark, d):
    return _workload(spark, d).select("table_name", "kind", "sql")


@register("question_templates")
def question_templates(spark, d):
    return workload.template_examples(_workload(spark, d))


@register("dataset_ids")
def dataset_ids(spark, d):
    return _workload(spark, d).select(workload.example_id(F.col("kind"), F.col("sql")).alias("id"))


@register("render_templates")
def render_templates(spark, d):
    return workload.question_prompts(_workload(spark, d)).select("table_name", "kind", "prompt")


@register("rewrite_prompts")
def rewrite_prompts(spark, d):
    turns = inputs.table(spark, d, "conversations").filter("role = 'user'")
    examples = turns.select(
        "conv_id",
        "turn",
        F.lit("db1").alias("db_id"),
        F.lit("events").alias("table_name"),
        F.array(F.lit("user_id"), F.lit("value")).alias("columns"),
        F.col("text").alias("question"),
        F.concat(F.lit("SELECT value FROM events WHERE user_id > "), F.col("turn").cast("string")).alias("gold_sql"),
    )
    return workload.rewrite_prompts(examples).select("conv_id", "turn", "kind", "prompt")
