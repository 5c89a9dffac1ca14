"""End-to-end jobs: evaluate, build a dataset, measure shift, train and predict."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgauge.functions.fixed_values import QUESTION_STYLES
from askgauge.operators import accuracy, cells, dedup, models, sampling, shift, subsets, workload
from askgauge.session import cut_lineage
from askgauge.sources import records, sinks, vectors


def evaluate(
    spark: SparkSession,
    gold_path: str,
    pred_path: str,
    runner: accuracy.Runner | None = None,
    dataset: str = "spider",
    by: str | None = None,
    out_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Execution accuracy of a prediction file: ordered samples and the one-row summary."""
    aligned = records.load_dataset(spark, dataset, gold_path, pred_path, by)
    samples = accuracy.accuracy_samples(aligned, runner or accuracy.catalog_runner(spark))
    summary = accuracy.accuracy_summary(samples)
    ordered = accuracy.ordered_samples(samples)
    if out_path:
        sinks.write_report(ordered, summary, out_path)
    return ordered, summary


def build_dataset(
    cell_table: DataFrame,
    out_path: str | None = None,
    *,
    min_semantic: float = 0.02,
    similarity: float = 80.0,
    styles: Sequence[str] = tuple(QUESTION_STYLES),
    make_fn: Callable | None = None,
    settings: models.GenerationSettings | None = None,
    per_sql: int = 4,
    rewrites: bool = False,
    per_rewrite: int = 2,
    materialize: bool = False,
) -> DataFrame:
    """Question/SQL examples from raw tables: filter, cluster into databases, render.

    ``make_fn`` plugs in a model that writes the questions and, on request,
    rewrites them; without one the style templates are used.
    """
    kept = cells.curated_cells(cell_table, min_semantic=min_semantic)
    headers = cut_lineage(cells.table_headers(kept))
    members = cut_lineage(dedup.assign_db_ids(dedup.cluster_tables(headers, similarity)))
    if materialize:
        sinks.materialize_tables(kept, members)
    named = sinks.table_stems(members.select("table_id", "db_id")).join(headers, "table_id")
    catalog = named.select(
        "db_id", "table_name", sinks.clean_header(F.col("header")).alias("columns")
    )
    queries = workload.sql_workload(catalog)
    if make_fn is None:
        examples = workload.template_examples(queries, styles)
    else:
        chosen = settings or models.GenerationSettings(max_new_tokens=128)
        asked = workload.question_prompts(queries, per_sql, styles)
        answers = models.generate_text(asked, make_fn, settings=chosen)
        written = workload.model_examples(answers, per_sql)
        if rewrites:
            # Model output feeds two branches; store it so that it is generated once.
            written = cut_lineage(written)
            prompts = workload.rewrite_prompts(written, per_rewrite)
            rewritten = workload.rewrite_examples(models.generate_text(prompts, make_fn, settings=chosen))
            columns = ["id", "db_id", "question", "gold_sql"]
            examples = written.select(*columns).unionByName(rewritten.select(*columns))
        else:
            examples = written
    if out_path:
        sinks.write_dataset(examples, out_path)
    return examples.select("id", "db_id", "question", "gold_sql")


def shift_from_records(
    source: DataFrame,
    target: DataFrame,
    *,
    source_field: str = "prompt",
    target_field: str = "prompt",
    target_limit: int | None = None,
    make_fn: Callable | None = None,
    dim: int = 256,
    **options,
) -> DataFrame:
    """Descriptors between the texts of two record sets, with used and skipped counts.

    With ``target_limit`` that many target records are drawn by hash, the same in every run.
    """
    texts = {}
    for side, frame, name, limit in (
        ("source", source, source_field, None),
        ("target", target, target_field, target_limit),
    ):
        scanned = frame.select(records.field_text(frame, name).alias("text"))
        if limit is not None:
            scanned = sampling.smallest_by_hash(scanned, limit, id_cols=("text",))
        texts[side] = scanned.select(F.lit(side).alias("side"), "text")
    both = texts["source"].unionByName(texts["target"])
    known = both.filter("text is not null")
    embedded = models.embed_texts(known, make_fn, dim=dim).select("side", "embedding")
    skipped = both.filter("text is null").select("side", F.lit(None).cast("array<float>").alias("embedding"))
    pool = cut_lineage(embedded.unionByName(skipped))
    sides = {r["side"] for r in pool.filter("embedding is not null").select("side").distinct().collect()}
    for side in ("source", "target"):
        if side not in sides:
            raise ValueError(f"no texts in the {side} records")
    return shift.shift_report(pool, **options)


def train_on_samples(
    source: DataFrame,
    target: DataFrame,
    *,
    num_sets: int = 100,
    size: int = 500,
    slices: int = 64,
    seed: int = 0,
    kind: str = "gbt",
    hybrid: bool = True,
    pca_k: int = 8,
    rand_r: int = 16,
    out_path: str | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Regressor trained on many subsets of one target workload.

    ``source`` holds ``embedding``; ``target`` holds ``rec_id, embedding, accuracy``.
    """
    members = sampling.cut_sets(sampling.sample_sets(target, num_sets, size, seed=seed))
    deltas = subsets.shift_by_set(
        members, target, source, size, slices, seed, hybrid=hybrid, pca_k=pca_k, rand_r=rand_r
    )
    rows = cut_lineage(subsets.training_rows(deltas, sampling.set_accuracy(members, target)))
    model = models.fit_accuracy(rows, kind=kind, calibrate=False, seed=seed)
    if out_path:
        sinks.write_shift_samples(rows, members, out_path, seed=seed, size=size, num_sets=num_sets)
        models.save_model(model, f"{out_path}/model")
    return model, rows


def train_on_pairs(
    pairs: DataFrame,
    embeddings: DataFrame,
    *,
    slices: int = 64,
    kind: str = "gbt",
    calibrate: bool = True,
    out_path: str | None = None,
    **options,
) -> PipelineModel:
    """Regressor trained on listed workload pairs (``pair_id, source, target, metric``)."""
    found = shift.delta(vectors.pair_vectors(pairs, embeddings), slices, ["pair_id"], **options)
    rows = cut_lineage(found.join(pairs.select("pair_id", F.col("metric").alias("accuracy")), "pair_id"))
    model = models.fit_accuracy(rows, kind=kind, calibrate=calibrate, id_cols=["pair_id"])
    if out_path:
        models.save_model(model, out_path)
    return model


def infer_accuracy(model: PipelineModel, source: DataFrame, target: DataFrame, **options) -> DataFrame:
    """Predicted accuracy of a workload from its shift against the source."""
    found = shift.delta(shift.two_sides(source, target), **options)
    return models.predict_accuracy(model, found)
