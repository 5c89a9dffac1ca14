"""Accuracy regression on shift descriptors, and batch model calls."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgauge.functions.text import cut_at_stop
from askgauge.operators.sampling import holdout_split
from askgauge.operators.shift import DESCRIPTORS
from askgauge.session import cut_lineage

MIN_ROWS_TO_CALIBRATE = 10


def _regressor(kind: str, label: str, seed: int):
    if kind == "gbt":
        return GBTRegressor(featuresCol="features", labelCol=label, predictionCol="raw", maxIter=20, maxDepth=3, seed=seed)
    return LinearRegression(featuresCol="features", labelCol=label, predictionCol="raw", regParam=0.01)


def fit_accuracy(
    rows: DataFrame,
    label: str = "accuracy",
    inputs: Sequence[str] = DESCRIPTORS,
    kind: str = "linear",
    calibrate: bool = True,
    id_cols: Sequence[str] = ("set_id",),
    seed: int = 0,
) -> PipelineModel:
    """Regressor from descriptors to accuracy; ``raw`` holds its output.

    With enough rows a held-out fifth fits an isotonic calibration on top, whose
    output is ``calibrated``.  Values outside its range are clipped to the ends.
    Fitting scans ``rows`` many times: pass stored or checkpointed rows.
    """
    base = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(inputs), outputCol="point"),
            StandardScaler(inputCol="point", outputCol="features", withMean=True),
            _regressor(kind, label, seed),
        ]
    )
    if not calibrate or rows.count() < MIN_ROWS_TO_CALIBRATE:
        return base.fit(rows)
    split = cut_lineage(holdout_split(rows, id_cols, seed))
    fitted = base.fit(split.filter("not is_holdout"))
    held = fitted.transform(split.filter("is_holdout"))
    isotonic = IsotonicRegression(featuresCol="raw", labelCol=label, predictionCol="calibrated").fit(held)
    return PipelineModel(stages=[*fitted.stages, isotonic])


def predict_accuracy(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``predicted``: the calibrated output where there is one, else the raw one."""
    out = model.transform(rows)
    best = "calibrated" if "calibrated" in out.columns else "raw"
    return out.select(*rows.columns, F.col(best).alias("predicted"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def error_report(scored: DataFrame, by: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """Mean absolute error with the half width of its 95 % interval, per group."""
    gap = F.abs(F.col(predicted) - F.col(actual))
    return scored.groupBy(*by).agg(
        F.avg(gap).alias("mae"),
        (1.96 * F.stddev_samp(gap) / F.sqrt(F.count(F.lit(1)))).alias("ci95"),
        F.count(F.lit(1)).alias("n"),
    )


def hashed_embeddings(texts: DataFrame, text_col: str = "text", dim: int = 256) -> DataFrame:
    """Unit-length hashed bag-of-words vectors: the built-in embedding, whole texts, no model."""
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"\W+"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dim),
        Normalizer(inputCol="_counts", outputCol="_unit"),
    ]
    out = texts
    for stage in stages:
        out = stage.transform(out)
    vector = vector_to_array("_unit", dtype="float32")
    return out.withColumn("embedding", vector).drop("_tokens", "_counts", "_unit")


def embed_texts(
    texts: DataFrame,
    make_fn: Callable | None = None,
    text_col: str = "text",
    dim: int = 256,
    batch_size: int = 16,
) -> DataFrame:
    """Add ``embedding``; ``make_fn`` loads a model once per worker and maps a text batch
    to a matrix.  Without one the built-in hashed embedding is used."""
    if make_fn is None:
        return hashed_embeddings(texts, text_col, dim)
    embed = predict_batch_udf(make_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return texts.withColumn("embedding", embed(F.col(text_col)))


@dataclass
class GenerationSettings:
    """Decoding settings handed to the model function."""

    max_new_tokens: int = 256
    temperature: float = 0.7
    top_p: float = 0.9
    do_sample: bool = True
    stop: list[str] = field(default_factory=list)


def generate_text(
    prompts: DataFrame,
    make_fn: Callable[[GenerationSettings], Callable],
    prompt_col: str = "prompt",
    settings: GenerationSettings | None = None,
    batch_size: int = 16,
) -> DataFrame:
    """Add ``output``: the model's answer, cut at the first listed stop text that occurs.

    ``make_fn(settings)`` runs once per worker and returns the batch function.
    """
    chosen = settings or GenerationSettings()
    call = predict_batch_udf(lambda: make_fn(chosen), return_type=T.StringType(), batch_size=batch_size)
    answered = prompts.withColumn("output", call(F.col(prompt_col)))
    return answered.withColumn("output", cut_at_stop(F.col("output"), chosen.stop))
