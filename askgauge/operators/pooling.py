"""Masked mean pooling of token vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgauge.functions.vectors import doubles

SMALLEST_WEIGHT = 1e-6


def mean_pool(
    tokens: DataFrame, keys: Sequence[str], vector_col: str = "embedding", mask_col: str = "mask"
) -> DataFrame:
    """Mean of the unmasked token vectors of each item.

    Vectors are summed as vectors in the map tasks.  An item with every token
    masked pools to zeros.
    """
    weight = F.col(mask_col).cast("double")
    masked = F.transform(doubles(F.col(vector_col)), lambda x: x * weight)
    sums = tokens.groupBy(*keys).agg(
        Summarizer.sum(array_to_vector(masked)).alias("total"),
        F.greatest(F.sum(weight), F.lit(SMALLEST_WEIGHT)).alias("weight"),
    )
    return sums.select(
        *keys, F.transform(vector_to_array("total"), lambda x: x / F.col("weight")).alias("embedding")
    )
