"""Training rows from many subsets of one target workload."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgauge.functions.vectors import doubles, project, project_by_key, unit_directions
from askgauge.operators.shift import (
    ROWS_PER_SLOT,
    diagonal_distance,
    dimension_of,
    mean_shift,
    moments,
    pca_directions_by_key,
    rank_runs,
    scale_shift,
)


def lowest_ranks(source: DataFrame, directions: np.ndarray, size: int) -> DataFrame:
    """The ``size`` smallest projections of the source per direction: ``dir, rk, p_source``.

    No subset has more members than that, so larger source ranks are never paired.
    """
    runs = rank_runs(source.select(F.lit("source").alias("side"), "embedding"), directions)
    upto = F.least("hi", F.lit(size).cast("bigint"))
    return runs.filter(F.col("lo") < size).select(
        "dir", F.explode(F.sequence(F.col("lo"), upto - 1)).alias("rk"), F.col("p").alias("p_source")
    )


def subset_ranks(placed: DataFrame, directions: np.ndarray, size: int) -> DataFrame:
    """Rank of every projected member inside its subset: ``set_id, dir, rk, p``."""
    if size <= ROWS_PER_SLOT:
        lines = placed.select("set_id", F.posexplode_outer("projected").alias("dir", "p"))
        order = Window.partitionBy("set_id", "dir").orderBy("p")
        return lines.withColumn("rk", F.row_number().over(order).cast("bigint") - 1)
    vectors = placed.select("set_id", F.lit("target").alias("side"), "embedding")
    runs = rank_runs(vectors, directions, ["set_id"], slots=1 + size // ROWS_PER_SLOT)
    return runs.select(
        "set_id", "dir", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("rk"), "p"
    )


def shift_by_set(
    membership: DataFrame,
    target: DataFrame,
    source: DataFrame,
    size: int,
    slices: int = 64,
    seed: int = 0,
    *,
    hybrid: bool = False,
    pca_k: int = 8,
    rand_r: int = 16,
) -> DataFrame:
    """The five descriptors of every subset against one source.

    ``membership`` holds ``set_id, rec_id`` and ``target`` ``rec_id, embedding``.
    What depends on a record alone (its distance from the source, its
    projections) is computed once per record, and the source side once in all,
    whatever the number of subsets.  With ``hybrid`` each subset also has
    principal directions of its own; the source is projected on all of them in
    one pass and keeps the ranks that a subset can reach.
    """
    directions = unit_directions(dimension_of(source), rand_r if hybrid else slices, seed)
    base = moments(source).select(F.struct("mean", "var").alias("m")).scalar()
    records = (
        target.filter(F.col("embedding").isNotNull())
        .withColumn("m", base)
        .select(
            "rec_id",
            "embedding",
            diagonal_distance(F.col("embedding"), F.col("m.mean"), F.col("m.var")).alias("dist"),
            project(F.col("embedding"), directions).alias("projected"),
        )
    )
    placed = membership.join(records, "rec_id")
    summary = Summarizer.metrics("count", "mean", "variance").summary(
        array_to_vector(doubles(F.col("embedding")))
    )
    per_set = placed.groupBy("set_id").agg(
        summary.alias("s"), F.avg("dist").alias("dist_mean"), F.stddev_pop("dist").alias("dist_std")
    )
    shrink = (F.col("s.count") - 1) / F.col("s.count")
    spread = F.transform(vector_to_array("s.variance"), lambda v: v * shrink)
    fixed = per_set.withColumn("m", base).select(
        "set_id",
        mean_shift(F.col("m.mean"), vector_to_array("s.mean")).alias("mean_shift"),
        scale_shift(F.col("m.var"), spread).alias("scale_shift"),
        "dist_mean",
        "dist_std",
    )
    gap = F.col("p") - F.col("p_source")
    gaps = (
        subset_ranks(placed, directions, size)
        .join(lowest_ranks(source, directions, size), ["dir", "rk"])
        .groupBy("set_id", "dir")
        .agg(F.sqrt(F.avg(gap * gap)).alias("gap"))
    )
    if hybrid:
        gaps = gaps.unionByName(_own_gaps(placed, source, pca_k, size))
    sliced = gaps.groupBy("set_id").agg(F.avg("gap").alias("swd"))
    return fixed.join(sliced, "set_id")


def _own_gaps(placed: DataFrame, source: DataFrame, pca_k: int, size: int) -> DataFrame:
    """Rank gaps of every subset along the principal directions of source and subset together."""
    members = placed.select("set_id", "embedding")
    own = pca_directions_by_key(members, "set_id", pca_k, shared=source)
    names = sorted(own)
    low = lowest_ranks(source, np.concatenate([own[s] for s in names]), size)
    # The directions of the n-th set follow those of the sets before it.
    before = np.cumsum([0, *[len(own[s]) for s in names]]).tolist()
    start = F.create_map(*[F.lit(v) for pair in zip(names, before) for v in pair])
    ranks = subset_ranks(members.withColumn("projected", project_by_key(F.col("set_id"), F.col("embedding"), own)), own, size)
    all_dirs = F.element_at(start, F.col("set_id")) + F.col("dir")
    gap = F.col("p") - F.col("p_source")
    return (
        ranks.withColumn("own_dir", F.col("dir"))
        .withColumn("dir", all_dirs.cast("int"))
        .join(low, ["dir", "rk"])
        .groupBy("set_id", F.col("own_dir").alias("dir"))
        .agg(F.sqrt(F.avg(gap * gap)).alias("gap"))
    )


def training_rows(deltas: DataFrame, accuracy_by_set: DataFrame) -> DataFrame:
    return deltas.join(accuracy_by_set.select("set_id", "accuracy"), "set_id")
