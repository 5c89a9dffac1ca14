"""Shift descriptors between two sets of vectors.

Input frames carry optional key columns (a pair or workload id), ``side``
(``source`` or ``target``) and ``embedding``.  Five numbers come out per key:
mean shift, scale shift, mean and spread of the diagonal Mahalanobis distance,
and the sliced Wasserstein distance.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgauge.functions.vectors import (
    array_sum,
    doubles,
    fix_signs,
    leading_directions,
    project,
    project_by_key,
    second_moments,
    sketched_moments,
    slot_of,
    squared_gap,
    unit_directions,
)
from askgauge.operators.sampling import smallest_by_hash
from askgauge.session import cut_lineage

EPS = 1e-8
DESCRIPTORS = ("mean_shift", "scale_shift", "dist_mean", "dist_std", "swd")
# Sorted runs longer than this are cut into range slots, so no task sorts a whole direction.
ROWS_PER_SLOT = 1_000_000
# Vectors sampled to place the slot borders; the borders steer balance only, never the result.
BORDER_SAMPLE = 50_000
# Widest vectors for which a D x D sum per key is formed; wider ones are sketched.
MAX_KEYED_DIM = 1024
# A sketch carries this many directions more than asked for and is refined in so many passes.
SKETCH_EXTRA, SKETCH_PASSES = 8, 6


def two_sides(source: DataFrame, target: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Bag union of two vector sets with a ``side`` tag."""
    tag = lambda df, name: df.select(F.lit(name).alias("side"), F.col(vector_col).alias("embedding"))
    return tag(source, "source").unionByName(tag(target, "target"))


def dimension_of(vectors: DataFrame) -> int:
    row = vectors.filter(F.col("embedding").isNotNull()).select(F.size("embedding").alias("d")).head()
    if row is None:
        raise ValueError("no vectors to measure")
    return row["d"]


def moments(vectors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: count, mean array and population variance array (partial aggregation, one pass)."""
    summary = Summarizer.metrics("count", "mean", "variance").summary(
        array_to_vector(doubles(F.col("embedding")))
    )
    raw = vectors.filter(F.col("embedding").isNotNull()).groupBy(*keys).agg(summary.alias("s"))
    shrink = (F.col("n") - 1) / F.col("n")
    return (
        raw.select(
            *keys,
            F.col("s.count").alias("n"),
            vector_to_array("s.mean").alias("mean"),
            vector_to_array("s.variance").alias("sample_var"),
        )
        .filter("n > 0")
        .select(*keys, "n", "mean", F.transform("sample_var", lambda v: v * shrink).alias("var"))
    )


def _side(name: str, field: str) -> Column:
    return F.first(F.when(F.col("side") == name, F.col(field)), ignorenulls=True)


def paired_moments(vectors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with the moments of both sides next to each other."""
    return moments(vectors, [*keys, "side"]).groupBy(*keys).agg(
        *[
            _side(side, field).alias(f"{side}_{field}")
            for side in ("source", "target")
            for field in ("n", "mean", "var")
        ]
    )


def mean_shift(source_mean: Column, target_mean: Column) -> Column:
    return squared_gap(target_mean, source_mean)


def scale_shift(source_var: Column, target_var: Column) -> Column:
    ratio = F.zip_with(target_var, source_var, lambda t, s: F.sqrt((t + EPS) / (s + EPS)) - 1.0)
    return array_sum(F.transform(ratio, lambda r: r * r))


def mean_scale_shift(vectors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    both = paired_moments(vectors, keys)
    return both.select(
        *keys,
        mean_shift(F.col("source_mean"), F.col("target_mean")).alias("mean_shift"),
        scale_shift(F.col("source_var"), F.col("target_var")).alias("scale_shift"),
    )


def diagonal_distance(vector: Column, mean: Column, var: Column) -> Column:
    """Distance of one vector from a diagonal Gaussian."""
    terms = F.zip_with(
        F.zip_with(doubles(vector), mean, lambda x, m: (x - m) * (x - m)),
        var,
        lambda sq, v: sq / (v + EPS),
    )
    return F.sqrt(array_sum(terms))


def packed_moments(vectors: DataFrame) -> Column:
    """Moments of both sides as one scalar subquery; equal uses of it run once."""
    both = paired_moments(vectors)
    return both.select(F.struct(*both.columns).alias("m")).scalar()


def distance_profile(vectors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population spread of the distance of every target vector from the source.

    Without keys the source moments enter as a scalar subquery, so the target
    side is scanned once with no join; with keys they join on those keys.
    """
    target = vectors.filter("side = 'target' and embedding is not null").select(*keys, "embedding")
    if keys:
        source = moments(vectors.filter("side = 'source'"), keys)
        placed = target.join(source.select(*keys, "mean", "var"), list(keys))
        stats = (F.col("mean"), F.col("var"))
    else:
        placed = target.withColumn("m", packed_moments(vectors))
        stats = (F.col("m.source_mean"), F.col("m.source_var"))
    dist = diagonal_distance(F.col("embedding"), *stats)
    return (
        placed.select(*keys, dist.alias("dist"))
        .groupBy(*keys)
        .agg(F.avg("dist").alias("dist_mean"), F.stddev_pop("dist").alias("dist_std"))
    )


def _slot_borders(vectors: DataFrame, values: Column, slots: int) -> np.ndarray:
    """Quantiles of a small sample per direction; at most directions x slots numbers reach the driver."""
    total = vectors.count()
    fraction = min(1.0, BORDER_SAMPLE / max(total, 1))
    grid = [i / slots for i in range(1, slots)]
    rows = (
        vectors.sample(fraction, seed=11)
        .select(F.posexplode_outer(values).alias("dir", "p"))
        .groupBy("dir")
        .agg(F.percentile_approx("p", grid, 10_000).alias("borders"))
        .orderBy("dir")
        .collect()
    )
    return np.array([row["borders"] for row in rows])


def rank_runs(
    vectors: DataFrame,
    directions: np.ndarray | dict,
    keys: Sequence[str] = (),
    slots: int | None = None,
) -> DataFrame:
    """Projected values with the half-open rank interval they take on their side.

    Columns: keys, ``dir``, ``side``, ``p``, ``lo``, ``hi``.  Vectors are projected
    where they are read and only numbers move: equal values of a direction are
    counted in the map tasks, so a third of all rows being copies of one vector
    costs one row per direction and task.  Long directions are sorted slot by
    slot: slot totals give each slot its starting rank.

    The outer form of explode is used throughout because the plain form makes
    the optimizer add a size filter that evaluates the projection once more.
    """
    known = vectors.filter(F.col("embedding").isNotNull())
    weight = F.count(F.lit(1)).alias("w")
    if slots is None:
        slots = max(1, vectors.count() // ROWS_PER_SLOT)
    values = _project(keys, directions)
    if slots == 1:
        # Both sides of a direction land in the same task: one exchange serves every later window.
        lines = (
            known.select(*keys, "side", F.posexplode_outer(values).alias("dir", "p"))
            .groupBy(*keys, "side", "dir", "p")
            .agg(weight)
            .repartition(*keys, "dir")
        )
        order = Window.partitionBy(*keys, "dir", "side").orderBy("p")
        hi = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return lines.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("w"))
    borders = _slot_borders(known, values, slots)
    spot = [*keys, "dir", "side", "slot"]
    lines = (
        known.withColumn("ps", values)
        .withColumn("zipped", F.arrays_zip("ps", slot_of(F.col("ps"), borders).alias("slots")))
        .select(*keys, "side", F.posexplode_outer("zipped").alias("dir", "z"))
        .select(*keys, "side", "dir", F.col("z.ps").alias("p"), F.col("z.slots").alias("slot"))
        .filter("slot is not null")
        .groupBy(*spot, "p")
        .agg(weight)
        .repartition(*spot)
    )
    before = Window.partitionBy(*keys, "dir", "side").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        lines.groupBy(*spot)
        .agg(F.sum("w").alias("slot_total"), F.max("p").alias("slot_top"))
        .withColumn("offset", F.coalesce(F.sum("slot_total").over(before), F.lit(0)))
        .drop("slot_total")
    )
    order = Window.partitionBy(*spot).orderBy("p")
    inside = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The (always true) check against slot_top keeps p in both branches, so that the totals
    # read the same exchange as the window instead of projecting every vector again.
    return (
        lines.withColumn("upto", inside)
        .join(offsets, spot)
        .filter("p <= slot_top")
        .withColumn("hi", F.col("offset") + F.col("upto"))
        .withColumn("lo", F.col("hi") - F.col("w"))
        .select(*keys, "side", "w", "dir", "p", "hi", "lo")
    )


def direction_gaps(runs: DataFrame, keys: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """Root mean square gap between equal ranks of both sides, per key and direction.

    The two sides are step functions over ranks.  Walking their breakpoints in
    order pairs them without a join: the last seen value of each side holds
    until the next breakpoint.  Ranks beyond the shorter side are left out.
    ``block`` cuts the rank axis so that no walk covers more than that many ranks.
    """
    if block:
        first, last = F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}")
        runs = (
            runs.withColumn("blk", F.explode(F.sequence(first, last)))
            .withColumn("lo", F.greatest("lo", F.col("blk") * block))
            .withColumn("hi", F.least("hi", (F.col("blk") + 1) * block))
        )
        walk_keys = [*keys, "dir", "blk"]
    else:
        walk_keys = [*keys, "dir"]
    order = Window.partitionBy(*walk_keys).orderBy("lo")
    seen = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = lambda side: F.last(
        F.when(F.col("side") == side, F.struct("p", "hi")), ignorenulls=True
    ).over(seen)
    walked = runs.select(
        *keys,
        "dir",
        "lo",
        latest("source").alias("s"),
        latest("target").alias("t"),
        F.lead("lo").over(order).alias("next_lo"),
    )
    # least() skips nulls, so the last breakpoint runs to the nearer end of the two sides.
    width = F.greatest(F.least("next_lo", "s.hi", "t.hi") - F.col("lo"), F.lit(0))
    gap = F.col("t.p") - F.col("s.p")
    return (
        walked.filter("s is not null and t is not null")
        .select(*keys, "dir", width.alias("width"), (gap * gap).alias("sq"))
        .filter("width > 0")
        .groupBy(*keys, "dir")
        .agg(F.sqrt(F.sum(F.col("sq") * F.col("width")) / F.sum("width")).alias("gap"))
    )


def sliced_distance(
    vectors: DataFrame,
    directions: np.ndarray | dict,
    keys: Sequence[str] = (),
    slots: int | None = None,
) -> DataFrame:
    """Sliced Wasserstein distance with ranks cut to the shorter side.

    ``directions`` is one matrix for all, or one per value of the only key.
    """
    if slots is None:
        slots = max(1, vectors.count() // ROWS_PER_SLOT)
    runs = rank_runs(vectors, directions, keys, slots)
    gaps = direction_gaps(runs, keys, block=ROWS_PER_SLOT if slots > 1 else None)
    return gaps.groupBy(*keys).agg(F.coalesce(F.avg("gap"), F.lit(0.0)).alias("swd"))


def sliced_distance_by_quantile(
    vectors: DataFrame,
    directions: np.ndarray,
    keys: Sequence[str] = (),
    points: int = 200,
    accuracy: int = 10_000,
) -> DataFrame:
    """Variant that matches quantiles instead of cutting ranks: unbiased for unequal sizes.

    Approximate percentiles are merged sketches, so nothing is sorted or shuffled row by row.
    """
    grid = [(i + 0.5) / points for i in range(points)]
    lines = vectors.filter(F.col("embedding").isNotNull()).select(
        *keys, "side", F.posexplode_outer(project(F.col("embedding"), directions)).alias("dir", "p")
    )
    pick = lambda side: F.percentile_approx(F.when(F.col("side") == side, F.col("p")), grid, accuracy)
    both = lines.groupBy(*keys, "dir").agg(pick("source").alias("s"), pick("target").alias("t"))
    gap = F.sqrt(squared_gap(F.col("t"), F.col("s")) / points)
    return both.groupBy(*keys).agg(F.coalesce(F.avg(gap), F.lit(0.0)).alias("swd"))


def joint_subsample(vectors: DataFrame, cap: int, id_cols: Sequence[str], seed: int = 0) -> DataFrame:
    """At most ``cap`` vectors of both sides together, picked by hash order."""
    return smallest_by_hash(vectors, cap, id_cols=id_cols, seed=seed)


def pca_directions(vectors: DataFrame, k: int) -> np.ndarray:
    """Principal directions of all given vectors, largest loading made positive.

    The covariance is a distributed sum; only its D x D matrix reaches the driver.
    """
    if k <= 0:
        return np.zeros((0, dimension_of(vectors)))
    frame = vectors.filter(F.col("embedding").isNotNull()).select(
        array_to_vector(doubles(F.col("embedding"))).alias("v")
    )
    k = min(k, dimension_of(vectors))
    loadings = PCA(k=k, inputCol="v", outputCol="o").fit(frame).pc.toArray().T
    return fix_signs(loadings)


def pca_directions_by_key(
    vectors: DataFrame, key: str, k: int, shared: DataFrame | None = None
) -> dict[object, np.ndarray]:
    """Principal directions of the vectors of every key.

    Each task sums outer products per key, the sums add up in one shuffle and
    are solved where they land; keys x k directions reach the driver.  The
    vectors of ``shared`` count for every key but are summed only once.
    """
    dim = dimension_of(vectors)
    if dim > MAX_KEYED_DIM:
        return _sketched_directions(vectors, key, min(k, dim), dim, shared)
    known = F.col("embedding").isNotNull()
    summed = lambda df, *by: df.groupBy(*by).agg(
        vector_to_array(Summarizer.sum(array_to_vector("moments"))).alias("moments")
    )
    per_key = summed(second_moments(vectors.filter(known), key, dim), key)
    if shared is not None:
        once = second_moments(shared.filter(known).select(F.lit(0).alias("all"), "embedding"), "all", dim)
        per_key = per_key.withColumn("base", summed(once).scalar()).withColumn(
            "moments", F.zip_with("moments", "base", lambda a, b: a + b)
        )
    k = min(k, dim)
    solved = per_key.select(key, leading_directions(F.col("moments"), dim, k).alias("flat"))
    found = {row[key]: np.array(row["flat"]).reshape(k, dim) for row in solved.collect()}
    return found


def _sketched_directions(
    vectors: DataFrame, key: str, k: int, dim: int, shared: DataFrame | None
) -> dict[object, np.ndarray]:
    """Principal directions of wide vectors by subspace iteration.

    Every pass multiplies each key's covariance with a basis of a few directions, as one sum of
    D x (k + few) numbers per key; only these sums reach the driver.
    """
    known = F.col("embedding").isNotNull()
    width = min(dim, k + SKETCH_EXTRA)
    start = np.linalg.qr(unit_directions(dim, width, 1).T)[0].T
    names = [row[key] for row in vectors.filter(known).select(key).distinct().collect()]
    bases = {name: start for name in names}
    frame = cut_lineage(vectors.filter(known).select(key, "embedding"))
    common = None
    if shared is not None and names:
        common = shared.filter(known).select(F.lit(names[0]).cast(frame.schema[key].dataType).alias(key), "embedding")
    found: dict[object, np.ndarray] = {}
    for step in range(SKETCH_PASSES if names else 0):
        sums = sketched_moments(frame, key, dim, bases)
        if common is not None:
            sums = sums.unionByName(sketched_moments(common, key, dim, bases, shared=True))
        total = sums.groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector("moments"))).alias("moments"))
        for row in total.toLocalIterator():
            packed = np.array(row["moments"])
            n, mean = packed[0], packed[1 : 1 + dim] / packed[0]
            basis = bases[row[key]]
            spread = packed[1 + dim :].reshape(dim, width) / n - np.outer(mean, basis @ mean)
            if step == SKETCH_PASSES - 1:
                # The covariance within the basis is small enough to be solved here.
                turn = np.linalg.eigh((basis @ spread + (basis @ spread).T) / 2)[1][:, ::-1].T[:k]
                found[row[key]] = fix_signs(turn @ basis)
            else:
                bases[row[key]] = np.linalg.qr(spread)[0].T
    return found


def _project(keys: Sequence[str], directions: np.ndarray | dict) -> Column:
    if isinstance(directions, dict):
        return project_by_key(F.col(keys[0]), F.col("embedding"), directions)
    return project(F.col("embedding"), directions)


def sliced_distance_hybrid(
    vectors: DataFrame,
    pca_k: int = 8,
    rand_r: int = 16,
    subsample: int | None = None,
    id_cols: Sequence[str] = ("embedding",),
    keys: Sequence[str] = (),
    seed: int = 0,
) -> DataFrame:
    """Sliced distance over principal directions followed by random ones.

    With a key every pair gets principal directions of its own, from all its vectors.
    """
    random = unit_directions(dimension_of(vectors), rand_r, seed)
    if keys:
        (key,) = keys
        principal = pca_directions_by_key(vectors, key, pca_k)
        own = {name: np.concatenate([rows, random], axis=0) for name, rows in principal.items()}
        return sliced_distance(vectors, own, keys)
    pool = joint_subsample(vectors, subsample, id_cols, seed) if subsample else vectors
    return sliced_distance(vectors, np.concatenate([pca_directions(pool, pca_k), random], axis=0))


def delta(
    vectors: DataFrame,
    slices: int = 64,
    keys: Sequence[str] = (),
    *,
    hybrid: bool = False,
    pca_k: int = 8,
    rand_r: int = 16,
    subsample: int | None = None,
    id_cols: Sequence[str] = ("embedding",),
    seed: int = 0,
) -> DataFrame:
    """The five descriptors, one row per key (one row in all without keys)."""
    if hybrid:
        swd = sliced_distance_hybrid(vectors, pca_k, rand_r, subsample, id_cols, keys, seed)
    else:
        swd = sliced_distance(vectors, unit_directions(dimension_of(vectors), slices, seed), keys)
    spread = distance_profile(vectors, keys)
    if keys:
        out = mean_scale_shift(vectors, keys).join(spread, list(keys), "left")
        return out.join(swd, list(keys), "left").select(*keys, *DESCRIPTORS)
    m = lambda field: F.col(f"m.{field}")
    return spread.withColumns({"m": packed_moments(vectors), "swd": swd.scalar()}).select(
        mean_shift(m("source_mean"), m("target_mean")).alias("mean_shift"),
        scale_shift(m("source_var"), m("target_var")).alias("scale_shift"),
        "dist_mean",
        "dist_std",
        "swd",
    )


def shift_report(
    vectors: DataFrame,
    kept: Sequence[str] = ("source", "target"),
    **options,
) -> DataFrame:
    """Counts of used and skipped vectors per side followed by the descriptors."""
    used = F.col("embedding").isNotNull()
    counts = vectors.agg(
        *[F.count_if((F.col("side") == s) & used).alias(f"{s}_count") for s in kept],
        *[F.count_if((F.col("side") == s) & ~used).alias(f"{s}_skipped") for s in kept],
    )
    found = delta(vectors, **options)
    row = found.select(F.struct(*found.columns).alias("r")).scalar()
    return counts.withColumn("r", row).select(*counts.columns, "r.*")
