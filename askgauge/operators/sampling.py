"""Repeatable sampling, hold-out splits and subset-level training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgauge.session import cut_lineage, small_side

# Hash ranks are resolved through a histogram over this many leading hex digits.
HEX_DIGITS = 3


def draw_hash(seed: int, *cols: Column | str) -> Column:
    """Hex digest that orders rows at random but the same way under any partitioning."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    text = [p.cast("string") for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *text))


def _pick_smallest(df: DataFrame, by: Sequence[str], size: Column) -> DataFrame:
    """Keep, per ``by`` group, the ``size`` rows of smallest ``_h``; exact at any group size.

    A histogram of the leading hash digits tells which buckets the sample can
    come from; all other rows are dropped where they are read.  Rows are ranked
    inside their bucket only, so no task ever sorts a whole group.
    """
    bucketed = df.withColumn("_b", F.substring("_h", 1, HEX_DIGITS))
    order = Window.partitionBy(*by, "_all").orderBy("_b")
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # At most 16^HEX_DIGITS rows per group.
    histogram = (
        bucketed.groupBy(*by, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_all", F.lit(0))
        .withColumn("_before", upto - F.col("_n"))
        .filter(F.col("_before") < size)
        .select(*by, "_b", (size - F.col("_before")).alias("_left"))
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_h", *_tie(df, by))
    return (
        bucketed.join(small_side(histogram), [*by, "_b"])
        .withColumn("_r", F.row_number().over(inside))
        .filter("_r <= _left")
        .drop("_b", "_left", "_r")
    )


def _tie(df: DataFrame, by: Sequence[str]) -> list[str]:
    return [c for c, kind in df.dtypes if c not in by and c != "_h" and not kind.startswith("map")]


def smallest_by_hash(
    df: DataFrame, size: int, id_cols: Sequence[str], seed: int = 0
) -> DataFrame:
    """Exactly ``min(size, rows)`` rows in hash order of their ids."""
    hashed = df.withColumn("_h", draw_hash(seed, *id_cols))
    return _pick_smallest(hashed, [], F.lit(size)).drop("_h")


def sample_sets(
    records: DataFrame, num_sets: int, size: int, id_col: str = "rec_id", seed: int = 0
) -> DataFrame:
    """``num_sets`` independent subsets of ``size`` records without replacement.

    Every set orders the records by its own hash, so each membership depends on
    (seed, set, record) alone.  Raises if a subset would need more records than exist.
    """
    have = records.count()
    if size > have:
        raise ValueError(f"subset size {size} exceeds the {have} records")
    share = 1.25 * size / max(have, 1) + 20 / max(have, 1)
    while True:
        # Most records are out of most sets: only those under the cut leave the array.
        cut = F.lit(f"{min(int(share * 16**12), 16**12 - 1):012x}") if share < 1 else None
        every = F.sequence(F.lit(0), F.lit(num_sets - 1))
        drawn = lambda s: F.struct(s.alias("set_id"), draw_hash(seed, s, F.col(id_col)).alias("_h"))
        pairs = F.transform(every, drawn)
        if cut is not None:
            pairs = F.filter(pairs, lambda p: F.substring(p["_h"], 1, 12) < cut)
        # Stored: the draws are read for counting, for the histogram and for the sets themselves.
        tries = cut_lineage(records.select(F.inline(pairs), F.col(id_col).alias("rec_id")))
        if cut is None:
            break
        enough = tries.groupBy("set_id").count().filter(F.col("count") >= size).count() == num_sets
        if enough or size == 0:
            break
        share *= 2
    return _pick_smallest(tries, ["set_id"], F.lit(size)).select("set_id", "rec_id")


def cut_sets(membership: DataFrame) -> DataFrame:
    """Store the drawn sets (sets x size rows) so that later joins do not draw them again."""
    return cut_lineage(membership)


def set_accuracy(membership: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Mean accuracy of every subset (``accuracy`` holds ``rec_id, accuracy``)."""
    return (
        membership.join(accuracy.select("rec_id", "accuracy"), "rec_id")
        .groupBy("set_id")
        .agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    )


def holdout_size(n: Column) -> Column:
    """Rows held out for calibration: a fifth, but at least two, rounded up as a share of n."""
    share = F.least(F.lit(0.2), F.greatest(F.lit(2), F.floor(n * F.lit(0.2))) / n)
    return F.ceil(F.round(share * n, 9)).cast("bigint")


def holdout_split(df: DataFrame, id_cols: Sequence[str], seed: int = 0) -> DataFrame:
    """Add ``is_holdout``; the split has an exact size and repeats run after run."""
    hashed = df.withColumn("_h", draw_hash(seed, *id_cols))
    size = df.agg(holdout_size(F.count(F.lit(1))).alias("k")).scalar()
    # The last row held out is one value; every row compares itself with it.
    place = F.struct("_h", *id_cols)
    last = _pick_smallest(hashed.select(*id_cols, "_h"), [], size).agg(F.max(place).alias("last")).scalar()
    return hashed.withColumn("is_holdout", F.coalesce(place <= last, F.lit(False))).drop("_h")
