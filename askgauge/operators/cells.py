"""Filters and profiles over the cell table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgauge.functions.text import detect_language
from askgauge.session import cut_lineage, small_side

# Slots that tell values of like frequency apart.
RARITY_SLOTS = 4096


def table_profile(cells: DataFrame) -> DataFrame:
    """Rows and columns of each table; every row has a cell in column 0."""
    return cells.groupBy("table_id").agg(
        F.count_if(F.col("col_idx") == 0).alias("n_rows"),
        (F.max("col_idx") + 1).cast("bigint").alias("n_cols"),
    )


def structural_filter(cells: DataFrame, min_rows: int = 5, min_cols: int = 5) -> DataFrame:
    """Tables with enough rows and columns."""
    return table_profile(cells).filter((F.col("n_rows") >= min_rows) & (F.col("n_cols") >= min_cols))


def table_headers(cells: DataFrame) -> DataFrame:
    """Header of each table as one array, in column order.

    Names repeat on every row, so they are made distinct in the map tasks first
    (a hash aggregate; an aggregate function over text would sort the rows).
    """
    columns = cells.select("table_id", "col_idx", "col_name").distinct()
    return columns.groupBy("table_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("col_idx", "col_name"))), lambda c: c["col_name"]
        ).alias("header")
    )


def canonical_header(header: Column, joiner: str) -> Column:
    return F.array_join(F.transform(header, lambda h: F.lower(F.trim(h))), joiner)


def header_hash(headers: DataFrame) -> DataFrame:
    """Fingerprint under which equal headers meet, whatever their case and outer blanks."""
    return headers.select("table_id", F.sha1(canonical_header(F.col("header"), "\t")).alias("header_hash"))


def english_tables(headers: DataFrame, first: int | None = None) -> DataFrame:
    """Tables where at least one header (of the first so many, if given) reads as English."""
    looked = F.col("header") if first is None else F.slice("header", 1, first)
    words = F.transform(looked, lambda h: F.regexp_replace(h, r"[_\W]+", " "))
    hit = F.exists(words, lambda h: F.coalesce(detect_language(h) == "en", F.lit(False)))
    return headers.filter(hit).select("table_id")


def _words(low: Column) -> Column:
    """Words of a lower-case cell.  Most cells are one word and skip the pattern split."""
    several = F.filter(F.split(low, r"\s+"), lambda t: t != "")
    return F.when(low.rlike(r"\s"), several).when(low != "", F.array(low))


def semantic_richness(cells: DataFrame) -> DataFrame:
    """Distinct words per cell, at most 1.

    One pass: the first word of a cell, or its blank, carries the cell's mark.  Marks are
    summed per (table, word) before they meet by table, so one huge table spreads
    over all tasks.  A missing cell counts as the word ``nan``.
    """
    # The outer form: a plain explode makes the optimizer split every cell once more to test it.
    low = cells.select("table_id", F.lower(F.coalesce("value", F.lit("nan"))).alias("low"))
    words = low.select("table_id", F.posexplode_outer(_words(F.col("low"))).alias("pos", "word"))
    mark = F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0)).alias("marks")
    return (
        words.groupBy("table_id", "word")
        .agg(mark)
        .groupBy("table_id")
        .agg(F.sum("marks").alias("n_cells"), F.count("word").alias("n_words"))
        .select("table_id", F.least(F.lit(1.0), F.col("n_words") / F.col("n_cells")).alias("richness"))
    )


def rich_tables(cells: DataFrame, min_semantic: float = 0.02) -> DataFrame:
    return semantic_richness(cells).filter(F.col("richness") >= min_semantic)


def curated_cells(
    cells: DataFrame, min_rows: int = 5, min_cols: int = 5, min_semantic: float = 0.02
) -> DataFrame:
    """Cells of the tables that pass all three filters."""
    keep = (
        structural_filter(cells, min_rows, min_cols)
        .select("table_id")
        .join(english_tables(table_headers(cells)), "table_id", "left_semi")
        .join(rich_tables(cells, min_semantic), "table_id", "left_semi")
    )
    return cells.join(keep, "table_id", "left_semi")


def first_rows(cells: DataFrame, count: int) -> DataFrame:
    """Cells of the first ``count`` rows of each table.

    Rows are ranked once per table, not per cell, and the rank limit is pushed
    below the shuffle, so at most ``count`` row keys per table leave each task.
    The last key kept then filters the cells where they are.
    """
    order = Window.partitionBy("table_id").orderBy("row_idx")
    rows = cells.filter("col_idx = 0").select("table_id", "row_idx")
    last = (
        rows.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= count)
        .groupBy("table_id")
        .agg(F.max("row_idx").alias("_last"))
    )
    return cells.join(small_side(last), "table_id").filter("row_idx <= _last").drop("_last")


def rarity_order(df: Column, value: Column) -> Column:
    """Place of a value in one order for all columns: rare values first by powers of two, then by hash."""
    level = F.floor(F.log2(F.greatest(df, F.lit(1)).cast("double"))).cast("bigint")
    return level * RARITY_SLOTS + F.pmod(F.xxhash64(value), F.lit(RARITY_SLOTS))


def rare_ends(values: DataFrame, many: Column) -> DataFrame:
    """Where each column's ``many`` rarest values end in the order: ``table_id, col_idx, last``.

    Counted in a histogram over the order (formed in the map tasks, some RARITY_SLOTS rows for each
    power of two at most), so no task sorts a column's values. Values that share the last slot all count in.
    """
    slots = values.groupBy("table_id", "col_idx", "order").agg(F.count(F.lit(1)).alias("n"), F.max(many).alias("many"))
    before = Window.partitionBy("table_id", "col_idx").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    reached = slots.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return reached.filter("before < many").groupBy("table_id", "col_idx").agg(F.max("order").alias("last"))


def infer_foreign_keys(
    cells: DataFrame, sample: int | None = None, overlap: float = 0.8, within: Sequence[str] = ()
) -> DataFrame:
    """Column pairs of two tables whose values overlap by more than ``overlap`` of the smaller
    set.  With ``sample`` only that many first rows of each table are compared.

    Candidates come from the rare end of each column: two sets can only overlap
    that much if the larger one holds one of the smaller one's rarest values,
    so values found everywhere rarely pair columns up.  Candidates are then
    counted exactly.  ``within`` limits pairs to equal values of those columns
    (for example one database).
    """
    values = (
        (cells if sample is None else first_rows(cells, sample))
        .select(*within, "table_id", "col_idx", "col_name", F.coalesce("value", F.lit("nan")).alias("value"))
        .distinct()
    )
    # Distinct values, read by several joins below.
    values = cut_lineage(values)
    sizes = values.groupBy(*within, "table_id", "col_idx").agg(F.count(F.lit(1)).alias("size"))
    spread = values.groupBy(*within, "value").agg(F.count(F.lit(1)).alias("df"))
    need = F.greatest(F.lit(1), F.floor(F.col("size") * overlap))
    ordered = cut_lineage(
        values.join(spread, [*within, "value"])
        .join(sizes, [*within, "table_id", "col_idx"])
        .withColumn("order", rarity_order(F.col("df"), F.col("value")))
    )
    rare = (
        ordered.join(rare_ends(ordered, F.col("size") - need + 1), ["table_id", "col_idx"])
        .filter("order <= last")
        .select(*within, "value", F.col("table_id").alias("t_a"), F.col("col_idx").alias("c_a"), F.col("size").alias("n_a"))
    )
    held = values.join(sizes, [*within, "table_id", "col_idx"]).select(
        *within, "value", F.col("table_id").alias("t_b"), F.col("col_idx").alias("c_b"), F.col("size").alias("n_b")
    )
    pairs = (
        rare.join(held, [*within, "value"])
        .filter("t_a <> t_b and n_a <= n_b")
        .select("t_a", "c_a", "n_a", "t_b", "c_b")
        .distinct()
    )
    # Each pair once per order of tables; equal-sized columns surface from both ends.
    a_first = F.col("t_a") < F.col("t_b")
    ends = lambda p, q: F.when(a_first, F.col(p)).otherwise(F.col(q))
    pairs = (
        pairs.select(
            ends("t_a", "t_b").alias("left_table"),
            ends("c_a", "c_b").alias("left_idx"),
            ends("t_b", "t_a").alias("right_table"),
            ends("c_b", "c_a").alias("right_idx"),
            F.col("n_a").alias("smaller"),
            a_first.alias("from_left"),
        )
        .groupBy("left_table", "left_idx", "right_table", "right_idx", "smaller")
        .agg(F.max("from_left").alias("from_left"))
    )
    # The smaller column's values look for themselves in the larger one: a pair costs no more rows than that.
    of = lambda p, q: F.when(F.col("from_left"), F.col(p)).otherwise(F.col(q))
    asked = pairs.select(
        "*",
        of("left_table", "right_table").alias("few_table"),
        of("left_idx", "right_idx").alias("few_idx"),
        of("right_table", "left_table").alias("many_table"),
        of("right_idx", "left_idx").alias("many_idx"),
    )
    end = lambda side: values.select(
        F.col("table_id").alias(f"{side}_table"),
        F.col("col_idx").alias(f"{side}_idx"),
        F.col("col_name").alias(f"{side}_column"),
        "value",
    )
    return (
        asked.join(end("few"), ["few_table", "few_idx"])
        .join(end("many"), ["many_table", "many_idx", "value"])
        .withColumn("left_column", of("few_column", "many_column"))
        .withColumn("right_column", of("many_column", "few_column"))
        .groupBy("left_table", "left_column", "right_table", "right_column", "smaller")
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter(F.col("shared") / F.col("smaller") > overlap)
        .select(
            "left_table",
            "left_column",
            "right_table",
            "right_column",
            "shared",
            (F.col("shared") / F.col("smaller")).alias("overlap"),
        )
    )
