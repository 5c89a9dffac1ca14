"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_table, stored

WORD = r"[^\x20\x09-\x0D]+"
#: A source's rows are spread over this many hash buckets; only the bucket at the cut is ordered.
BUCKETS_LOG2 = 12
HASH_BITS = 60


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank, tab, line and page breaks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(key: Column, seed: int) -> Column:
    """A seeded hash of 60 bits that other engines can compute as well."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, HASH_BITS // 4), 16, 10).cast("long")


def numbered(df: DataFrame, order: str, parts: int = 8) -> DataFrame:
    """Add ``place``: 0, 1, ... in the order of one column of distinct values, without one big sort task.

    Only the row counts of the ranges reach the driver.
    """
    ranged = df.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    sizes = dict(ranged.groupBy("part").count().collect())
    before, total = [], 0
    for part in sorted(sizes):
        before += [F.lit(part), F.lit(total).cast("long")]
        total += sizes[part]
    start = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0).cast("long")
    at = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("place", (at + start).cast("long")).drop("part")


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """Add ``target`` to rows (size, weight, cap): weight shares of total, clamped at cap.

    Each round clamps the sources above their cap and shares the rest by weight among the others, until
    none is above. A round is one aggregate over the sources, so any number of them may exist; the
    level only rises, hence a clamped source stays clamped and the rounds end. If all are clamped, the
    caps are the targets. Empty sources and sources of weight 0 get 0.
    """
    level, clamped = None, -1
    open_ = F.col("weight") > 0
    while True:
        over = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * F.lit(level)
        row = sources.where(open_).agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.coalesce(F.sum(over.cast("long")), F.lit(0)).alias("n"),
        ).first()
        if row["n"] == clamped or not row["weight"]:
            break
        clamped, level = row["n"], (total - row["used"]) / row["weight"]
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn("target", F.when(open_, F.least(F.col("cap"), F.col("weight") * F.lit(level))).otherwise(F.lit(0.0)))


def _source(column: str = "source") -> Column:
    """Source as a key that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit("t"))


_PLACE = ("h", "size", "tie")


def _measured(docs: DataFrame, seed: int, key: str) -> DataFrame:
    """Add src, size, and the place in hash order (h, size, tie) to a frame with columns key, text and source."""
    text = F.col("text").cast("string")
    return docs.withColumns({"src": _source(), "size": word_count(text), "h": row_hash(F.col(key), seed), "tie": F.xxhash64(text)})


def mix_plan(base: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """One row per source: source_size, target, rounds (whole repetitions) and where in hash order the rest ends.

    ``base`` holds src, h, size and tie. A source's rows are summed by hash bucket; only the bucket in which the
    target falls is ordered. Every row whose (h, size, tie) comes up to (cut_b, cut) is taken once more.
    """
    bucket = F.shiftright("h", HASH_BITS - BUCKETS_LOG2)
    cells = stored(base.groupBy("src", bucket.alias("b")).agg(F.sum("size").alias("words")), "mix-cells")
    sources = cells.groupBy("src").agg(F.sum("words").alias("source_size"))
    all_words = cells.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    ranked = numbered(sources, "src")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    filled = water_fill(ranked, share * all_words)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = stored(filled.withColumn("rounds", rounds).withColumn("need", F.col("target") - F.col("rounds") * F.col("source_size")).select("src", "source_size", "target", "rounds", "need"), "mix-targets")
    up_to = Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0))).join(plan, "src")
    # The first bucket that does not fit whole.
    cut = cells.where(F.col("before") + F.col("words") > F.col("need")).groupBy("src").agg(F.min(F.struct("b", "before", "need")).alias("c"))
    cut = stored(cut.select("src", F.col("c.b").alias("b"), F.col("c.before").alias("before"), F.col("c.need").alias("need")), "mix-cuts")
    run = Window.partitionBy("src", "b").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    at_cut = base.withColumn("b", bucket).join(cut, ["src", "b"])
    ahead = F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0))
    # Up to the row whose middle lies before the target: the nearest place to cut.
    inside = at_cut.withColumn("ahead", ahead).where(F.col("ahead") * 2 + F.col("size") <= F.col("need") * 2)
    last = inside.groupBy("src").agg(F.max(F.struct(*_PLACE)).alias("cut"))
    return stored(plan.drop("need").join(cut.select("src", F.col("b").alias("cut_b")), "src", "left").join(last, "src", "left"), "mix-plan")


def copies_taken() -> Column:
    """How often the mix takes a row with h, size and tie, given its source's plan."""
    bucket = F.shiftright("h", HASH_BITS - BUCKETS_LOG2)
    more = F.col("cut_b").isNull() | (bucket < F.col("cut_b")) | ((bucket == F.col("cut_b")) & F.coalesce(F.struct(*_PLACE) <= F.col("cut"), F.lit(False)))
    return F.col("rounds") + more.cast("long")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """Per document: size in words, source_size, its source's target, and how often the mix takes it.

    Sources, in code point order with null last, get the weights in turn; all targets together are
    ``share`` of all words, none above ``max_epochs`` of its source (``water_fill``). A source is taken
    whole as often as its target allows; the rest comes from its documents in seeded hash order, up to
    the document nearest to the target. Rows with equal keys are ordered by size and text hash, and rows
    that are equal in all of this are taken alike. Empty documents have size 0. Other columns take no part.

    Columns: key, size, source_size, target, copies, taken (words: copies x size).
    """
    base = stored(_measured(docs.select(F.col(key).alias("id"), "text", "source"), seed, "id").select("id", "src", *_PLACE), "mix-sizes")
    out = base.join(mix_plan(base, weights, share, max_epochs), "src").withColumn("copies", copies_taken())
    return out.select(F.col("id").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """The mix itself: every row of docs with all its columns, as often as ``mix_sources`` takes it.

    Texts are joined with one row per source; nothing but sizes and hashes is shuffled unless there are
    too many sources to broadcast them.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("id"), "text", "source")
    rows = _measured(packed, seed, "id").select("row", "src", *_PLACE)
    plan = mix_plan(stored(rows.select("src", *_PLACE), "mix-sizes"), weights, share, max_epochs)
    taken = rows.join(plan, "src").withColumn("copies", copies_taken()).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce('s' || source, 't') AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
    FROM documents
), sources AS (
    SELECT src, sum(size)::DOUBLE AS s, 2.0 * sum(size) AS cap, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY src) - 1) % 3 + 1]::DOUBLE AS w
    FROM docs GROUP BY src
), levels AS (
    SELECT 0 AS k, 1.5 * sum(s) / sum(w) AS level, 0 AS n FROM sources
    UNION ALL
    SELECT k + 1, (SELECT (1.5 * sum(s) - coalesce(sum(cap) FILTER (cap <= w * level), 0)) / sum(w) FILTER (NOT cap <= w * level) FROM sources),
        (SELECT count(*) FROM sources WHERE cap <= w * level)
    FROM levels WHERE k < 50 AND level IS NOT NULL
), last AS (SELECT max(level) AS level FROM levels),
plan AS (
    SELECT src, s, least(cap, w * level) AS target, floor(least(cap, w * level) / s) AS rounds FROM sources, last
), placed AS (
    SELECT d.*, p.s, p.target, p.rounds, p.target - p.rounds * p.s AS need,
        coalesce(sum(size) OVER (PARTITION BY src ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM docs d JOIN plan p USING (src)
)
SELECT doc_id, size, s::BIGINT AS source_size, target,
    (size * (rounds + CASE WHEN 2 * ahead + size <= 2 * need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
