"""Execution accuracy: run gold and predicted queries and compare their result bags."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from functools import reduce
from itertools import count, islice

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgauge.functions.text import or_blank, sql_key
from askgauge.session import scratch_path

DECIMALS = 6
# Doubles above this size keep their own text form instead of the fixed-point one.
FIXED_POINT_LIMIT = 1e30
BATCH = 16
# Plans that are remembered to find equal ones.
FOLDED_PLANS = 1024
STATUS_SCHEMA = "query_id string, error string"
DIGEST_SCHEMA = "query_id string, n bigint, head decimal(38,0), tail decimal(38,0)"

# Runs one query text of one database: (db_id, sql) -> DataFrame, or raises.
Runner = Callable[[str, str], DataFrame]


def cell_key(name: str, kind: T.DataType) -> str:
    """SQL text that gives the typed text of one result cell: numbers by value at six
    places, texts tagged, null apart.

    Written as SQL text because a workload builds it for every column of every query.
    """
    col = f"`{name}`"
    fixed = lambda x: f"concat('n', cast(cast({x} as decimal(38,{DECIMALS})) as string))"
    if isinstance(kind, T.BooleanType):
        out = fixed(f"cast({col} as int)")
    elif isinstance(kind, T.DecimalType):
        out = fixed(f"round({col}, {DECIMALS})")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        number = f"cast({col} as double)"
        plain = f"not isnan({number}) and abs({number}) < {FIXED_POINT_LIMIT}"
        rounded = fixed(f"round({number}, {DECIMALS})")
        out = f"case when {plain} then {rounded} else concat('f', cast({number} as string)) end"
    elif isinstance(kind, T.IntegralType):
        out = fixed(col)
    elif isinstance(kind, T.BinaryType):
        out = f"concat('b', hex({col}))"
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = rf"replace(to_json(struct({col} as v)), '\u001f', '\\u')"
        out = f"concat('s', {text})"
    else:
        # The cell separator and the escape sign are escaped, so different rows never join alike.
        text = rf"replace(replace(cast({col} as string), '\\', '\\\\'), '\u001f', '\\u')"
        out = f"concat('s', {text})"
    return f"coalesce({out}, 'N')"


def row_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Digest of a row that ignores column names and keeps column order."""
    return F.expr(_row_key(df, columns or df.columns))


def _row_key(df: DataFrame, names: list[str]) -> str:
    cells = ", ".join(cell_key(n, df.schema[n].dataType) for n in names)
    return f"md5(concat_ws('\\u001f', {cells}))"


def _nameless(result: DataFrame) -> DataFrame:
    return result.toDF(*[f"c{i}" for i in range(len(result.columns))])


def bag_counts(result: DataFrame, query_id: str) -> DataFrame:
    """``query_id, row_key, cnt`` of one query result."""
    plain = _nameless(result)
    return (
        plain.select(row_key(plain).alias("row_key"))
        .groupBy("row_key")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.lit(query_id).alias("query_id"), "row_key", "cnt")
    )


def bag_digest(result: DataFrame, query_id: str) -> DataFrame:
    """One row per result: its size and two sums over the 120 leading bits of the row digests.

    Sums do not depend on row order and count duplicates: equal bags have equal digests,
    and unlike bags differ but for a collision of 120-bit hashes.  They are formed in the map tasks: comparing two results moves
    one record per task, however large the results are.
    """
    plain = _nameless(result)
    part = lambda start: (
        f"coalesce(sum(cast(conv(substr(k, {start}, 15), 16, 10) as decimal(28,0))), cast(0 as decimal(38,0)))"
    )
    return plain.selectExpr(f"{_row_key(plain, plain.columns)} as k").selectExpr(
        f"'{query_id}' as query_id", "count(1) as n", f"{part(1)} as head", f"{part(16)} as tail"
    )


def bag_differences(signed: DataFrame) -> DataFrame:
    """``pair_id, row_key, cnt`` with signed counts -> pairs and whether both bags are equal.

    Counts are summed in the map tasks first, so a row that makes up a third of
    a result costs one record per task.
    """
    rows = signed.groupBy("pair_id", "row_key").agg(F.sum("cnt").alias("diff"))
    return rows.groupBy("pair_id").agg(F.bool_and(F.col("diff") == 0).alias("equal"))


def same_bag(left: DataFrame, right: DataFrame) -> bool:
    """Order-blind, name-blind, duplicate-sensitive equality of two results."""
    both = bag_counts(left, "p").unionByName(
        bag_counts(right, "p").withColumn("cnt", -F.col("cnt"))
    ).withColumnRenamed("query_id", "pair_id")
    return bag_differences(both).filter("not equal").isEmpty()


@contextmanager
def lenient_sql(spark: SparkSession) -> Iterator[None]:
    """Bad casts and divisions give null, as the workloads expect; restored afterwards."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def read_only(spark: SparkSession, sql: str) -> DataFrame:
    """Analyse a query text.  As a subquery only a query is valid: commands do not parse."""
    body = sql.strip().rstrip(";").rstrip()
    return spark.sql(f"SELECT * FROM (\n{body}\n)")


def catalog_runner(spark: SparkSession) -> Runner:
    """Databases are catalog schemas of the same name."""

    def run(db_id: str, sql: str) -> DataFrame:
        if not spark.catalog.databaseExists(db_id):
            raise LookupError(f"database not found for db_id={db_id}")
        before = spark.catalog.currentDatabase()
        spark.catalog.setCurrentDatabase(db_id)
        try:
            return read_only(spark, sql)
        finally:
            spark.catalog.setCurrentDatabase(before)

    return run


@contextmanager
def view_runner(
    spark: SparkSession, databases: Mapping[str, Mapping[str, DataFrame]]
) -> Iterator[Runner]:
    """Databases are named groups of DataFrames, visible as views inside the ``with`` block."""
    taken = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    clash = taken & {name.lower() for group in databases.values() for name in group}
    if clash:
        raise ValueError(f"temporary views of these names exist already: {sorted(clash)}")
    shown: list[str] = []

    def hide() -> None:
        while shown:
            spark.catalog.dropTempView(shown.pop())

    current = None

    def run(db_id: str, sql: str) -> DataFrame:
        nonlocal current
        if db_id not in databases:
            raise LookupError(f"database not found for db_id={db_id}")
        if db_id != current:
            hide()
            for name, df in databases[db_id].items():
                df.createOrReplaceTempView(name)
                shown.append(name)
            current = db_id
        return read_only(spark, sql)

    try:
        yield run
    finally:
        hide()


def unique_queries(records: DataFrame) -> DataFrame:
    """Each distinct query of a workload once: ``query_id, db_id, sql, uses``.

    Two texts are one query when their keys agree, so it runs once and its
    result serves every record that asks for it.
    """
    return (
        records.select("db_id", "sql", sql_key(F.col("sql")).alias("norm"))
        .groupBy("db_id", "norm")
        .agg(F.min("sql").alias("sql"), F.count(F.lit(1)).alias("uses"))
        .select(query_id(F.col("db_id"), F.col("norm")).alias("query_id"), "db_id", "norm", "sql", "uses")
    )


def query_id(db_id: Column, norm: Column) -> Column:
    return F.md5(F.concat_ws("|", db_id, norm))


def _side_id(side: str) -> Column:
    """Query id of one side of a record; null for a blank query or database."""
    db_id, sql = or_blank(F.col("db_id")), or_blank(F.col(f"{side}_sql"))
    return F.when((db_id != "") & (sql != ""), query_id(db_id, sql_key(sql)))


def workload_queries(records: DataFrame) -> DataFrame:
    """The distinct queries of both sides of a workload."""
    sides = F.array(F.col("gold_sql"), F.col("pred_sql"))
    long = records.select(or_blank(F.col("db_id")).alias("db_id"), F.explode(sides).alias("sql"))
    return unique_queries(long.filter("db_id <> '' and sql <> ''"))


class PlanFolder:
    """Finds queries that ask for the same although their texts differ.

    Two queries are one when Spark's canonical plans agree: names of aliases and result columns, the order
    of conditions and the like do not count. The last ``held`` plans are remembered; a query whose
    equal has been forgotten runs again.
    """

    def __init__(self, held: int = FOLDED_PLANS) -> None:
        self.held = held
        self.plans: OrderedDict[str, tuple[int, DataFrame]] = OrderedDict()
        self.by_hash: dict[int, list[str]] = {}
        self.same: list[tuple[str, str]] = []

    def first(self, query: str, plan: DataFrame) -> bool:
        """Whether the query is the first of its kind; otherwise it is noted as equal to that one."""
        key = plan.semanticHash()
        for other in self.by_hash.get(key, ()):
            if plan.sameSemantics(self.plans[other][1]):
                self.same.append((query, other))
                return False
        self.plans[query] = (key, plan)
        self.by_hash.setdefault(key, []).append(query)
        if len(self.plans) > self.held:
            gone, (old, _) = self.plans.popitem(last=False)
            self.by_hash[old].remove(gone)
        return True


def analysed(queries: Iterable, runner: Runner, folder: PlanFolder | None = None) -> tuple[list[tuple[str, DataFrame]], dict[str, str]]:
    """Plans of the given query rows, each kind once, and the queries that do not analyse."""
    plans, errors = [], {}
    for row in queries:
        try:
            plan = runner(row["db_id"], row["sql"])
            if folder is None or folder.first(row["query_id"], plan):
                plans.append((row["query_id"], plan))
        except (PySparkException, LookupError) as problem:
            errors[row["query_id"]] = str(problem).splitlines()[0]
    return plans, errors


def run_and_store(
    spark: SparkSession, queries: Iterable, runner: Runner, folder: str, batch: int = BATCH
) -> tuple[DataFrame, DataFrame]:
    """Run queries in batches and keep their digests in the shared folder.

    ``queries`` may be an iterator: a batch of texts at a time reaches the driver.  Queries with the
    same canonical plan run once.  When a batch fails while running, its queries run one by one and
    the failing ones become error rows; the others keep their results.  Batch folders are replaced as
    a whole, so a retry never adds a digest twice.
    """
    errors: dict[str, str] = {}
    stored: list[str] = []
    kinds = PlanFolder()

    def store(plans: list[tuple[str, DataFrame]], name: str) -> None:
        if plans:
            digests = reduce(DataFrame.unionByName, [bag_digest(plan, query) for query, plan in plans])
            digests.write.mode("overwrite").parquet(f"{folder}/{name}")
            stored.append(f"{folder}/{name}")

    source = iter(queries)
    with lenient_sql(spark):
        for number in count():
            rows = list(islice(source, batch))
            if not rows:
                break
            plans, failed = analysed(rows, runner, kinds)
            errors.update(failed)
            try:
                store(plans, f"batch-{number}")
            except PySparkException:
                for i, one in enumerate(plans):
                    try:
                        store([one], f"single-{number}-{i}")
                    except PySparkException as problem:
                        errors[one[0]] = str(problem).splitlines()[0]
    digests = spark.read.schema(DIGEST_SCHEMA).parquet(*stored) if stored else spark.createDataFrame([], DIGEST_SCHEMA)
    status = spark.createDataFrame(list(errors.items()), STATUS_SCHEMA)
    if not kinds.same:
        return digests, status
    same = spark.createDataFrame(kinds.same, "other string, query_id string")
    # Equal queries share the digest, or the error, of the one that ran.
    shared = lambda df: df.unionByName(df.join(same, "query_id").drop("query_id").withColumnRenamed("other", "query_id").select(df.columns))
    return shared(digests), shared(status)


def score_records(records: DataFrame, digests: DataFrame, errors: DataFrame) -> DataFrame:
    """``id, db_id, execution_accuracy``: 1 when neither query failed and both bags agree.

    A blank query or database gives an empty result without an error.
    """
    digest = F.struct("n", "head", "tail")
    outcome = digests.select("query_id", F.lit(False).alias("failed"), digest.alias("digest")).unionByName(
        errors.select("query_id", F.lit(True).alias("failed")), allowMissingColumns=True
    )
    end = lambda side: outcome.select(*[F.col(c).alias(f"{side}_{c}") for c in outcome.columns])
    zero = F.lit(0)
    empty = F.struct(
        zero.cast("bigint").alias("n"),
        zero.cast("decimal(38,0)").alias("head"),
        zero.cast("decimal(38,0)").alias("tail"),
    )
    seen = records.withColumns({f"{side}_query_id": _side_id(side) for side in ("gold", "pred")})
    both = seen.join(end("gold"), "gold_query_id", "left").join(end("pred"), "pred_query_id", "left")
    failed = F.coalesce("gold_failed", F.lit(False)) | F.coalesce("pred_failed", F.lit(False))
    equal = F.coalesce("gold_digest", empty) == F.coalesce("pred_digest", empty)
    score = F.when(~failed & equal, 1.0).otherwise(0.0)
    return both.select("id", or_blank(F.col("db_id")).alias("db_id"), score.alias("execution_accuracy"))


def accuracy_samples(
    records: DataFrame, runner: Runner, folder: str | None = None
) -> DataFrame:
    """Score of every record (``id, db_id, gold_sql, pred_sql``).

    Only the distinct query texts pass through the driver, a batch at a time; each kind of plan runs
    once and leaves one digest row in ``folder`` (by default below the shared folder).
    """
    spark = records.sparkSession
    queries = workload_queries(records).select("query_id", "db_id", "sql").orderBy("db_id", "query_id")
    folder = folder or scratch_path(spark, "digests")
    return score_records(records, *run_and_store(spark, queries.toLocalIterator(), runner, folder))


def ordered_samples(samples: DataFrame) -> DataFrame:
    return samples.orderBy(or_blank(F.col("id").cast("string")), "db_id")


def accuracy_summary(samples: DataFrame) -> DataFrame:
    return samples.agg(
        F.coalesce(F.avg("execution_accuracy"), F.lit(0.0)).alias("execution_accuracy"),
        F.count(F.lit(1)).alias("num_samples"),
    )
