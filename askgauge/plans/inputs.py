"""Views of the driver's tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgauge.sources.tables import table_to_cells, union_cells

# Ordering key of each table that is read as cells.
ROW_KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey",
}

# Gold and predicted queries over the tables: (id, db_id, gold, predicted).
QUERY_PAIRS = [
    ("01", "tpc", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment",
     "SELECT c_mktsegment AS seg, COUNT(c_custkey) AS k FROM customer GROUP BY c_mktsegment ORDER BY seg DESC"),
    ("02", "tpc", "SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F'",
     "SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'O'"),
    ("03", "tpc", "SELECT SUM(l_quantity) FROM lineitem", "SELECT SUM(l_quantity) + 0.0000001 FROM lineitem"),
    ("04", "tpc", "SELECT COUNT(*) FROM supplier", "SELECT COUNT(no_such_column) FROM supplier"),
    ("05", "tpc", "SELECT COUNT(*) FROM part", ""),
    ("06", "tpc", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice < 0",
     "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'none'"),
    ("07", "missing", "SELECT COUNT(*) FROM part", "SELECT COUNT(*) FROM part"),
    ("08", "tpc", "SELECT o_orderstatus FROM orders", "SELECT DISTINCT o_orderstatus FROM orders"),
    ("09", "tpc", "SELECT n_name, n_regionkey FROM nation", "SELECT n_regionkey, n_name FROM nation"),
    ("10", "tpc", "SELECT COUNT(*) FROM lineitem", "SELECT COUNT(*) * 1.0 FROM lineitem;"),
    ("11", "tpc",
     "SELECT c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
     "SELECT c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    ("12", "tpc", "", ""),
    ("13", "tpc", "SELECT COUNT(*) FROM orders", "DELETE FROM orders"),
    ("14", "tpc",
     "SELECT l_returnflag, ROUND(AVG(l_extendedprice), 2) FROM lineitem GROUP BY l_returnflag",
     "SELECT l_returnflag, ROUND(SUM(l_extendedprice) / COUNT(*), 2) FROM lineitem GROUP BY l_returnflag"),
    ("15", "tpc", "SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 10",
     "SELECT o_totalprice FROM (SELECT o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC) AS r"
     " FROM orders) AS t WHERE r <= 10"),
    ("16", "tpc", "SELECT o_custkey, SUM(o_totalprice) > 0 FROM orders GROUP BY o_custkey",
     "select o_custkey, sum(o_totalprice) > 0   from orders group by o_custkey ;"),
    # Double-quoted values: the same words in another case, with other blanks, or with a comment mark inside.
    ("17", "tpc", 'SELECT COUNT(*) FROM customer WHERE c_mktsegment = "BUILDING"',
     'SELECT COUNT(*) FROM customer WHERE c_mktsegment = "building"'),
    ("18", "tpc", """SELECT COUNT(*) FROM part WHERE p_name <> "it's" AND p_brand = 'Brand#11'""",
     """SELECT COUNT(*) FROM part WHERE p_name <> "it's" AND p_brand = 'brand#11'"""),
    ("19", "tpc", 'SELECT "a  b" AS x FROM region', 'SELECT "a b" AS x FROM region'),
    ("20", "tpc", 'SELECT "a -- b" AS x FROM region', 'SELECT "a" AS x FROM region'),
    ("21", "tpc", 'SELECT COUNT(*) FROM customer WHERE c_mktsegment = "BUILDING"',
     "select count(*) from customer /* all */ where c_mktsegment = 'BUILDING' -- end"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cell_text(df: DataFrame, name: str) -> Column:
    """Text form that other engines write alike: money with two places, days without a clock."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DoubleType):
        return F.col(name).cast("decimal(18,2)").cast("string")
    if isinstance(kind, T.TimestampNTZType):
        return F.col(name).cast("date").cast("string")
    return F.col(name).cast("string")


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """All star-schema tables as one cell frame."""
    return union_cells(
        [
            table_to_cells(table(spark, folder, name), name, F.expr(key), cell_text)
            for name, key in ROW_KEYS.items()
        ]
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings split in two sides by their label."""
    side = F.when(F.col("label") < 5, "source").otherwise("target")
    return table(spark, folder, "embeddings").select("vec_id", "label", side.alias("side"), "embedding")


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """One query text per event, with the untidiness of a real log."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    sql = (
        F.when(kind == "click", text("SELECT  user_id,\tvalue FROM events WHERE user_id = ", user, " ;"))
        .when(kind == "view", text("select \"value\" from \"events\" WHERE event_type = 'View -- All'  -- event ", F.col("event_id").cast("string")))
        .when(kind == "purchase", text("SELECT COUNT(*), AVG(value) FROM events JOIN users ON events.user_id = users.user_id WHERE note = \"It's  A -- /* B\" AND value > ", user))
        .when(kind == "error", text("SELECT MAX(\"value\") FROM \"events\" /* user ", user, " */ GROUP BY user_id HAVING SUM(\"value\") >= 10;"))
        .otherwise(text("SELECT user_id FROM Events WHERE value BETWEEN 1 AND ", user, " OR user_id IN (1, 2)"))
    )
    db_id = F.concat(F.lit("db"), (F.col("user_id") % 5).cast("string"))
    return table(spark, folder, "events").select("event_id", db_id.alias("db_id"), sql.alias("sql"))


def page_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Two headers per page: the words of its title, and the same in capitals with a column more."""
    title = F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " ")
    both = F.array(
        F.struct((F.col("page_id") * 2).alias("table_id"), title.alias("header")),
        F.struct(
            (F.col("page_id") * 2 + 1).alias("table_id"),
            F.concat(F.transform(title, F.upper), F.array(F.lit("id"))).alias("header"),
        ),
    )
    return table(spark, folder, "pages").select(F.inline(both))


def page_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as tables whose columns are the words of their titles."""
    name = F.concat(F.lit("page "), F.col("table_id").cast("string"))
    return page_headers(spark, folder).select(name.alias("table_name"), F.col("header").alias("columns"))


def model_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns in the forms a model answers in: fenced, bare, chatty or empty."""
    said, turn = F.col("text"), F.col("turn") % 5
    answer = (
        F.when(turn == 0, F.concat(said, F.lit("\n```sql\nSELECT a FROM t WHERE note = '"), F.col("role"), F.lit("'\n```\ndone")))
        .when(turn == 1, F.concat(F.lit("```\n \n```"), said, F.lit("``` SQL\nWITH x AS (SELECT 1) SELECT * FROM x ``` end")))
        .when(turn == 2, F.concat(said, F.lit(" update t set a = 1; select 2 ")))
        .when(turn == 3, F.concat(F.lit("  "), said))
        .otherwise(F.lit(""))
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", answer.alias("answer"))


def qa_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as answers that hold question and answer lines."""
    said, turn = F.col("text"), F.col("turn") % 3
    flat = F.regexp_replace(said, "\n", " ")
    output = (
        F.when(turn == 0, F.concat(F.lit("Q: "), flat, F.lit("\n\nnote\n A: SELECT 1\nA: SELECT 2")))
        .when(turn == 1, F.concat(F.lit("A: none\nQ: first\nQ: "), flat, F.lit("\nA: "), flat, F.lit("\nQ: open")))
        .otherwise(said)
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", output.alias("output"))


def instruct_records(spark: SparkSession, folder: str) -> DataFrame:
    """Part rows as instruction records with an uneven schema description."""
    words = F.split("p_name", " ")
    odd = F.col("p_size") % 2 == 1
    big = F.col("p_size") > 40
    tiny = F.col("p_size") < 4
    item = F.struct(
        F.when(~tiny, F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("table_name"),
        F.when(odd, F.col("p_type")).otherwise(F.lit("")).alias("table_comment"),
        F.when(big, F.array().cast("array<string>")).otherwise(words).alias("column_names"),
        F.when(odd, F.array(F.lit("text"))).otherwise(F.array(F.lit(""), F.lit("number"))).alias("column_types"),
        F.array(F.when(odd, F.col("p_type")), F.lit("")).alias("column_comments"),
        F.array(F.lit(1), F.lit(0)).alias("pk_indicators"),
    )
    keys = F.when(
        odd,
        F.array(
            F.array(F.col("p_brand"), F.lit("a"), F.col("p_type"), F.lit("b")),
            F.array(F.lit("too"), F.lit("short")),
        ),
    )
    schema = F.struct(F.array(item).alias("schema_items"), keys.alias("foreign_keys"))
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.when(~tiny, F.concat(F.lit("How many "), F.col("p_name"), F.lit("?"))).alias("question"),
        F.when(odd, F.col("p_type")).alias("text"),
        F.when(~big, schema).alias("schema"),
        F.when(F.col("p_size") != 10, F.col("p_brand")).alias("db_id"),
        F.concat(F.lit("SELECT "), F.col("p_size").cast("string")).alias("sql"),
        schema.alias("full_schema"),
    )


def workload_records(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as gold records and the turn after each as its prediction."""
    turns = table(spark, folder, "conversations")
    return turns.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("db"), (F.col("conv_id") % 7).cast("string")).alias("db_id"),
        "role",
        "conv_id",
        "turn",
        "text",
    )


def query_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERY_PAIRS, "id string, db_id string, gold_sql string, pred_sql string")


def databases(spark: SparkSession, folder: str) -> dict[str, dict[str, DataFrame]]:
    return {"tpc": {name: table(spark, folder, name) for name in ROW_KEYS}}


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Fixed number of places for values that were summed in a different order."""
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def flat(col: Column) -> Column:
    return F.array_join(col, "|")
