"""Query templates over tables and the question/SQL examples built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgauge.functions.fixed_values import (
    CHAT_SYSTEM,
    QUESTION_PROMPT,
    QUESTION_STYLES,
    REWRITE_PROMPTS,
    RICHNESS_PROMPT,
)
from askgauge.functions.text import (
    chat_prompt,
    distractor,
    output_lines,
    qa_pairs,
    render,
    stable_id,
    style_question,
)
from askgauge.operators.cells import first_rows, table_headers


# --- the query templates, run on a table -------------------------------------------------

def select_column(df: DataFrame, column: str) -> DataFrame:
    return df.select(column)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def group_average(df: DataFrame, group: str, value: str) -> DataFrame:
    """Average per group; a value that is not a number counts as missing."""
    number = F.expr(f"try_cast(`{value}` as double)")
    return df.groupBy(group).agg(F.avg(number).alias("avg_value"))


def join_on_column(left: DataFrame, right: DataFrame, on: str, suffix: str = "_right") -> DataFrame:
    """Inner join keeping every column of both tables; names of the right side that occur
    on the left get a suffix."""
    renamed = right.toDF(*[c + suffix if c in left.columns else c for c in right.columns])
    return left.join(renamed, left[on] == renamed[on + suffix], "inner")


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value occurs more than once (nulls never match).

    The counted side is aggregated before the shuffle; a hot value on the row
    side is split by the adaptive skew join.
    """
    repeated = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(column)
    return df.select(column).join(repeated, column, "left_semi")


# --- the templates as SQL text, built for a whole catalog --------------------------------

def quoted(name: Column, quote: str = '"') -> Column:
    return F.concat(F.lit(quote), F.replace(name, F.lit(quote), F.lit(quote * 2)), F.lit(quote))


def catalog_of(cells: DataFrame) -> DataFrame:
    """``table_name, columns`` of every table of a cell frame."""
    return table_headers(cells).select(F.col("table_id").alias("table_name"), F.col("header").alias("columns"))


def sql_workload(catalog: DataFrame, quote: str = '"') -> DataFrame:
    """Template queries of every table: ``table_name, columns, kind, sql``.

    The grouped template needs a second column.  Use a backtick as ``quote``
    for texts that Spark itself shall run.
    """
    table = quoted(F.col("table_name"), quote)
    first = quoted(F.get("columns", F.lit(0)), quote)
    second = quoted(F.get("columns", F.lit(1)), quote)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    one = lambda kind, sql: F.struct(F.lit(kind).alias("kind"), sql.alias("sql"))
    kinds = F.array(
        one("select", text("SELECT ", first, " FROM ", table)),
        one("count", text("SELECT COUNT(*) FROM ", table)),
        one("group", text("SELECT ", first, ", AVG(", second, ") FROM ", table, " GROUP BY ", first)),
        one(
            "nested",
            text(
                "SELECT ", first, " FROM ", table, " WHERE ", first, " IN (SELECT ", first,
                " FROM ", table, " GROUP BY ", first, " HAVING COUNT(*) > 1)",
            ),
        ),
    )
    return (
        catalog.select("*", F.inline(kinds))
        .filter("sql is not null")
        .filter(~((F.col("kind") == "group") & (F.size("columns") < 2)))
    )


def join_workload(foreign_keys: DataFrame, quote: str = '"') -> DataFrame:
    """Join queries along foreign keys whose columns have one name."""
    q = lambda c: quoted(F.col(c), quote)
    sql = F.concat(
        F.lit("SELECT * FROM "), q("left_table"), F.lit(" JOIN "), q("right_table"), F.lit(" ON "),
        q("left_table"), F.lit("."), q("left_column"), F.lit(" = "),
        q("right_table"), F.lit("."), q("right_column"),
    )
    return foreign_keys.filter("left_column = right_column").select("left_table", "right_table", sql.alias("sql"))


def template_examples(
    workload: DataFrame, styles: Sequence[str] = tuple(QUESTION_STYLES), add_distractor: bool = True
) -> DataFrame:
    """One example per query and style: ``id, db_id, question, gold_sql``.

    The few styles ride along as a literal array, so this stays a narrow pass.
    """
    styled = workload.withColumn("style", F.explode(F.array(*[F.lit(s) for s in styles])))
    ask = F.concat_ws(" ", F.col("table_name"), F.get("columns", F.lit(0)))
    tagged = styled.withColumn("id", example_id(F.col("style"), F.col("sql")))
    question = style_question(ask, F.col("style"))
    if add_distractor:
        question = F.concat_ws(" ", question, distractor(F.col("id")))
    return tagged.select("id", "db_id", question.alias("question"), F.col("sql").alias("gold_sql"))


def example_id(kind: Column, sql: Column, *more: Column) -> Column:
    """Example id of a database and table that stays the same from run to run."""
    return F.concat_ws(":", F.col("db_id"), F.col("table_name"), kind, stable_id(sql, *more))


def question_prompts(
    workload: DataFrame, per_sql: int = 4, styles: Sequence[str] = tuple(QUESTION_STYLES)
) -> DataFrame:
    """Prompt that asks for questions, for every query of a workload."""
    return workload.withColumn(
        "prompt",
        render(
            QUESTION_PROMPT,
            db_id=F.col("db_id"),
            table=F.col("table_name"),
            columns=F.array_join("columns", ", "),
            sql=F.col("sql"),
            num=F.lit(per_sql),
            styles=F.lit(", ".join(styles)),
        ),
    )


def model_examples(answers: DataFrame, per_sql: int = 4, output_col: str = "output") -> DataFrame:
    """Examples out of model answers, one per kept line."""
    lines = answers.select("*", F.posexplode_outer(output_lines(F.col(output_col), per_sql)).alias("idx", "question"))
    lines = lines.filter("idx is not null")
    sql_id = F.concat_ws(":", stable_id(F.col("sql")), F.col("idx").cast("string"))
    return lines.select(
        F.concat_ws(":", "db_id", "table_name", F.lit("llm"), sql_id).alias("id"),
        "db_id",
        "table_name",
        "columns",
        "question",
        F.col("sql").alias("gold_sql"),
    )


def rewrite_prompts(examples: DataFrame, per_kind: int = 2) -> DataFrame:
    """Three rewrite prompts for every example."""
    slots = dict(
        db_id=F.col("db_id"),
        table=F.col("table_name"),
        columns=F.array_join("columns", ", "),
        question=F.col("question"),
        sql=F.col("gold_sql"),
        num=F.lit(per_kind),
    )
    kinds = [
        F.struct(F.lit(kind).alias("kind"), render(template, **slots).alias("prompt"))
        for kind, template in REWRITE_PROMPTS.items()
    ]
    return examples.select("*", F.inline(F.array(*kinds)))


def rewrite_examples(answers: DataFrame, output_col: str = "output") -> DataFrame:
    """Examples out of rewritten pairs.

    The id covers the example that was rewritten as well as the pair, so equal
    rewrites of two examples stay apart.
    """
    pairs = answers.select(
        "db_id",
        "table_name",
        "kind",
        stable_id(F.col("gold_sql"), F.col("question")).alias("base"),
        F.posexplode_outer(qa_pairs(F.col(output_col))).alias("place", "pair"),
    ).filter("place is not null")
    made = example_id(F.lit("rw"), F.col("base"), F.col("kind"), F.col("place").cast("string"), F.col("pair.answer"))
    return pairs.select(
        made.alias("id"),
        "db_id",
        F.col("pair.question").alias("question"),
        F.col("pair.answer").alias("gold_sql"),
    )


def richness_prompts(cells: DataFrame, sample_rows: int = 5) -> DataFrame:
    """Prompt that asks a model to rate each table by its header and first rows."""
    some = first_rows(cells, sample_rows)
    rows = some.groupBy("table_id", "row_idx").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("col_idx", F.coalesce("value", F.lit("nan")).alias("v")))),
                lambda c: c["v"],
            ),
            ", ",
        ).alias("line")
    )
    samples = rows.groupBy("table_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda r: r["line"]), "\n"
        ).alias("samples")
    )
    headers = table_headers(cells).select("table_id", F.array_join("header", ", ").alias("header"))
    return headers.join(samples, "table_id").select(
        "table_id",
        render(RICHNESS_PROMPT, header=F.col("header"), samples=F.col("samples")).alias("prompt"),
    )


def parse_rating(col: Column) -> Column:
    """First number of a model answer; null when there is none."""
    found = F.regexp_extract(col, r"[-+]?\d*\.?\d+", 0)
    return F.when(found != "", found).try_cast("double")


def chat_prompts(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("chat", chat_prompt(CHAT_SYSTEM, F.col("prompt")))
