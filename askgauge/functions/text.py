"""Text columns: SQL keys, model answers, templates, stable ids."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter, ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgauge.functions.fixed_values import (
    AGGREGATE_NAMES,
    COMPARISONS,
    DISTRACTORS,
    PREDICATE_PATTERNS,
    QUESTION_STYLES,
    SQL_START_WORDS,
    SQL_WORDS,
    STOP_WORDS,
)

EDGE_SPACE = r"^\s+|\s+$"
# Text in single or double quotes or in backticks, a doubled quote being part of it.
QUOTED = r"""'[^']*+(?:''[^']*+)*+'|"[^"]*+(?:""[^"]*+)*+"|`[^`]*+`"""
COMMENT = r"--[^\n]*+|/\*(?s:.*?)\*/"
# A query as quoted texts, comments and stretches of everything else.
QUERY_PARTS = rf"{QUOTED}|{COMMENT}|(?:(?!--|/\*)[^'\"`])++|['\"`]|/\*"
# A backslash before a quote ends the quoted text in some dialects and not in others.
ESCAPED_QUOTE = r"""\\['"`]"""
# A query as comments, quoted texts, words, numbers, comparisons and single signs.
SQL_TOKEN = rf"{QUOTED}|{COMMENT}|[A-Za-z_][A-Za-z_0-9]*+|[0-9][0-9.]*+|<>|!=|<=|>=|==|\S"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, EDGE_SPACE, "")


def or_blank(col: Column) -> Column:
    """A missing field reads as an empty string."""
    return F.coalesce(col, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def filled(col: Column) -> Column:
    """True where the text holds anything but blanks."""
    return F.coalesce(F.length(strip(col)) > 0, F.lit(False))


def sql_key(col: Column) -> Column:
    """Canonical text of a query: no comments, no trailing semicolon, one blank between
    words and lower case outside quotes.  Text in single quotes, double quotes or backticks
    stays as it is: a double-quoted text may be a value.  Equal keys mean the same query text;
    a text with a backslash before a quote is only trimmed."""
    raw = or_blank(col)
    parts = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bare = F.transform(parts(raw, QUERY_PARTS), lambda p: F.when(p.rlike(rf"^(?:{COMMENT})$"), " ").otherwise(p))
    # Once more without comments, so that the blanks around one count as one run.
    pieces = F.transform(
        parts(F.array_join(bare, ""), rf"{QUOTED}|[^'\"`]++|['\"`]"),
        lambda p: F.when(F.substring(p, 1, 1).isin("'", '"', "`"), p).otherwise(
            F.lower(F.regexp_replace(p, r"\s+", " "))
        ),
    )
    plain = F.when(raw.rlike(ESCAPED_QUOTE), raw).otherwise(F.array_join(pieces, ""))
    return F.regexp_replace(plain, r"^\s+|[\s;]+$", "")


def clean_name(col: Column) -> Column:
    return F.replace(F.lower(F.trim(col)), F.lit(" "), F.lit("_"))


def extract_sql(col: Column) -> Column:
    """The query inside a model answer: first filled fenced block, else the text from the
    first keyword found in the fixed order, else the first line."""
    blocks = F.filter(
        F.transform(
            F.filter(F.split(or_blank(col), "```"), lambda _, i: i % 2 == 1),
            lambda b: F.regexp_replace(strip(b), r"^(?i:sql)\s*", ""),
        ),
        lambda b: b != "",
    )
    # Only ASCII letters change case, so positions in the raised text hold in the text itself.
    raised = F.translate(col, ascii_lowercase, ascii_uppercase)
    found = lambda word: F.instr(raised, word)
    from_word = F.coalesce(
        *[F.when(found(w) > 0, strip(F.substring(col, found(w), F.length(col)))) for w in SQL_START_WORDS]
    )
    first_line = strip(F.get(F.split(strip(or_blank(col)), r"\r\n|\n|\r"), F.lit(0)))
    return F.coalesce(F.get(blocks, F.lit(0)), from_word, first_line, F.lit(""))


def render(template: str, **slots: Column) -> Column:
    """Fill the named slots of a template.

    The template is cut on the driver, so a value that itself contains braces is never
    filled again.
    """
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(slots[name].cast("string"))
    return F.concat(*parts)


def style_question(ask: Column, style: Column) -> Column:
    """Question in a named style; an unknown style reads as formal."""
    out = render(QUESTION_STYLES["formal"], ask=ask)
    for name, template in QUESTION_STYLES.items():
        out = F.when(style == name, render(template, ask=ask)).otherwise(out)
    return out


def hash_choice(seed_text: Column, options: list[str]) -> Column:
    """Pick one option by the text's hash, the same on every run."""
    number = F.conv(F.substring(F.md5(seed_text), 1, 8), 16, 10).cast("bigint")
    slot = F.pmod(number, F.lit(len(options))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(o) for o in options]), slot)


def distractor(seed_text: Column) -> Column:
    return hash_choice(seed_text, DISTRACTORS)


def stable_id(*cols: Column) -> Column:
    return F.md5(F.concat_ws("|", *cols))


def output_lines(col: Column, keep: int | None = None) -> Column:
    """Non-blank trimmed lines of a model answer, the first ``keep`` of them."""
    lines = F.filter(F.transform(F.split(or_blank(col), r"\r\n|\n|\r"), strip), lambda x: x != "")
    return F.slice(lines, 1, keep) if keep else lines


def qa_pairs(col: Column) -> Column:
    """Question/answer pairs of a model answer as ``array<struct<question, answer>>``.

    An answer line counts when the closest earlier Q or A line is a question.
    """
    tagged = F.filter(output_lines(col), lambda x: x.startswith("Q:") | x.startswith("A:"))
    body = lambda x: strip(F.substr(x, F.lit(3)))

    def pair(lines: Column) -> Column:
        return F.transform(
            lines,
            lambda line, i: F.when(
                line.startswith("A:") & F.get(lines, i - 1).startswith("Q:"),
                F.struct(body(F.get(lines, i - 1)).alias("question"), body(line).alias("answer")),
            ),
        )

    return F.filter(pair(tagged), lambda p: p.isNotNull())


def cut_at_stop(col: Column, stops: list[str]) -> Column:
    """Cut at the first listed stop text that occurs, then trim."""
    out = col
    for stop in reversed(stops):
        out = F.when(F.contains(col, F.lit(stop)), F.substring_index(col, stop, 1)).otherwise(out)
    return strip(out)


def chat_prompt(system: str, prompt: Column) -> Column:
    return F.concat(F.lit(f"System: {system}\nUser: "), prompt, F.lit("\nAssistant:"))


def sql_tokens(col: Column) -> Column:
    """Tokens of a query text without its comments, as ``array<string>``."""
    tokens = F.regexp_extract_all(or_blank(col), F.lit(SQL_TOKEN), F.lit(0))
    return F.filter(tokens, lambda t: ~(t.startswith("--") | t.startswith("/*")))


def _named(tokens: Column) -> Column:
    """Names among the tokens, as ``array<struct<name, table, quoted, column>>``.

    ``table``: after FROM or JOIN, the last part of a dotted name.  ``quoted``: in double quotes or backticks.
    ``column``: neither a table, a qualifier, a function nor an alias.  A double-quoted text right after a
    comparison, LIKE or ``IN (`` that no dot follows is a value and no name.
    """

    def entry(token: Column, i: Column) -> Column:
        back = lambda n: F.coalesce(F.upper(F.get(tokens, i - n)), F.lit(""))
        following = F.coalesce(F.get(tokens, i + 1), F.lit(""))
        quote = F.substring(token, 1, 1).isin('"', "`")
        value = token.startswith('"') & (following != ".") & (back(1).isin(COMPARISONS) | ((back(1) == "(") & (back(2) == "IN")))
        word = token.rlike("^[A-Za-z_]") & ~F.upper(token).isin(SQL_WORDS)
        name = F.lower(F.when(quote, F.substr(token, F.lit(2), F.length(token) - 2)).otherwise(token))
        source = back(1).isin("FROM", "JOIN") | ((back(1) == ".") & back(3).isin("FROM", "JOIN"))
        table = source & (following != ".")
        # A name right after a name, a literal or a closing bracket is an alias.
        alias = back(1).isin("AS", "WITH") | (back(1).rlike(r"^[A-Z_0-9\"'`)]") & ~back(1).isin(SQL_WORDS))
        column = ~source & ~alias & ~following.isin("(", ".")
        return F.when(
            (word | (quote & ~value)) & (name != ""),
            F.struct(name.alias("name"), table.alias("table"), quote.alias("quoted"), column.alias("column")),
        )

    return F.filter(F.transform(tokens, entry), lambda e: e.isNotNull())


def sql_features(col: Column) -> Column:
    """Tables, quoted columns, aggregates and predicate forms of a query text, each once,
    as ``array<struct<kind, name>>``.  Comments and quoted texts hold none of them."""
    calls = rf"(?i)\b({'|'.join(AGGREGATE_NAMES)})\s*\("

    def tag(kind: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    def features(parts: Column) -> Column:
        body, named = parts["body"], parts["named"]
        listed = lambda keep: F.transform(F.filter(named, keep), lambda e: e["name"])
        tables = listed(lambda e: e["table"])
        forms = [F.when(body.rlike(p), F.lit(name)) for name, p in PREDICATE_PATTERNS.items()]
        found = F.concat(
            tag("table", tables),
            tag("column", F.array_except(listed(lambda e: e["quoted"]), tables)),
            tag("aggregate", F.transform(F.regexp_extract_all(body, F.lit(calls), F.lit(1)), F.upper)),
            tag("predicate", F.filter(F.array(*forms), lambda n: n.isNotNull())),
        )
        return F.array_distinct(found)

    def split(tokens: Column) -> Column:
        bare = F.transform(tokens, lambda t: F.when(F.substring(t, 1, 1).isin("'", '"', "`"), "''").otherwise(t))
        return F.struct(F.array_join(bare, " ").alias("body"), _named(tokens).alias("named"))

    # One-element arrays bind the tokens and their parts to names.
    return F.get(F.transform(F.transform(F.array(sql_tokens(col)), split), features), F.lit(0))


def sql_columns(col: Column) -> Column:
    """Columns of a query text, quoted or not, each once, in lower case and without their qualifiers.

    Names after a comma behind FROM count as columns: nothing tells them apart without the schema.
    """
    named = F.get(F.transform(F.array(sql_tokens(col)), _named), F.lit(0))
    return F.array_distinct(F.transform(F.filter(named, lambda e: e["column"]), lambda e: e["name"]))


def column_uses(queries: DataFrame, sql_col: str = "sql") -> DataFrame:
    """How many queries of a log use each column."""
    return (
        queries.select(F.explode_outer(sql_columns(F.col(sql_col))).alias("name"))
        .filter("name is not null")
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("queries"))
    )


def feature_counts(queries: DataFrame, sql_col: str = "sql") -> DataFrame:
    """How many queries of a log use each feature."""
    return (
        # The outer form keeps the optimizer from evaluating the features twice.
        queries.select(F.explode_outer(sql_features(F.col(sql_col))).alias("f"))
        .filter("f is not null")
        .groupBy(F.col("f.kind").alias("kind"), F.col("f.name").alias("name"))
        .agg(F.count(F.lit(1)).alias("queries"))
    )


def _listed_in(listed: list[str]) -> Callable[[Column], Column]:
    return lambda word: word.isin(listed)


def detect_language(col: Column) -> Column:
    """Language whose function words are most frequent in the text; null when none occurs.

    Ties go to the language listed first.  All of it is one expression on the
    row: no explode, no join, no shuffle.  The words are looked up in a hash set
    once and only the hits are counted by language.
    """
    words = F.split(F.lower(or_blank(col)), r"\s+")
    every = sorted({w for listed in STOP_WORDS.values() for w in listed})
    hits = F.filter(words, lambda w: w.isin(every))
    nothing = F.struct(
        F.lit(0).alias("score"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("lang")
    )

    def best(found: Column) -> Column:
        ranked = [
            F.struct(
                F.size(F.filter(found, _listed_in(listed))).alias("score"),
                F.lit(-place).alias("place"),
                F.lit(lang).alias("lang"),
            )
            for place, (lang, listed) in enumerate(STOP_WORDS.items(), start=1)
        ]
        return F.greatest(nothing, *ranked)

    return F.get(F.transform(F.array(hits), best), F.lit(0))["lang"]
