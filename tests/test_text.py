import pytest
from pyspark.sql import functions as F

from askgauge.functions import schema_text as S
from askgauge.functions import text as X
from askgauge.functions.similarity import common_subsequence, token_sort_ratio


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(fn(F.col("v")).alias("r")).head()["r"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        (None, ""),
        ("  ;", ""),
        ("SELECT  1 ;", "select 1"),
        ("SELECT 'A  B' FROM T -- note", "select 'A  B' from t"),
        ("SELECT '--x' /* c */ FROM\nT", "select '--x' from t"),
        ("SELECT 'it''s' AS Q;;", "select 'it''s' as q"),
        ("SELECT /* a * b ** */ X", "select x"),
    ],
)
def test_sql_key(spark, raw, expected):
    assert one(spark, raw, X.sql_key) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        (None, ""),
        ("", ""),
        ("  \n ", ""),
        ("```sql\nSELECT 1\n```", "SELECT 1"),
        ("```\n\n``` text ```SQL\nSELECT 2```", "SELECT 2"),
        ("```sql\n```then select 3", "select 3"),
        ("please update t, with x", "with x"),
        ("delete before select 4", "select 4"),
        ("no query here\nsecond line", "no query here"),
        ("größe SELECT ß", "SELECT ß"),
    ],
)
def test_extract_sql(spark, raw, expected):
    assert one(spark, raw, X.extract_sql) == expected


def test_qa_pairs_follow_the_closest_question(spark):
    text = "A: none\nQ: one\nnote\n A: first\nA: again\nQ: two\nQ: three\nA: second\nQ: open"
    pairs = [(p["question"], p["answer"]) for p in one(spark, text, X.qa_pairs)]
    assert pairs == [("one", "first"), ("three", "second")]


def test_qa_pairs_match_a_line_by_line_walk(spark):
    import random

    rnd = random.Random(7)
    texts = ["\n".join(rnd.choice(["Q: q%d", "A: a%d", "x%d", ""]).replace("%d", str(i)) for i in range(12)) for _ in range(60)]
    expected = []
    for text in texts:
        asked, pairs = None, []
        for line in (x.strip() for x in text.split("\n")):
            if line.startswith("Q:"):
                asked = line[2:].strip()
            elif line.startswith("A:") and asked is not None:
                pairs.append((asked, line[2:].strip()))
                asked = None
        expected.append(pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    rows = df.select("i", X.qa_pairs(F.col("v")).alias("p")).orderBy("i").collect()
    assert [[(p["question"], p["answer"]) for p in r["p"]] for r in rows] == expected


def test_output_lines_keep_the_first_filled_ones(spark):
    assert one(spark, " a \n\n b\r\nc\nd\ne", lambda c: X.output_lines(c, 4)) == ["a", "b", "c", "d"]


def test_render_fills_once(spark):
    df = spark.createDataFrame([("{sql}", "S")], "q string, s string")
    got = df.select(X.render("Q {question} A {sql} {{x}}", question=F.col("q"), sql=F.col("s")).alias("r")).head()["r"]
    assert got == "Q {sql} A S {x}"


def test_unknown_style_reads_formal(spark):
    df = spark.createDataFrame([("vague",), ("odd",)], "style string")
    got = [r[0] for r in df.select(X.style_question(F.lit("t c"), F.col("style"))).collect()]
    assert got == ["Pull details about t c.", "What is t c?"]


def test_cut_at_stop_uses_the_first_listed(spark):
    assert one(spark, "a # b ; c", lambda c: X.cut_at_stop(c, [";", "#"])) == "a # b"
    assert one(spark, " abc ", lambda c: X.cut_at_stop(c, ["#"])) == "abc"


def test_clean_name(spark):
    assert one(spark, "  Total Net Sales ", X.clean_name) == "total_net_sales"


def test_sql_features(spark):
    sql = "SELECT COUNT(*) FROM \"Orders\" o JOIN items ON o.a = items.b WHERE name LIKE 'FROM x' AND \"Age\" > 3"
    found = {(f["kind"], f["name"]) for f in one(spark, sql, X.sql_features)}
    assert found == {
        ("table", "orders"), ("table", "items"), ("column", "age"), ("aggregate", "COUNT"),
        ("predicate", "EQ"), ("predicate", "GT"), ("predicate", "Like"),
    }


def test_sql_features_ignore_comments_and_values(spark):
    sql = 'SELECT "a" FROM main."My T" -- x LIKE y\nWHERE note = "b LIKE c OR d >= 1" /* COUNT(z) */ AND k IN ("v") AND "u"."w" < 2'
    found = {(f["kind"], f["name"]) for f in one(spark, sql, X.sql_features)}
    assert found == {
        ("table", "my t"), ("column", "a"), ("column", "u"), ("column", "w"),
        ("predicate", "EQ"), ("predicate", "In"), ("predicate", "LT"),
    }
    assert one(spark, None, X.sql_features) == [] and one(spark, "--", X.sql_features) == []


@pytest.mark.parametrize(
    "sql, columns",
    [
        ("SELECT o.a, COUNT(b) n, MAX(c) AS d FROM t o JOIN s.u AS v ON o.k = v.`K 2` WHERE e > 'f' -- g", {"a", "b", "c", "k", "k 2", "e"}),
        ("select distinct x from (select y z from t) q where w between 1 and 2 order by x desc", {"x", "y", "w"}),
        ("", set()),
        (None, set()),
        ('SELECT "', set()),
    ],
)
def test_sql_columns(spark, sql, columns):
    assert set(one(spark, sql, X.sql_columns)) == columns


@pytest.mark.parametrize(
    "text, lang",
    [("the house is on the hill", "en"), ("das ist nicht die Welt", "de"), ("zzz", None), (None, None), ("le chat et la souris", "fr")],
)
def test_detect_language(spark, text, lang):
    assert one(spark, text, X.detect_language) == lang


def test_schema_text_tolerates_short_arrays(spark):
    item = {
        "table_name": None, "table_comment": "people", "column_names": ["id", "name"],
        "column_types": ["int"], "column_comments": [None, "full name"], "pk_indicators": [1],
    }
    bare = {"table_name": "t", "table_comment": "", "column_names": [], "column_types": None, "column_comments": None, "pk_indicators": None}
    keys = [["a", "b", "c", "d"], ["too", "short"]]
    df = spark.createDataFrame([({"schema_items": [item, bare], "foreign_keys": keys},)], f"s {S.SCHEMA_TYPE}")
    assert df.select(S.schema_text(F.col("s")).alias("r")).head()["r"] == (
        "Table unknown_table (people) has columns: id (type: int; primary key), name (comment: full name)."
        " Table t has no columns listed. Foreign keys: a.b -> c.d."
    )


def test_record_prompt_needs_both_parts(spark):
    schema = {"schema_items": [], "foreign_keys": None}
    full = {"schema_items": [{"table_name": "t", "table_comment": None, "column_names": None, "column_types": None, "column_comments": None, "pk_indicators": None}], "foreign_keys": None}
    rows = [("q", None, schema), ("q", None, None), ("", "t", full), (None, "", full)]
    df = spark.createDataFrame(rows, f"q string, t string, s {S.SCHEMA_TYPE}")
    got = [r[0] for r in df.select(S.record_prompt(F.col("q"), F.col("t"), F.col("s"))).collect()]
    assert got == [None, None, "Question: t Schema: Table t has no columns listed.", None]


def test_common_subsequence_against_a_table():
    import random

    rnd = random.Random(3)
    for _ in range(100):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90)))
        b = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90)))
        row = [0] * (len(b) + 1)
        for x in a:
            left = [0]
            for j, y in enumerate(b):
                left.append(row[j] + 1 if x == y else max(row[j + 1], left[j]))
            row = left
        assert common_subsequence(a, b) == row[-1]


def test_token_sort_ratio(spark):
    df = spark.createDataFrame([("b a", "a b"), ("id|name", "id|names"), ("", "")], "a string, b string")
    got = [round(r[0], 3) for r in df.select(token_sort_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [100.0, 93.333, 100.0]
