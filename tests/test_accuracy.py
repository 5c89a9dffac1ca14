import json

import pytest
from pyspark.sql import functions as F

from askgauge.operators import accuracy as A
from askgauge.plans import jobs
from askgauge.session import scratch_path

RECORD = "id string, db_id string, gold_sql string, pred_sql string"


@pytest.fixture
def tables(spark):
    t = spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (2, "b", None)], "k int, s string, x double")
    return {"one": {"t": t}}


def scores(spark, tables, pairs):
    records = spark.createDataFrame([(str(i), "one", g, p) for i, (g, p) in enumerate(pairs)], RECORD)
    with A.view_runner(spark, tables) as run:
        rows = A.accuracy_samples(records, run).collect()
    return [r["execution_accuracy"] for r in sorted(rows, key=lambda r: int(r["id"]))]


@pytest.mark.parametrize(
    "gold, pred, score",
    [
        ("SELECT k, s FROM t", "SELECT k AS a, s AS b FROM t ORDER BY 1 DESC", 1.0),
        ("SELECT k, s FROM t", "SELECT s, k FROM t", 0.0),
        ("SELECT k FROM t", "SELECT DISTINCT k FROM t", 0.0),
        ("SELECT x FROM t", "SELECT x + 0.0000001 FROM t", 1.0),
        ("SELECT x FROM t", "SELECT x + 0.01 FROM t", 0.0),
        ("SELECT k FROM t", "SELECT CAST(k AS DOUBLE) FROM t", 1.0),
        ("SELECT k FROM t", "SELECT CAST(k AS STRING) FROM t", 0.0),
        ("SELECT x FROM t", "SELECT 'null' FROM t", 0.0),
        ("SELECT x FROM t WHERE x IS NULL", "SELECT CAST(NULL AS STRING) FROM t WHERE k = 2", 1.0),
        ("SELECT k FROM t WHERE k > 9", "SELECT k, s FROM t WHERE k > 9", 1.0),
        ("SELECT k FROM t", "", 0.0),
        ("", "", 1.0),
        ("", "SELECT k FROM t WHERE k > 9", 1.0),
        ("SELECT k FROM t", "SELECT nope FROM t", 0.0),
        ("SELECT nope FROM t", "SELECT nope FROM t", 0.0),
        ("SELECT k FROM t", "select K from T -- same query\n;", 1.0),
        ("SELECT k FROM t", "DROP TABLE t", 0.0),
        ("SELECT 9007199254740993", "SELECT 9007199254740992", 0.0),
        ("SELECT 1/0", "SELECT CAST(NULL AS DOUBLE)", 1.0),
        ("SELECT 'a' || chr(31) || 'sb', 'c'", "SELECT 'a', 'b' || chr(31) || 'sc'", 0.0),
    ],
)
def test_pair_scores(spark, tables, gold, pred, score):
    assert scores(spark, tables, [(gold, pred)]) == [score]


def test_unknown_database_scores_zero(spark, tables):
    records = spark.createDataFrame([("1", "nowhere", "SELECT 1", "SELECT 1"), ("2", None, "SELECT 1", "SELECT 2")], RECORD)
    with A.view_runner(spark, tables) as run:
        got = {r["id"]: r["execution_accuracy"] for r in A.accuracy_samples(records, run).collect()}
    assert got == {"1": 0.0, "2": 1.0}


def test_a_query_that_fails_while_running_spares_its_batch(spark, tables):
    bad = "SELECT raise_error('no') FROM t"
    assert scores(spark, tables, [("SELECT k FROM t", "SELECT k FROM t WHERE true"), ("SELECT s FROM t", bad)]) == [1.0, 0.0]


def test_settings_and_views_are_restored(spark, tables):
    before = spark.conf.get("spark.sql.ansi.enabled")
    scores(spark, tables, [("SELECT k FROM t", "SELECT 1/0")])
    assert spark.conf.get("spark.sql.ansi.enabled") == before
    assert not spark.catalog.tableExists("t")


def test_equal_texts_run_once(spark):
    records = spark.createDataFrame(
        [("1", "d", "SELECT 1", "select 1 ;"), ("2", "d", "SELECT  1", "SELECT 2"), ("3", "e", "SELECT 1", None)], RECORD
    )
    queries = A.workload_queries(records).collect()
    assert sorted((q["db_id"], q["norm"], q["uses"]) for q in queries) == [
        ("d", "select 1", 3), ("d", "select 2", 1), ("e", "select 1", 1),
    ]


def test_same_bag_counts_duplicates(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "a double")
    assert A.same_bag(df(1.0, 2.0, 2.0), df(2.0, 1.0, 2.0000000001).withColumnRenamed("a", "b"))
    assert not A.same_bag(df(1.0, 2.0, 2.0), df(1.0, 1.0, 2.0))


def test_summary_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "id string, db_id string, execution_accuracy double")
    assert tuple(A.accuracy_summary(empty).head()) == (0.0, 0)


def test_samples_are_ordered_by_id_then_database(spark):
    rows = [("2", "a", 1.0), (None, "z", 1.0), ("10", "b", 0.0), ("10", "a", 0.0)]
    df = spark.createDataFrame(rows, "id string, db_id string, execution_accuracy double")
    assert [(r["id"], r["db_id"]) for r in A.ordered_samples(df).collect()] == [(None, "z"), ("10", "a"), ("10", "b"), ("2", "a")]


def test_evaluate_files_against_the_catalog(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS school")
    spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string").write.mode("overwrite").saveAsTable("school.pupil")
    gold = [{"id": "a", "question": "q", "query": "SELECT name FROM pupil", "db_id": "school"},
            {"id": "b", "question": "q", "query": "SELECT id FROM pupil", "db_id": "school"},
            {"id": "c", "question": "q", "query": "SELECT id FROM pupil", "db_id": "school"}]
    pred = [{"id": "a", "prediction": "SELECT name FROM pupil ORDER BY id"}, {"id": "b", "prediction": "SELECT id + 1 FROM pupil"}]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, gold)))
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, pred)))
    out = scratch_path(spark, "report")
    samples, summary = jobs.evaluate(spark, str(tmp_path / "g.jsonl"), str(tmp_path / "p.jsonl"), out_path=out)
    assert [(r["id"], r["execution_accuracy"]) for r in samples.collect()] == [("a", 1.0), ("b", 0.0), ("c", 0.0)]
    assert summary.head()["num_samples"] == 3
    assert spark.read.json(f"{out}/samples").count() == 3
    assert spark.catalog.currentDatabase() == "default"


def test_equal_plans_run_once(spark, tables, tmp_path):
    texts = [
        "SELECT k AS x FROM t WHERE k > 0 AND s = 'a'", "SELECT k AS y FROM t WHERE s = 'a' AND 0 < k", "SELECT t.k AS other FROM t WHERE (k > 0) AND (s = 'a')",
        "SELECT k FROM t WHERE k > 2", "SELECT raise_error('no') AS a FROM t", "SELECT raise_error('no') AS b FROM t", "SELECT nothing FROM t",
    ]
    records = [(str(i), "one", a, b) for i, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1]))]
    with A.view_runner(spark, tables) as run:
        queries = A.workload_queries(spark.createDataFrame(records, RECORD)).orderBy("query_id").collect()
        digests, errors = A.run_and_store(spark, iter(queries), run, str(tmp_path / "d"), batch=3)
        by_text = {q["query_id"]: q["sql"] for q in queries}
        stored = spark.read.parquet(*[str(p) for p in (tmp_path / "d").iterdir()])
        assert stored.count() == 2
        found = {by_text[r["query_id"]]: (r["n"], r["head"], r["tail"]) for r in digests.collect()}
        assert set(found) == set(texts[:4]) and found[texts[0]] == found[texts[1]] == found[texts[2]] != found[texts[3]]
        assert {by_text[r["query_id"]] for r in errors.collect()} == set(texts[4:])


def test_forgotten_plans_run_again(spark):
    folder = A.PlanFolder(held=2)
    plan = lambda n: spark.range(n)
    assert [folder.first(str(i), plan(n)) for i, n in enumerate([1, 2, 1, 3, 1, 3])] == [True, True, False, True, True, False]
    assert folder.same == [("2", "0"), ("5", "3")] and len(folder.plans) == 2
