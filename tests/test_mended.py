import json

import numpy as np

import pytest
from pyspark.sql import functions as F

from askgauge.functions.text import sql_key
from askgauge.operators import accuracy, cells, shift
from askgauge.plans import inputs
from askgauge.sources import records, tables


@pytest.mark.parametrize(
    ("left", "right", "same"),
    [
        ('SELECT 1 WHERE a = "France"', 'SELECT 1 WHERE a = "france"', False),
        ("SELECT 1 WHERE a = \"it's\" AND b = 'X'", "SELECT 1 WHERE a = \"it's\" AND b = 'x'", False),
        ('SELECT "a  b"', 'SELECT "a b"', False),
        ('SELECT "a -- b"', 'SELECT "a', False),
        ('SELECT "a /* b */ c"', 'SELECT "a  c"', False),
        ("SELECT `A B`", "select `A B` ;", True),
        ("SELECT  a -- x\nFROM t", "select a FROM\tT;", True),
        ("SELECT a/* x ** y */FROM t", "select a from t", True),
        ("SELECT 'it''s'  FROM t", "select 'it''s' from t", True),
        ("SELECT 'open FROM t", "SELECT 'open from t", True),
        (r"SELECT 'a\'B'", r"SELECT 'a\'b'", False),
        ("SELECT 1 - 2 / 3", "select 1 - 2 / 3", True),
    ],
)
def test_equal_keys_mean_the_same_query(spark, left, right, same):
    row = spark.createDataFrame([(left, right)], "a string, b string").select(sql_key(F.col("a")).alias("a"), sql_key(F.col("b")).alias("b")).first()
    assert (row["a"] == row["b"]) is same


def test_double_quoted_values_are_told_apart(spark, folder):
    pairs = [p for p in inputs.QUERY_PAIRS if p[0] in {"17", "19", "21"}]
    rows = spark.createDataFrame(pairs, "id string, db_id string, gold_sql string, pred_sql string")
    with accuracy.view_runner(spark, inputs.databases(spark, folder)) as run:
        got = {r["id"]: r["execution_accuracy"] for r in accuracy.accuracy_samples(rows, run).collect()}
    assert got == {"17": 0.0, "19": 0.0, "21": 1.0}


GOLD = [{"id": "1", "db_id": "d", "query": "SELECT 1"}, {"id": "2", "db_id": "d", "query": "SELECT 2"}]
PRED = [{"id": "2", "prediction": "SELECT 22"}, {"id": "1", "prediction": "SELECT 11"}]


def aligned(spark, folder, gold, pred, dump, **options):
    for name, rows in (("gold", gold), ("pred", pred)):
        (folder / name).write_text(dump(rows))
    rows = records.load_aligned(spark, str(folder / "gold"), str(folder / "pred"), **options).collect()
    return sorted((r["gold_sql"], r["pred_sql"]) for r in rows)


def lines(rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


def test_array_files_align_like_line_files(spark, tmp_path):
    want = [("SELECT 1", "SELECT 11"), ("SELECT 2", "SELECT 22")]
    assert aligned(spark, tmp_path, GOLD, PRED, lines) == want
    assert aligned(spark, tmp_path, GOLD, PRED, lambda r: json.dumps(r, indent=2)) == want


def test_files_without_ids_align_by_position(spark, tmp_path):
    bare = lambda rows: [{k: v for k, v in r.items() if k != "id"} for r in rows]
    assert aligned(spark, tmp_path, bare(GOLD), bare(PRED), lines) == [("SELECT 1", "SELECT 22"), ("SELECT 2", "SELECT 11")]
    with pytest.raises(ValueError, match="no id"):
        aligned(spark, tmp_path, bare(GOLD), bare(PRED), lines, by="id")
    with pytest.raises(ValueError, match="no id"):
        aligned(spark, tmp_path, GOLD, bare(PRED), lines)


def test_repeated_ids_and_broken_files_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="2 times"):
        aligned(spark, tmp_path, [*GOLD, GOLD[0]], PRED, lines)
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        aligned(spark, tmp_path, GOLD, PRED, lambda r: lines(r) + "{broken\n")


def test_every_csv_file_is_read(spark, tmp_path):
    for i in range(510):
        (tmp_path / f"t{i:03}.csv").write_text(f"a,b\n{i},x\n")
    found, errors = tables.load_first_tables(spark, [str(tmp_path)])
    assert found.select("table_id").distinct().count() == 510 and errors.count() == 0


def test_suffixed_names_stay_distinct(spark):
    names = [["A", "a", "a_1"], ["a", "a", "a", "a_1", "a_2"], ["a_1", "a", "a"], [], ["x"], ["b", "a", "b"]]
    df = spark.createDataFrame([(n,) for n in names], "n array<string>")
    for row in df.select("n", tables.with_running_suffix(F.transform("n", F.lower), "_").alias("m")).collect():
        assert len(set(row["m"])) == len(row["n"]) == len(row["m"])
    assert df.select(tables.with_running_suffix(F.col("n"), "_")).collect()[5][0] == ["b", "a", "b_1"]


def test_long_wikisql_rows_are_reported(spark):
    rows = spark.createDataFrame([("ok", ["a"], [["1"]]), ("bad", ["a"], [["1"], ["1", "2"]])], "id string, header array<string>, rows array<array<string>>")
    assert {r["table_id"] for r in tables.wikisql_to_cells(rows).collect()} == {"ok"}
    assert [r["table_id"] for r in tables.wikisql_errors(rows).collect()] == ["bad"]


def test_digest_sums_do_not_overflow(spark):
    big = spark.range(200_000).select(F.lit(1).alias("a"))
    row = accuracy.bag_digest(big, "q").first()
    assert row["n"] == 200_000 and row["head"] > 0


def test_foreign_keys_beyond_the_first_rows(spark):
    rows = [("a", i, 0, "k", str(i % 3000)) for i in range(3000)] + [("b", i, 0, "k", str(2999 - i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "table_id string, row_idx long, col_idx int, col_name string, value string")
    assert cells.infer_foreign_keys(df).first()["shared"] == 1500
    assert cells.infer_foreign_keys(df, sample=1000).count() == 0


def test_wide_directions_match_numpy(spark):
    rng = np.random.default_rng(4)
    scale = np.concatenate([[9, 7, 5, 3], np.full(2044, 0.05)])
    rows = [(k, (rng.normal(size=2048) * np.roll(scale, 3 * k)).tolist()) for k in range(2) for _ in range(60)]
    vectors = spark.createDataFrame(rows, "pair_id int, embedding array<double>")
    base = [(rng.normal(size=2048) * scale * 0.1).tolist() for _ in range(30)]
    shared = spark.createDataFrame([(b,) for b in base], "embedding array<double>")
    got = shift.pca_directions_by_key(vectors, "pair_id", 3, shared=shared)
    for k in range(2):
        own = np.array([v for key, v in rows if key == k] + base)
        want = np.linalg.svd(own - own.mean(0), full_matrices=False)[2][:3]
        assert np.allclose(np.abs((got[k] * want).sum(axis=1)), 1, atol=1e-3)


def test_json_array_limit_keeps_the_first_objects(spark, tmp_path):
    for name, start, n in (("a", 0, 3), ("b", 3, 400), ("c", 403, 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"id": str(start + i)} for i in range(n)]))
    for limit in (0, 2, 5, 404):
        got = records.read_json_array(spark, str(tmp_path), limit=limit).collect()
        assert [int(r["id"]) for r in got] == list(range(limit))
    assert records.read_json_array(spark, str(tmp_path)).count() == 405


@pytest.mark.parametrize("sizes", [(40, 400), (400, 40), (40, 40)])
def test_foreign_keys_count_from_either_side(spark, sizes):
    """The smaller column lies in the left table, in the right one, or both are as large."""
    rows = [(t, i, c, f"{t}{c}", f"{c}-{i}") for t, n in zip("ab", sizes) for i in range(n) for c in (0, 1)]
    df = spark.createDataFrame(rows, "table_id string, row_idx long, col_idx int, col_name string, value string")
    got = sorted(tuple(r) for r in cells.infer_foreign_keys(df).collect())
    assert got == [("a", f"a{c}", "b", f"b{c}", 40, 1.0) for c in (0, 1)]
