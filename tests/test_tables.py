import json

import pytest
from pyspark.sql import functions as F

from askgauge.functions.fixed_values import DB_ID_PREFIX
from askgauge.operators import cells as C
from askgauge.operators import dedup as D
from askgauge.operators import workload as W
from askgauge.plans import jobs
from askgauge.sources import records as R
from askgauge.sources import sinks, tables, vectors
from askgauge.sources.lines import dense_position, mark_position

CELL = "table_id string, row_idx long, col_idx int, col_name string, value string"


def cell_frame(spark, table_id, header, rows):
    data = [(table_id, i, j, h, row[j]) for i, row in enumerate(rows) for j, h in enumerate(header)]
    return spark.createDataFrame(data, CELL)


def wide(cells):
    out = {}
    for c in cells.collect():
        out.setdefault(c["table_id"].rsplit("/", 1)[-1], {}).setdefault(c["row_idx"], {})[c["col_name"]] = c["value"]
    return {t: [rows[i] for i in sorted(rows)] for t, rows in out.items()}


def test_csv_files_with_unlike_headers(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text('id,name,id\n1,"x, y",\n\n2,NA,7\n')
    (tmp_path / "deep" / "b.csv").write_text("k\n5\n")
    (tmp_path / "bad.csv").write_text("p,q\n1,2\n1,2,3\n")
    (tmp_path / "skip.txt").write_text("p,q\n")
    listed = [r["path"].rsplit("/", 1)[-1] for r in tables.discover_csv_files(spark, [str(tmp_path)]).collect()]
    assert listed == ["a.csv", "bad.csv", "b.csv"]
    found, errors = tables.load_first_tables(spark, [str(tmp_path)])
    assert wide(found) == {
        "a.csv": [{"id": "1", "name": "x, y", "id.1": None}, {"id": "2", "name": None, "id.1": "7"}],
        "b.csv": [{"k": "5"}],
    }
    assert [r["table_id"].rsplit("/", 1)[-1] for r in errors.collect()] == ["bad.csv"]
    first, _ = tables.load_first_tables(spark, [str(tmp_path)], max_tables=1, max_columns=8)
    assert set(wide(first)) == {"a.csv"}
    narrow, errors = tables.load_first_tables(spark, [str(tmp_path)], max_columns=2)
    assert set(wide(narrow)) == {"b.csv"}
    assert {r["table_id"].rsplit("/", 1)[-1] for r in errors.collect()} == {"a.csv", "bad.csv"}


def test_csv_values_with_line_breaks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n"one\ntwo",3\n')
    found, _ = tables.csv_to_cells(spark, [str(tmp_path / "m.csv")], max_columns=4, multi_line=True)
    assert wide(found) == {"m.csv": [{"a": "one\ntwo", "b": "3"}]}


def test_positions_are_dense_across_file_blocks(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 40)}" for i in range(3000)]
    (tmp_path / "f.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        marked = mark_position(spark.read.text(str(tmp_path / "f.txt")))
        assert marked.select("_block").distinct().count() > 3
        got = {r["line_no"]: r["value"] for r in dense_position(marked).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [got[i] for i in range(3000)] == lines


def test_structure_needs_rows_and_columns(spark):
    big = cell_frame(spark, "big", list("abcde"), [list("12345")] * 5)
    short = cell_frame(spark, "short", list("abcde"), [list("12345")] * 4)
    thin = cell_frame(spark, "thin", list("abcd"), [list("1234")] * 9)
    found = C.structural_filter(big.unionByName(short).unionByName(thin)).collect()
    assert [(r["table_id"], r["n_rows"], r["n_cols"]) for r in found] == [("big", 5, 5)]


def test_richness_counts_words_per_cell(spark):
    df = cell_frame(spark, "t", ["a", "b"], [["Red car", None], ["red", "  "]])
    # Words: red, car, nan; four cells.
    assert C.semantic_richness(df).head()["richness"] == pytest.approx(0.75)


def test_english_headers(spark):
    df = spark.createDataFrame(
        [("en", ["the_name", "x"]), ("late", ["x"] * 5 + ["the"]), ("none", ["q1", "q2"])], "table_id string, header array<string>"
    )
    assert sorted(r[0] for r in C.english_tables(df).collect()) == ["en", "late"]
    assert [r[0] for r in C.english_tables(df, first=5).collect()] == ["en"]


def test_header_hash_ignores_case_and_blanks(spark):
    df = spark.createDataFrame([("a", [" ID", "Name "]), ("b", ["id", "name"]), ("c", ["name", "id"])], "table_id string, header array<string>")
    got = {r[0]: r[1] for r in C.header_hash(df).collect()}
    assert got["a"] == got["b"] != got["c"]


def test_first_rows(spark):
    df = cell_frame(spark, "t", ["a", "b"], [[str(i), "v"] for i in range(20)])
    assert C.first_rows(df, 3).count() == 6


def test_foreign_keys_against_all_pairs(spark):
    import random

    rnd = random.Random(2)
    sets = {}
    frames = []
    for t in range(4):
        header = [f"c{j}" for j in range(3)]
        rows = [[str(rnd.randint(0, 6 + 5 * j)) if rnd.random() > 0.1 else None for j in range(3)] for _ in range(15)]
        frames.append(cell_frame(spark, f"t{t}", header, rows))
        for j, h in enumerate(header):
            sets[(f"t{t}", h)] = {r[j] if r[j] is not None else "nan" for r in rows[:10]}
    expected = {
        (*a, *b)
        for a in sets for b in sets
        if a[0] < b[0] and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) > 0.8
    }
    got = C.infer_foreign_keys(tables.union_cells(frames), sample=10).collect()
    assert expected and {tuple(r)[:4] for r in got} == expected


def mutated_headers(seed, count=80):
    import random

    rnd = random.Random(seed)
    base = [[rnd.choice(["id", "name", "total", "city code", "x"]) + str(rnd.randint(0, 3)) for _ in range(rnd.randint(1, 5))] for _ in range(15)]
    out = []
    for i in range(count):
        header = list(rnd.choice(base))
        if rnd.random() < 0.6:
            spot = rnd.randrange(len(header))
            header[spot] = header[spot].upper() + rnd.choice(["", "a", "ab", " z"])
        out.append((f"t{i:03d}", header))
    return out


@pytest.mark.parametrize("threshold", [70.0, 80.0, 90.0])
def test_near_duplicates_and_clusters_against_a_plain_walk(spark, threshold):
    from askgauge.functions.similarity import common_subsequence

    rows = mutated_headers(int(threshold))
    headers = spark.createDataFrame(rows, "table_id string, header array<string>")
    text = {t: " ".join(sorted("|".join(h.strip().lower() for h in hs).split())) for t, hs in rows}
    near = lambda a, b: a == b or 200 * common_subsequence(a, b) / (len(a) + len(b)) >= threshold
    first = {}
    for t in sorted(text):
        first.setdefault(text[t], t)
    nodes = sorted(first.values())
    pairs = {(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if near(text[a], text[b])}
    assert pairs and {(r["a"], r["b"]) for r in D.header_near_dups(headers, threshold).collect()} == pairs
    led = {}
    for a in sorted(text):
        if a not in led:
            led[a] = a
            for b in sorted(text):
                if b not in led and near(text[a], text[b]):
                    led[b] = a
    clusters = D.cluster_tables(headers, threshold)
    assert {r["table_id"]: r["leader_id"] for r in clusters.collect()} == led
    numbers = {leader: f"{DB_ID_PREFIX}{i:05d}" for i, leader in enumerate(sorted(set(led.values())))}
    got = {r["table_id"]: r["db_id"] for r in D.assign_db_ids(clusters).collect()}
    assert got == {t: numbers[leader] for t, leader in led.items()}
    assert {r[0] for r in D.near_dup_filter(clusters).collect()} == set(numbers)


def test_leaders_on_a_long_chain(spark):
    nodes = spark.range(12).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)], "a long, b long")
    got = {r["node"]: r["leader"] for r in D.lead_nodes(nodes, edges).collect()}
    assert got == {i: i - i % 2 for i in range(12)}


@pytest.mark.parametrize("walk_edges", [0, 25, 200_000])
def test_leaders_do_not_depend_on_the_size_of_components(spark, walk_edges):
    import random

    rnd = random.Random(walk_edges)
    edges = sorted({tuple(sorted(rnd.sample(range(g, g + 25), 2))) for g in range(0, 200, 25) for _ in range(10 + g // 5)})
    led = {}
    for a in range(210):
        if a not in led:
            led[a] = a
            for x, y in edges:
                if x == a:
                    led.setdefault(y, a)
    got = D.lead_nodes(spark.range(210).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long"), walk_edges)
    assert {r["node"]: r["leader"] for r in got.collect()} == led
    none = D.lead_nodes(spark.range(3).withColumnRenamed("id", "node"), spark.createDataFrame([], "a long, b long"), walk_edges)
    assert {tuple(r) for r in none.collect()} == {(0, 0), (1, 1), (2, 2)}


@pytest.mark.parametrize("per_task", [6, 40, 250_000])
def test_components_of_a_graph(spark, per_task):
    import random

    from askgauge.operators.components import connected_labels

    rnd = random.Random(3)
    ids = [f"n{i}" for i in range(300)]
    edges = [tuple(rnd.sample(ids, 2)) for _ in range(110)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)] + [("n1", "n1")]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = [tuple(r) for r in connected_labels(spark.createDataFrame(edges, "a string, b string"), per_task).collect()]
    assert sorted(got) == sorted((x, top(x)) for x in parent)


def test_rare_ends_cover_so_many_values(spark):
    df = spark.range(1000).selectExpr("'t' as table_id", "cast(id % 2 as int) as col_idx", "id as value", "cast(1 + id % 7 as bigint) as df")
    ordered = df.withColumn("order", C.rarity_order(F.col("df"), F.col("value").cast("string")))
    for many in (1, 10, 499, 500):
        kept = ordered.join(C.rare_ends(ordered, F.lit(many)), ["table_id", "col_idx"]).withColumn("rare", F.col("order") <= F.col("last"))
        got = kept.groupBy("col_idx").agg(F.count_if("rare").alias("n"), F.max(F.when(F.col("rare"), F.floor(F.log2("df")))).alias("most"), F.min(F.when(~F.col("rare"), F.floor(F.log2("df")))).alias("least")).collect()
        for r in got:
            assert many <= r["n"] <= many + 5 and (r["least"] is None or r["most"] <= r["least"])


def test_join_keeps_all_columns(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "c"), (1, "d"), (None, "e")], "k int, w string")
    got = W.join_on_column(left, right, "k")
    assert got.columns == ["k", "v", "k_right", "w"] and got.count() == 2


def test_nulls_never_repeat(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    assert [r[0] for r in W.repeated_values(df, "k").collect()] == [1, 1]


def test_one_column_table_has_no_grouped_query(spark):
    catalog = spark.createDataFrame([("t", ["a"]), ('q"t', ["b", "c"])], "table_name string, columns array<string>")
    kinds = {(r["table_name"], r["kind"]): r["sql"] for r in W.sql_workload(catalog).collect()}
    assert ("t", "group") not in kinds and len(kinds) == 7
    assert kinds[('q"t', "count")] == 'SELECT COUNT(*) FROM "q""t"'


def test_join_workload(spark):
    keys = spark.createDataFrame([("a", "id", "b", "id"), ("a", "x", "b", "y")], "left_table string, left_column string, right_table string, right_column string")
    assert [r["sql"] for r in W.join_workload(keys).collect()] == ['SELECT * FROM "a" JOIN "b" ON "a"."id" = "b"."id"']


def test_rating_is_the_first_number(spark):
    df = spark.createDataFrame([("Score: 0.75 of 1",), ("none",), (None,), ("1",)], "v string")
    assert [r[0] for r in df.select(W.parse_rating(F.col("v"))).collect()] == [0.75, None, None, 1.0]


def test_json_array_reader(spark, tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text(json.dumps([{"id": "1", "question": "é, [x]"}, {"id": "2", "text": "t"}]))
    bad.write_text('[{"id": "1"}, {"id": ')
    assert [r["id"] for r in R.read_json_array(spark, str(good)).collect()] == ["1", "2"]
    assert R.read_json_array(spark, str(good), limit=1).count() == 1
    with pytest.raises(Exception):
        R.read_json_array(spark, str(bad)).collect()
    R.array_to_lines(spark, str(good), str(tmp_path / "lines"))
    assert spark.read.parquet(str(tmp_path / "lines")).count() == 2


def test_alignment_by_position(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps({"query": f"SELECT {i}", "db_id": "d"}) for i in range(5)))
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"prediction": f"SELECT {i}"}) for i in range(4)))
    got = R.load_aligned(spark, str(tmp_path / "g.jsonl"), str(tmp_path / "p.jsonl"), by="position")
    assert sorted((r["gold_sql"], r["pred_sql"]) for r in got.collect()) == [(f"SELECT {i}", f"SELECT {i}" if i < 4 else "") for i in range(5)]


def test_field_texts_with_a_limit_on_scanned_records(spark):
    rows = [("1", "a"), ("2", " "), ("3", None), ("4", "b")]
    df = spark.createDataFrame(rows, "id string, question string")
    texts, counts = R.collect_texts(df, "question", limit=3, order=["id"])
    assert [r[0] for r in texts.collect()] == ["a"] and tuple(counts.head()) == (1, 2)


def test_json_vectors_and_pairs(spark, tmp_path):
    (tmp_path / "e.json").write_text("[[1.0, 2.0], [3.0, 4.0]]")
    assert [list(r["embedding"]) for r in vectors.read_embeddings(spark, str(tmp_path / "e.json")).orderBy("vec_id").collect()] == [[1, 2], [3, 4]]
    (tmp_path / "p.json").write_text('[{"source": "a", "target": "b", "metric": 0.5}, {"source": "b", "target": "a", "metric": 0.7}]')
    pairs = vectors.read_pairs(spark, str(tmp_path / "p.json"))
    named = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("b", [3.0])], "workload string, embedding array<float>")
    sides = sorted((r["pair_id"], r["side"], r["embedding"][0]) for r in vectors.pair_vectors(pairs, named).collect())
    assert sides == [(1, "source", 1.0), (1, "target", 2.0), (1, "target", 3.0), (2, "source", 2.0), (2, "source", 3.0), (2, "target", 1.0)]


def test_tables_are_saved_under_cleaned_names(spark):
    one = cell_frame(spark, "/x/Sales Data.csv", ["Total Sum", "total_sum", "Day"], [["1", "2.5", "mon"], ["3", None, "tue"]])
    two = cell_frame(spark, "/y/sales data.csv", ["K"], [["z"]])
    members = spark.createDataFrame([("/x/Sales Data.csv", "db_m"), ("/y/sales data.csv", "db_m")], "table_id string, db_id string")
    assert sinks.materialize_tables(one.unionByName(two), members) == ["db_m.sales_data", "db_m.sales_data_2"]
    saved = spark.table("db_m.sales_data")
    assert dict(saved.dtypes) == {"total_sum": "bigint", "total_sum_1": "double", "day": "string"}
    assert saved.count() == 2


def test_dataset_from_raw_tables(spark, tmp_path):
    header = ["the id", "Name of it", "c", "d", "e"]
    rows = [[str(i), f"word{i} thing", "x", "y", "z"] for i in range(6)]
    kept = cell_frame(spark, "/in/a.csv", header, rows).unionByName(cell_frame(spark, "/in/b.csv", header, rows))
    dropped = cell_frame(spark, "/in/c.csv", ["q"], [["1"]])
    found = jobs.build_dataset(kept.unionByName(dropped), str(tmp_path / "out"), materialize=True).collect()
    assert len(found) == 2 * 4 * 8
    assert {r["db_id"] for r in found} == {f"{DB_ID_PREFIX}00000"} and len({r["id"] for r in found}) == len(found)
    assert spark.table(f"{DB_ID_PREFIX}00000.a").columns == ["the_id", "name_of_it", "c", "d", "e"]
    assert sinks.read_dataset(spark, str(tmp_path / "out")).count() == len(found)


def test_dataset_with_a_model(spark):
    header = ["the id", "b", "c", "d", "e"]
    rows = [[str(i), f"word{i} thing", "x", "y", "z"] for i in range(6)]

    def make(settings):
        import numpy as np

        def answer(prompts):
            return np.array(["Q: new\nA: SELECT 2" if "Original Q" in p else "first\nsecond" for p in prompts], dtype=object)

        return answer

    found = jobs.build_dataset(cell_frame(spark, "/in/a.csv", header, rows), make_fn=make, rewrites=True).collect()
    # Four queries with two questions each, and three rewrites of each question.
    assert len(found) == 4 * 2 + 4 * 2 * 3
    assert len({r["id"] for r in found}) == len(found)
