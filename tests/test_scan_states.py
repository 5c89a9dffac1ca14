"""CSV with line breaks and JSON arrays, read from files cut into many blocks."""

import json
import os
import random

import numpy as np
import pytest

from askgauge.sources import records, scan_states, tables

VALUES = ["a,b", "x\ny", 'he said "hi"', '5" disk', "", "\r\nend", '"', '""\n,"', "日本\n", "a\n\n\nb", 'tail"', "plain"]
# Within a field that does not start with a quote, quotes are plain characters.
BARE = ('5" disk', 'tail"')


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    yield lambda size: [spark.conf.set(n, str(v)) for n, v in zip(names, (size, 64))]
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def quoted(value, bare):
    if bare and value in BARE:
        return value
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n\r') else value


@pytest.mark.parametrize("size", [128 << 20, 997])
def test_csv_blocks_give_the_records_of_the_whole_file(spark, tmp_path, small_blocks, size):
    rnd = random.Random(3)
    rows = [[str(i)] + [rnd.choice(VALUES) for _ in range(3)] for i in range(600)]
    lines = [",".join(quoted(v, k % 2) for v in r) + ("\n" if k % 50 else "\n\n") for k, r in enumerate(rows)]
    (tmp_path / "m.csv").write_bytes(("id,p,q,r\n" + "".join(lines)).encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    small_blocks(size)
    found, errors = tables.csv_to_cells(spark, [str(tmp_path)], multi_line=True)
    got = {}
    for c in found.collect():
        got.setdefault(c["row_idx"], {})[c["col_name"]] = c["value"]
    assert [[got[i][n] or "" for n in ("id", "p", "q", "r")] for i in range(len(got))] == rows
    assert errors.isEmpty()


def test_csv_record_longer_than_many_blocks(spark, tmp_path, small_blocks):
    long = "line of text\n" * 800
    (tmp_path / "m.csv").write_text(f'k,v\r\n1,"{long}"\r\n2,"open to\nthe end')
    small_blocks(500)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = {r["line_no"]: r["text"] for r in scan_states.csv_records(spark, str(tmp_path)).collect()}
    assert got == {0: "k,v", 1: f'1,"{long}"', 2: '2,"open to\nthe end'}


def test_wide_record_makes_the_file_an_error(spark, tmp_path):
    (tmp_path / "m.csv").write_text('k\n"a\nb"\n1,2\n')
    found, errors = tables.csv_to_cells(spark, [str(tmp_path)], multi_line=True)
    assert found.isEmpty() and [r["error"] for r in errors.collect()] == ["record 2 has too many fields"]


@pytest.mark.parametrize("indent", [None, 1])
def test_array_blocks_give_the_objects_of_the_whole_file(spark, tmp_path, small_blocks, indent):
    rnd = random.Random(5)
    texts = ["}", 'a"}{', "\\", '\\"}', "[x]", "é,\n{", "plain"]
    objects = [{"id": str(i), "question": rnd.choice(texts) * rnd.randint(0, 3), "schema": {"tables": []}} for i in range(500)]
    (tmp_path / "a.json").write_text(json.dumps(objects, indent=indent))
    small_blocks(777)
    got = records.read_json_array(spark, str(tmp_path), "id string, question string", limit=len(objects)).collect()
    assert [(r["id"], r["question"]) for r in got] == [(o["id"], o["question"]) for o in objects]


def test_arrays_align_by_position(spark, tmp_path, small_blocks):
    gold, pred = tmp_path / "g.json", tmp_path / "p.json"
    gold.write_text(json.dumps([{"db_id": "d", "query": f"SELECT {i}"} for i in range(40)]))
    pred.write_text(json.dumps([{"pred_sql": f"SELECT {i}"} for i in range(40)], indent=2))
    small_blocks(300)
    got = records.load_aligned(spark, str(gold), str(pred)).collect()
    assert len(got) == 40 and all(r["gold_sql"] == r["pred_sql"] for r in got)


@pytest.mark.parametrize("text", ["[]", " [ ]\n", "", " \n"])
def test_arrays_without_objects(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert records.read_json_array(spark, str(tmp_path), "id string").collect() == []


@pytest.mark.parametrize(
    "text",
    ['[{"id":"1"} {"id":"2"}]', '[{"id":"1"},]', '{"id":"1"}', "[1,2]", '[{"id":"1"}', '[{"id":"1"}]]', '[{"id":"1"},,{"id":"2"}]', '[{"id":["1"}]', "[{]"],
)
def test_malformed_arrays_raise(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        records.read_json_array(spark, str(tmp_path), "id string").collect()


def test_states_compose_like_a_plain_walk():
    rng = np.random.default_rng(0)
    for _ in range(50):
        step = rng.choice([0, 1, 2, 3], size=rng.integers(1, 30), p=[0.1, 0.3, 0.5, 0.1])
        for entry in (0, 1):
            state, want = entry, []
            for s in step:
                state = (s >> state) & 1
                want.append(state)
            assert scan_states._states(step, entry).tolist() == want


@pytest.mark.parametrize("pieces", [3, 10_000])
def test_chunks_of_blocks_keep_records_whole(spark, tmp_path, small_blocks, pieces):
    """Records that cross chunks within a block; short lines take little more room than they have."""
    texts = [f"{i}\n" + "ab\n" * (i % 40) + "\n\nend" for i in range(400)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.csv").write_text("k\n" + "".join(f'"{t}"\n' for t in texts))
    size = (tmp_path / "in" / "m.csv").stat().st_size
    small_blocks(2000)
    shared, name = spark.sparkContext.getCheckpointDir(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(pieces))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "kept"))
    try:
        got = {r["line_no"]: r["text"] for r in scan_states.csv_records(spark, str(tmp_path / "in")).collect()}
    finally:
        spark.conf.set(name, before)
        if shared:
            spark.sparkContext.setCheckpointDir(os.path.dirname(shared))
    assert [got[i] for i in range(len(got))] == ["k", *(f'"{t}"' for t in texts)]
    stored = sum(p.stat().st_size for p in (tmp_path / "kept").rglob("part-*"))
    assert pieces == 3 or stored < 2 * size


def test_arrays_read_in_chunks_of_a_few_pieces(spark, tmp_path, small_blocks):
    rows = [{"a": i, "b": {"c": "}" * (i % 4) + '"[', "d": [{}, {"e": "x\\"}]}} for i in range(120)]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    small_blocks(1500)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        got = {r["line_no"]: json.loads(r["text"]) for r in scan_states.array_objects(spark, str(tmp_path / "m.json")).collect()}
    finally:
        spark.conf.set(name, before)
    assert [got[i] for i in range(len(got))] == rows
