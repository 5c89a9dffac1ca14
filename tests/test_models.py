import numpy as np
import pytest
from pyspark.sql import functions as F

from askgauge.functions.schema_text import SCHEMA_TYPE
from askgauge.operators import models as M
from askgauge.operators.shift import DESCRIPTORS
from askgauge.plans import jobs


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.RandomState(1)
    data = []
    for i in range(60):
        x = rnd.uniform(size=5)
        data.append((i, *map(float, x), float(0.9 - 0.4 * x[0] - 0.2 * x[4])))
    schema = "set_id int, " + ", ".join(f"{d} double" for d in DESCRIPTORS) + ", accuracy double"
    return spark.createDataFrame(data, schema).cache()


@pytest.mark.parametrize("kind", ["linear", "gbt"])
def test_fit_and_reload(spark, rows, kind, tmp_path):
    model = M.fit_accuracy(rows, kind=kind)
    scored = M.predict_accuracy(model, rows)
    error = scored.select(F.avg(F.abs(F.col("predicted") - F.col("accuracy")))).head()[0]
    assert error < 0.06
    M.save_model(model, str(tmp_path / "m"))
    again = M.predict_accuracy(M.load_model(str(tmp_path / "m")), rows)
    assert [r["predicted"] for r in again.orderBy("set_id").collect()] == [r["predicted"] for r in scored.orderBy("set_id").collect()]


def test_few_rows_stay_uncalibrated(spark, rows):
    model = M.fit_accuracy(rows.filter("set_id < 9"))
    assert "calibrated" not in model.transform(rows).columns


def test_calibration_is_clipped(spark, rows):
    model = M.fit_accuracy(rows)
    far = rows.limit(1).withColumns({d: F.lit(-50.0) for d in DESCRIPTORS})
    top = max(model.stages[-1].predictions)
    assert M.predict_accuracy(model, far).head()["predicted"] == pytest.approx(top)


def test_error_report(spark):
    df = spark.createDataFrame([("a", 0.5, 0.4), ("a", 0.5, 0.7), ("b", 1.0, 1.0)], "g string, p double, y double")
    got = {r["g"]: (round(r["mae"], 6), r["n"]) for r in M.error_report(df, ["g"], "p", "y").collect()}
    assert got == {"a": (0.15, 2), "b": (0.0, 1)}


def test_hashed_vectors_have_unit_length(spark):
    df = M.embed_texts(spark.createDataFrame([("Select a FROM b",), ("select A from B",), ("",)], "text string"), dim=32)
    rows = [np.array(r["embedding"]) for r in df.collect()]
    assert np.allclose(rows[0], rows[1]) and np.isclose(np.linalg.norm(rows[0]), 1) and not rows[2].any()


def test_plugged_in_embedding(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    df = M.embed_texts(spark.createDataFrame([("abc",), ("a",)], "text string"), make)
    assert sorted(r["embedding"][0] for r in df.collect()) == [1.0, 3.0]


def test_settings_reach_the_model(spark):
    def make(settings):
        return lambda prompts: np.array([f" {p} {settings.temperature} ## tail" for p in prompts], dtype=object)

    df = spark.createDataFrame([("p",)], "prompt string")
    out = M.generate_text(df, make, settings=M.GenerationSettings(temperature=0.1, stop=["@@", "##"]))
    assert out.head()["output"] == "p 0.1"


def test_shift_between_record_sets(spark):
    item = {"table_name": "t", "table_comment": None, "column_names": ["a"], "column_types": None, "column_comments": None, "pk_indicators": None}
    schema = {"schema_items": [item], "foreign_keys": None}
    make = lambda tag, n: spark.createDataFrame(
        [(f"{tag} question {i}", None, schema if i else None) for i in range(n)], f"question string, text string, schema {SCHEMA_TYPE}"
    )
    got = jobs.shift_from_records(make("x", 12), make("y", 9), dim=16, slices=4).head()
    assert (got["source_count"], got["source_skipped"], got["target_count"], got["target_skipped"]) == (11, 1, 8, 1)
    assert got["swd"] > 0
    with pytest.raises(ValueError):
        jobs.shift_from_records(make("x", 1), make("y", 9), dim=16, slices=4)


def test_training_jobs(spark, tmp_path):
    rnd = np.random.RandomState(2)
    vector = lambda: [float(x) for x in rnd.normal(size=4)]
    source = spark.createDataFrame([(vector(),) for _ in range(40)], "embedding array<float>")
    target = spark.createDataFrame([(i, vector(), float(i % 2)) for i in range(50)], "rec_id long, embedding array<float>, accuracy double")
    model, rows = jobs.train_on_samples(source, target, num_sets=12, size=20, slices=4, kind="linear", out_path=str(tmp_path / "s"))
    assert rows.count() == 12
    assert spark.read.parquet(str(tmp_path / "s" / "membership")).count() == 240
    got = jobs.infer_accuracy(model, source, target.select("embedding"), slices=4).head()["predicted"]
    assert 0 <= got <= 1
    named = source.withColumn("workload", F.lit("a")).unionByName(target.select("embedding").withColumn("workload", F.lit("b")))
    pairs = spark.createDataFrame([(1, "a", "b", 0.6), (2, "b", "a", 0.4), (3, "a", "a", 0.9)], "pair_id int, source string, target string, metric double")
    pair_model = jobs.train_on_pairs(pairs, named, slices=4, kind="linear")
    assert "calibrated" not in pair_model.transform(rows).columns


def murmur3(data, seed=42):
    """The published 32-bit hash, word by word."""
    mask, h = 0xFFFFFFFF, seed
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    mix = lambda k: turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (turn(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if data[whole:]:
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = ((h ^ (h >> shift)) * factor) & mask
    return h


def test_hashed_vectors_against_plain_hash(spark):
    texts = ["select a from b", "one", "a a b", "zu x_1 ab", "", "the quick brown fox jumps over the lazy dog " * 200]
    df = M.embed_texts(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), dim=64)
    for row in df.collect():
        want = np.zeros(64)
        for word in texts[row["i"]].split():
            signed = murmur3(word.encode())
            want[(signed - (signed >> 31 << 32)) % 64] += 1
        assert np.allclose(row["embedding"], want / (np.linalg.norm(want) or 1), atol=1e-6)


def test_linear_fit_solves_the_normal_equations(spark, rows):
    fitted = M.fit_accuracy(rows, kind="linear", calibrate=False)
    data = np.array([[r[d] for d in DESCRIPTORS] + [r["accuracy"]] for r in rows.collect()])
    x, y = data[:, :-1], data[:, -1]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    # The penalty counts on inputs and a target of unit spread.
    moments = z.T @ z / len(y) + 0.01 / y.std() * np.eye(z.shape[1])
    weights = np.linalg.solve(moments, z.T @ (y - y.mean()) / len(y))
    scaled = weights * x.std(axis=0, ddof=1) / x.std(axis=0)
    assert np.allclose(fitted.stages[-1].coefficients.toArray(), scaled, rtol=1e-6)
