import numpy as np
import pytest
from pyspark.sql import functions as F

from askgauge.functions.vectors import unit_directions
from askgauge.operators import pooling, sampling, shift, subsets

DIM = 6


def frame(spark, source, target):
    rows = [("source", [float(x) for x in v]) for v in source] + [("target", [float(x) for x in v]) for v in target]
    return spark.createDataFrame(rows, "side string, embedding array<float>")


def expected(source, target, directions):
    s, t = np.asarray(source, np.float32).astype(float), np.asarray(target, np.float32).astype(float)
    vs, vt = s.var(0) + 1e-8, t.var(0) + 1e-8
    dist = np.sqrt((((t - s.mean(0)) ** 2) / vs).sum(1))
    m = min(len(s), len(t))
    ps, pt = np.sort(s @ directions.T, axis=0)[:m], np.sort(t @ directions.T, axis=0)[:m]
    return [
        ((t.mean(0) - s.mean(0)) ** 2).sum(),
        ((np.sqrt(vt / vs) - 1) ** 2).sum(),
        dist.mean(),
        dist.std(),
        np.sqrt(((pt - ps) ** 2).mean(0)).mean(),
    ]


@pytest.fixture(scope="module")
def clouds():
    rnd = np.random.RandomState(5)
    source = rnd.normal(size=(70, DIM))
    target = rnd.normal(loc=0.4, scale=1.5, size=(41, DIM))
    # A third of the source is copies of one vector.
    source[:25] = source[0]
    return source, target


def test_delta_against_numpy(spark, clouds):
    got = shift.delta(frame(spark, *clouds), 8).head()
    assert np.allclose(list(got), expected(*clouds, unit_directions(DIM, 8)), rtol=1e-9)


def test_slots_and_blocks_do_not_change_the_distance(spark, clouds, monkeypatch):
    vectors, directions = frame(spark, *clouds), unit_directions(DIM, 5)
    whole = shift.sliced_distance(vectors, directions, slots=1).head()["swd"]
    monkeypatch.setattr(shift, "ROWS_PER_SLOT", 13)
    assert shift.sliced_distance(vectors, directions, slots=7).head()["swd"] == pytest.approx(whole, rel=1e-12)


def test_same_result_under_other_partitions(spark, clouds):
    vectors, directions = frame(spark, *clouds), unit_directions(DIM, 5)
    one = shift.sliced_distance(vectors.coalesce(1), directions).head()["swd"]
    many = shift.sliced_distance(vectors.repartition(13), directions).head()["swd"]
    assert one == pytest.approx(many, rel=1e-12)


def test_equal_sets_have_no_shift(spark, clouds):
    got = shift.delta(frame(spark, clouds[0], clouds[0]), 4).head()
    assert got["mean_shift"] == pytest.approx(0) and got["scale_shift"] == pytest.approx(0)
    assert got["swd"] == pytest.approx(0)


def test_one_empty_side_gives_no_distance(spark, clouds):
    vectors = frame(spark, clouds[0], [])
    assert shift.sliced_distance(vectors, unit_directions(DIM, 3)).head()["swd"] == 0.0


def test_keyed_delta_equals_single_ones(spark, clouds):
    source, target = clouds
    first = frame(spark, source, target).withColumn("pair_id", F.lit(1))
    second = frame(spark, target, source).withColumn("pair_id", F.lit(2))
    got = {r["pair_id"]: list(r)[1:] for r in shift.delta(first.unionByName(second), 4, ["pair_id"]).collect()}
    assert np.allclose(got[1], expected(source, target, unit_directions(DIM, 4)))
    assert np.allclose(got[2], expected(target, source, unit_directions(DIM, 4)))


def test_pca_directions_against_numpy(spark, clouds):
    got = shift.pca_directions(frame(spark, *clouds), 3)
    joint = np.vstack(clouds).astype(np.float32).astype(float)
    values, basis = np.linalg.eigh(np.cov(joint.T))
    top = basis[:, ::-1].T[:3]
    assert np.allclose(np.abs((got * top).sum(1)), 1, atol=1e-6)
    assert all(row[np.abs(row).argmax()] > 0 for row in got)


def test_hybrid_uses_both_kinds_of_direction(spark, clouds):
    vectors = frame(spark, *clouds)
    directions = np.vstack([shift.pca_directions(vectors, 2), unit_directions(DIM, 3)])
    got = shift.sliced_distance_hybrid(vectors, pca_k=2, rand_r=3).head()["swd"]
    assert got == pytest.approx(expected(*clouds, directions)[4], rel=1e-6)


def test_report_counts_skipped(spark, clouds):
    blank = spark.createDataFrame([("source", None), ("target", None), ("target", None)], "side string, embedding array<float>")
    got = shift.shift_report(frame(spark, *clouds).unionByName(blank), slices=2).head()
    assert (got["source_count"], got["target_count"], got["source_skipped"], got["target_skipped"]) == (70, 41, 1, 2)


def test_sample_sets_are_exact_and_repeatable(spark):
    ids = spark.range(300).withColumnRenamed("id", "rec_id")
    draw = lambda df: sorted(map(tuple, sampling.sample_sets(df, 4, 37, seed=3).collect()))
    first = draw(ids)
    assert first == draw(ids.repartition(11))
    assert len(first) == len(set(first)) == 4 * 37
    assert {s for s, _ in first} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        sampling.sample_sets(ids, 1, 301)


def test_smallest_by_hash_takes_everything_when_asked_for_more(spark):
    assert sampling.smallest_by_hash(spark.range(10), 50, ["id"]).count() == 10
    assert sampling.smallest_by_hash(spark.range(10), 3, ["id"]).count() == 3


@pytest.mark.parametrize("n, size", [(10, 2), (11, 2), (25, 5), (100, 20), (47, 9)])
def test_holdout_size(spark, n, size):
    held = sampling.holdout_split(spark.range(n), ["id"]).filter("is_holdout")
    assert held.count() == size


def test_shift_by_set_against_numpy(spark, clouds):
    source, target = clouds
    records = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(target)], "rec_id long, embedding array<float>")
    base = spark.createDataFrame([([float(x) for x in v],) for v in source], "embedding array<float>")
    members = sampling.sample_sets(records, 3, 17)
    got = {r["set_id"]: list(r)[1:] for r in subsets.shift_by_set(members, records, base, 17, 5).collect()}
    by_set = {}
    for r in members.collect():
        by_set.setdefault(r["set_id"], []).append(r["rec_id"])
    for set_id, picks in by_set.items():
        assert np.allclose(got[set_id], expected(source, target[sorted(picks)], unit_directions(DIM, 5)))


def top_directions(joint, k):
    basis = np.linalg.eigh(np.cov(np.asarray(joint, np.float32).astype(float).T))[1][:, ::-1].T[:k]
    return basis * np.sign(basis[np.arange(k), np.abs(basis).argmax(1)])[:, None]


def test_hybrid_by_key_has_directions_of_its_own(spark, clouds):
    source, target = clouds
    first = frame(spark, source, target).withColumn("pair_id", F.lit("x"))
    second = frame(spark, target, source[30:]).withColumn("pair_id", F.lit("y"))
    got = {r["pair_id"]: r["swd"] for r in shift.delta(first.unionByName(second), keys=["pair_id"], hybrid=True, pca_k=2, rand_r=3).collect()}
    for name, (s, t) in {"x": (source, target), "y": (target, source[30:])}.items():
        directions = np.vstack([top_directions(np.vstack([s, t]), 2), unit_directions(DIM, 3)])
        assert got[name] == pytest.approx(expected(s, t, directions)[4], rel=1e-6)


@pytest.mark.parametrize("slots", [1, 4])
def test_hybrid_by_set_against_numpy(spark, clouds, slots, monkeypatch):
    source, target = clouds
    records = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(target)], "rec_id long, embedding array<float>")
    base = spark.createDataFrame([([float(x) for x in v],) for v in source], "embedding array<float>")
    members = sampling.sample_sets(records, 2, 17)
    if slots > 1:
        monkeypatch.setattr(subsets, "ROWS_PER_SLOT", len(source) // slots)
    got = {r["set_id"]: r["swd"] for r in subsets.shift_by_set(members, records, base, 17, hybrid=True, pca_k=2, rand_r=3).collect()}
    by_set = {}
    for r in members.collect():
        by_set.setdefault(r["set_id"], []).append(r["rec_id"])
    for set_id, picks in by_set.items():
        chosen = target[sorted(picks)]
        directions = np.vstack([top_directions(np.vstack([source, chosen]), 2), unit_directions(DIM, 3)])
        assert got[set_id] == pytest.approx(expected(source, chosen, directions)[4], rel=1e-6)


def test_large_subsets_rank_by_slots(spark, clouds, monkeypatch):
    source, target = clouds
    records = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(target)], "rec_id long, embedding array<float>")
    base = spark.createDataFrame([([float(x) for x in v],) for v in source], "embedding array<float>")
    members = sampling.sample_sets(records, 2, 20)
    plain = sorted(map(tuple, subsets.shift_by_set(members, records, base, 20, 3).collect()))
    monkeypatch.setattr(subsets, "ROWS_PER_SLOT", 8)
    cut = sorted(map(tuple, subsets.shift_by_set(members, records, base, 20, 3).collect()))
    assert np.allclose(plain, cut)


def test_mean_pool(spark):
    rows = [("a", 1, [1.0, 2.0]), ("a", 0, [9.0, 9.0]), ("a", 1, [3.0, 4.0]), ("b", 0, [5.0, 5.0])]
    tokens = spark.createDataFrame(rows, "item string, mask int, embedding array<float>")
    got = {r["item"]: r["embedding"] for r in pooling.mean_pool(tokens, ["item"]).collect()}
    assert got == {"a": [2.0, 3.0], "b": [0.0, 0.0]}
