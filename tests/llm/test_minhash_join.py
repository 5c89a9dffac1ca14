from collections import Counter

import numpy as np
import pytest

from askgauge.llm import minhash_join
from tests.llm import brute, nasty


def expected(rows, percent=85):
    return Counter((k, n, c, k == c) for k, n, c in brute.jaccard_components(rows, percent))


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def near_copies(seed, many, step=1, words=130, apart=1):
    base = nasty.prose(seed, words).split()
    return [" ".join([*base[: i % 120], *[f"w{i}" for _ in range(apart)], *base[i % 120 + apart :]]) for i in range(0, many * step, step)]


def test_matches_brute_force(spark):
    got = minhash_join.near_duplicate_components(nasty.documents(spark))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert counted(got) == expected(nasty.pairs())
    assert minhash_join.near_duplicate_components(nasty.nothing(spark)).count() == 0


def mixed_rows():
    texts = near_copies(4, 60) + near_copies(5, 40, apart=2) + [nasty.prose(50 + i, 60) for i in range(20)] + near_copies(6, 30, apart=5)
    texts += ["short text of six words " + str(i) for i in range(30)] + ["a b c d e f", "A b c  d e f"]
    return [(i * 3 % 211, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_thresholds(spark, percent):
    """Pairs that agree in two thirds of all positions and more are found; of less alike ones, not all share a key."""
    rows = mixed_rows()
    got = minhash_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=percent)
    assert counted(got) == expected(rows, percent)


@pytest.mark.parametrize("compared, local, heavy", [(3, 64, 1_500_000), (1024, 2, 1_500_000), (1024, 64, 3_000), (2, 2, 1_500)])
def test_large_groups(spark, monkeypatch, compared, local, heavy):
    """Crowded keys are connected without comparison, and large groups are compared in parts: the links stay the same."""
    monkeypatch.setattr(minhash_join, "COMPARED", compared)
    monkeypatch.setattr(minhash_join, "LOCAL", local)
    rows = mixed_rows()
    got = minhash_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), heavy=heavy)
    assert counted(got) == expected(rows)


def test_all_pairs_within_the_radius_share_a_key():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 1 << minhash_join.BITS, (300, minhash_join.POSITIONS)).astype("<u2")
    other = one.copy()
    for i in range(300):
        other[i, rng.choice(minhash_join.POSITIONS, minhash_join.RADIUS, replace=False)] ^= 7
    a, b = minhash_join.chunk_keys(one), minhash_join.chunk_keys(other)
    assert (a == b).any(axis=1).all()
    assert all(minhash_join.differing(minhash_join.brief(other[i : i + 1]), minhash_join.brief(one[i : i + 1])[0])[0] <= minhash_join.RADIUS for i in range(300))


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    agree = 0
    for i in range(200):
        both, a, b = pool[i * 10 : i * 10 + 85], pool[2000 + i : 2007 + i], pool[2500 + i : 2508 + i]
        tokens = np.concatenate([both, a, both, b])
        x, y = minhash_join.signatures(tokens, np.array([92, 93]))
        agree += (x == y).sum()
    assert abs(agree / (200 * minhash_join.POSITIONS) - 0.85) < 0.02


def test_confirm_finds_all_links():
    rng = np.random.default_rng(7)
    base = np.sort(rng.choice(1 << 40, 60, replace=False).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 55, replace=False), rng.integers(0, 1 << 40, 3).astype(np.uint64)])) for _ in range(80)]
    likeness = [[len(np.intersect1d(a, b)) * 100 >= 85 * len(np.union1d(a, b)) for b in sets] for a in sets]

    def groups(pairs):
        own = list(range(80))
        for x, y in pairs:
            own = [own[x] if g == own[y] else g for g in own]
        return {frozenset(i for i in range(80) if own[i] == g) for g in set(own)}

    assert groups(minhash_join.confirm(sets, 85)) == groups([(i, j) for i in range(80) for j in range(i) if likeness[i][j]])
    ask = np.arange(80) % 9 == 0
    assert groups(minhash_join.confirm(sets, 85, ask)) == groups([(i, j) for i in range(80) for j in range(i) if likeness[i][j] and (ask[i] or ask[j])])
