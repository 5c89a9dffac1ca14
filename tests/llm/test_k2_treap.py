import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from askgauge.llm import k2_treap
from tests.llm import brute, nasty


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(text or ""))


def plain_scores(docs, items):
    """item place -> list of (score, key) of all documents above 0."""
    counts = [(k, Counter(terms_of(t))) for k, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for place, (_, text) in enumerate(items):
        found = []
        for key, c in counts:
            n = sum(c.values())
            m = 10 + 90 * n * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                found.append((score, key))
        out[place] = sorted(found, key=lambda p: (-p[0], p[1] is None, p[1]))[:10]
    return out


ITEMS = [(1, nasty.prose(1, 12)), (2, "12 thé x"), (3, None), (4, ""), (4, nasty.prose(9, 30)), (5, "nowhere"), (6, nasty.prose(7, 3) + " one two"), (None, "idiot on the an")]


def rows_by_item(got):
    out = defaultdict(list)
    for r in got.collect():
        out[r["item_id"]].append((r["rank"], r["score"], r["doc_id"]))
    return {k: sorted(v) for k, v in out.items()}


def wanted(docs, items):
    out = defaultdict(list)
    for place, found in plain_scores(docs, items).items():
        out[items[place][0]] += [(i + 1, s, k) for i, (s, k) in enumerate(found)]
    return {k: sorted(v) for k, v in out.items() if v}


@pytest.mark.parametrize("pass_terms", [20_000, 3])
def test_matches_brute_force(spark, pass_terms):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = k2_treap.search(k2_treap.build_index(nasty.documents(spark)), items, pass_terms=pass_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_by_item(got) == wanted(nasty.pairs(), ITEMS)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert k2_treap.search(k2_treap.build_index(nasty.nothing(spark)), items).count() == 0
    assert k2_treap.search(k2_treap.build_index(nasty.documents(spark)), items.where("item_id > 99")).count() == 0


def small_texts(seed, many):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("abcdefghijklmnopqrst") + rng.choice(["", "x", "y"]) for _ in range(rng.randint(0, 30)))) for i in range(many)]


def test_small_shards_and_ties(spark, monkeypatch):
    """Shards of at most 8 documents or 60 bytes; many equal scores."""
    monkeypatch.setattr(k2_treap, "SIDE_LOG2", 3)
    rows = small_texts(3, 150) + [(200 + i, "a b cx") for i in range(30)] + [(None, "a b cx"), (7, "a b cx")]
    items = [(i, " ".join(t for _, t in small_texts(40 + i, 2))) for i in range(12)] + [(90, "cx"), (91, "a b cx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for size in (60, 8_000_000):
        monkeypatch.setattr(k2_treap, "SHARD_BYTES", size)
        assert rows_by_item(k2_treap.search(k2_treap.build_index(docs), asked)) == wanted(rows, items)


def test_every_node_holds_the_largest_point_of_its_cell():
    rng = np.random.default_rng(1)
    height, many = 5, 700
    place = rng.choice(32 * 80, many, replace=False)
    row, col, rank = place // 32, place % 32, rng.integers(0, 50, many)
    levels, point, mask = k2_treap.build_treap(row, col, rank, height)
    assert sorted(point.tolist()) == list(range(many)) and levels.sum() == many
    firsts = np.cumsum(np.append(0, levels))
    children = np.array([bin(m).count("1") for m in mask])
    child = levels[0] + np.cumsum(children) - children
    for node in range(many):
        level = int(np.searchsorted(firsts, node, side="right")) - 1
        for k, q in enumerate([q for q in range(4) if mask[node] >> q & 1]):
            below = point[child[node] + k]
            assert rank[below] <= rank[point[node]]
            shift = height - level
            assert row[below] >> shift == row[point[node]] >> shift and col[below] >> shift == col[point[node]] >> shift
            assert (row[below] >> (shift - 1) & 1, col[below] >> (shift - 1) & 1) == (q >> 1, q & 1)


@pytest.mark.parametrize("at_once", [1, 2, 64])
def test_best_first_search_leaves_most_ranges_closed(at_once):
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 40, 500)
    tokens = rng.zipf(1.3, counts.sum()).astype(np.uint64) % np.uint64(5000)
    shard = k2_treap._shard(list(range(500)), tokens, counts, 500, int(counts.sum()))
    treap = k2_treap.Treap(shard, 500, int(counts.sum()))
    ends = np.cumsum(counts)
    m = k2_treap.length_norms(counts, 500, int(counts.sum()))
    items, terms = np.repeat(np.arange(20), 6), rng.zipf(1.3, 120).astype(np.uint64) % np.uint64(5000)
    keep = np.unique(np.stack([items.astype(np.uint64), terms]), axis=1, return_index=True)[1]
    items, terms = items[keep], terms[keep]
    weights = 1 + (terms.astype(np.int64) * 7919) % 5000
    ties = rng.permutation(500)
    item, col, score = k2_treap.search_shard(treap, items, terms, weights, ties, 10, at_once)
    for i in range(20):
        plain = []
        for d in range(500):
            own = tokens[ends[d] - counts[d] : ends[d]]
            s = sum(int(w) * int(k2_treap.impacts(np.int64((own == t).sum()), m[d])) for t, w in zip(terms[items == i], weights[items == i], strict=True))
            plain.append((-s, int(ties[d]), d))
        want = [(d, -s) for s, _, d in sorted(plain)[:10] if s]
        got = sorted(zip(score[item == i].tolist(), col[item == i].tolist(), strict=True), key=lambda p: (-p[0], ties[p[1]]))
        assert [(d, s) for s, d in got] == want
