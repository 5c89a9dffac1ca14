"""Header pairs compared block by block, against the plain subsequence."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from askgauge.functions import similarity as S
from askgauge.operators import dedup as D


def _texts(count, letters, longest, seed):
    draw = random.Random(seed)
    found = {""}
    while len(found) < count:
        base = "".join(draw.choices(letters, k=draw.randint(1, longest)))
        found |= {base, base[1:], base + draw.choice(letters), base.replace(letters[0], "|", 1)}
    return sorted(found, key=lambda t: (len(t), t))


@pytest.mark.parametrize("letters, longest", [("ab|é", 9), ("thernd|oi", 63), ("abc漢字😀|", 70), ("abcd|", 200)])
def test_subsequences_match_the_plain_count(letters, longest):
    texts = _texts(60, letters, longest, longest)
    codes, sizes = S.text_codes(texts)
    assert sizes.tolist() == [len(t) for t in texts]
    held, masks = S.place_masks(codes)
    numbers = S.letter_numbers(S.text_codes([*texts, "zz" + letters])[0], held)
    row, column = (c.ravel() for c in np.indices((len(texts), len(texts))))
    plain = [S.common_subsequence(texts[i], texts[j]) for i, j in zip(row, column)]
    assert S.subsequences_of_pairs(masks, numbers, row, column).tolist() == plain
    each = np.concatenate([S.subsequences_of_one(masks, n[:size].tolist()) for n, size in zip(numbers, sizes)])
    assert each.tolist() == plain


@pytest.mark.parametrize("threshold", [70.0, 80.0, 90.0, 100.0])
def test_blocks_find_all_pairs(spark, monkeypatch, threshold):
    for name, value in {"BLOCK_LEAST": 40, "BLOCK_LETTERS": 2000, "TILE": 16, "PAIRS_COUNTED": 7, "PAIRS_SENT": 5}.items():
        monkeypatch.setattr(D, name, value)
    texts = _texts(220, "then|", 30, 7) + _texts(40, "aé|", 100, 8)[1:]
    draw = random.Random(5)
    ids = draw.sample(range(-500, 500), len(texts))
    nodes = spark.createDataFrame(list(zip(ids, texts)), "node long, text string")
    alike = {}
    for (a, s), (b, t) in itertools.combinations(zip(ids, texts), 2):
        ratio = 200.0 * S.common_subsequence(s, t) / (len(s) + len(t))
        if s != t and ratio >= threshold:
            alike[min(a, b), max(a, b)] = ratio
    same = {(min(a, b), max(a, b)): 100.0 for (a, s), (b, t) in itertools.combinations(zip(ids, texts), 2) if s == t and s}
    got = D.similar_pairs(nodes, threshold).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]): r["ratio"] for r in got} == alike | same


def test_a_repeated_node_is_no_pair_with_itself(spark):
    nodes = spark.createDataFrame([(1, "a|b|c|d|e"), (1, "a|b|c|d|e"), (2, "a|b|c|d|f")], "node long, text string")
    assert {(r["a"], r["b"]) for r in D.similar_pairs(nodes, 80.0).collect()} == {(1, 2)}


def test_pairs_leave_a_task_in_small_batches():
    # 700 texts that are all alike make 244,650 pairs under shared keys; a batch held them all before.
    texts = sorted((f"the|and|of|{i:03d}|tion|in|er|here|there" for i in range(700)), key=lambda t: (len(t), t))
    codes, _ = S.text_codes(texts)
    marks = S.pair_marks(codes, D.MARK_WORDS).tobytes()
    row = {"i": [0], "j": [0], "side": [0], "nodes": [list(range(700))], "texts": [texts], "marks": [marks]}
    found = list(D._block_pairs(80.0)(iter([pa.RecordBatch.from_pydict(row)])))
    assert sum(b.num_rows for b in found) == 700 * 699 // 2
    assert max(b.num_rows for b in found) <= D.PAIRS_SENT + D.STRIP * D.TILE
    assert len(found) > 1


@pytest.mark.parametrize("letters, longest", [("ab|é", 9), ("thernd|oi", 63), ("abc漢字😀|", 70), ("abcd|", 200)])
def test_marks_and_prefixes_only_leave_out_pairs_that_are_too_unlike(letters, longest):
    texts = _texts(80, letters, longest, longest + 1)
    codes, sizes = S.text_codes(texts)
    held, masks = S.place_masks(codes)
    tables = S.pair_tables(masks, S.letter_numbers(codes, held))
    row, column = (c.ravel() for c in np.indices((len(texts), len(texts))))
    plain = np.array([S.common_subsequence(texts[i], texts[j]) for i, j in zip(row, column)])
    keys, counts = S.letter_counts(codes)
    assert counts.sum() == sizes.sum() and len(keys) == sum(max(t.count(x) for t in texts) for x in set("".join(texts)))
    for words in (1, 3):
        marks = S.letter_marks(codes, keys[: 64 * words], words)
        assert (np.bitwise_count(marks[row] ^ marks[column]).sum(axis=1) <= sizes[row] + sizes[column] - 2 * plain).all()
    for threshold in (60.0, 80.0, 95.0):
        need = D._needed(sizes[row], sizes[column], threshold)
        left, common = S.long_subsequences(tables, row, column, sizes[row], sizes[row] - need, sizes[column] - need)
        assert (common == plain[left]).all() and set(np.flatnonzero(plain >= need)) <= set(left)


def test_unlike_texts_are_given_up_early(monkeypatch):
    # Texts of one language share so many letter pairs that two thirds of all pairs were counted to their last letter.
    draw = random.Random(3)
    pieces = ["|", *("".join(draw.choices("etaoinsrhldcu", k=3)) for _ in range(40))]
    texts = ["".join(draw.choices(pieces, k=40))[:60] for _ in range(600)]
    codes, sizes = S.text_codes(texts)
    keys, _ = S.letter_counts(codes)
    one = {"codes": codes, "size": sizes, "marks": S.letter_marks(codes, keys[: 64 * D.MARK_WORDS], D.MARK_WORDS), "place": np.arange(600)}
    steps = []
    plain = S._take_letter
    monkeypatch.setattr(S, "_take_letter", lambda state, hit, moved: (steps.append(state.shape[1]), plain(state, hit, moved))[1])
    assert not [p for p in D._tile_pairs(one, one, True, 80.0) if len(p[0])]
    assert sum(steps) < 0.25 * 60 * 600 * 599 / 2


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_by_stretches_match_a_plain_walk(spark, monkeypatch, seed):
    draw = random.Random(seed)
    texts = _texts(150, "then|", 24, seed)
    texts += [t + "|id" for t in texts[40:]]
    nodes = [(n, t) for n, t in zip(draw.sample(range(-500, 500), len(texts)), texts)]
    # A node may come twice, or with two texts.
    nodes += [nodes[3], (nodes[5][0], "other|header"), (nodes[7][0], nodes[90][1])]
    by_node = {}
    for n, t in nodes:
        by_node.setdefault(n, []).append(t)
    near = lambda a, b: any(s == t or 200.0 * S.common_subsequence(s, t) / (len(s) + len(t)) >= 80.0 for s in by_node[a] for t in by_node[b])
    led = {}
    for a in sorted(by_node):
        if a not in led:
            led |= {a: a} | {b: a for b in by_node if b > a and b not in led and near(a, b)}
    df = spark.createDataFrame(nodes, "node long, text string")
    compared = []
    plain = D._met
    monkeypatch.setattr(D, "_met", lambda blocks, pairs, threshold: (compared.append(blocks.selectExpr("sum(size(nodes))").head()[0]), plain(blocks, pairs, threshold))[1])
    for whole in (0, 1_000):
        compared.clear()
        got = [tuple(r) for r in D.lead_texts(df, 80.0, whole, 40, 70).collect()]
        assert sorted(got) == sorted(led.items())
        # By stretches, no comparison holds all texts; claimed ones have dropped out.
        assert len(compared) >= 5 and max(compared) < len(texts) if whole == 0 else compared == [len(set(nodes))]


def test_blocks_stay_few_where_a_session_raises_ranges(spark, monkeypatch):
    # Each block is copied once for each block it meets; 211 ranges made 22,000 meetings of 10,000 headers.
    kind = type(spark.range(0))
    plain = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, parts, *by: plain(self, max(40, parts), *by))
    texts = _texts(200, "then|", 30, 11)
    blocks, keys = D._blocks_of(spark.createDataFrame(list(enumerate(texts)), "node long, text string"))
    assert len(keys) <= 64 * D.MARK_WORDS and blocks.count() == 1
    assert sorted(blocks.head()["texts"]) == sorted(texts)
