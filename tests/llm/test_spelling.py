import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from askgauge.llm import spelling
from askgauge.llm.tables import read_table
from tests.llm import brute, nasty


def plain_counts(rows, every):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts.pop("", None)
    return counts


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_groups(counts, min_length=5, least=3, ratio=2):
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def noisy_words(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aeintésß×") for _ in range(rng.randint(4, 9))) for _ in range(25)]
    out = []
    for _ in range(n):
        w = rng.choice(base)
        if rng.random() < 0.4:
            at = rng.randrange(len(w))
            w = w[:at] + rng.choice(["", "x", w[at] * 2, "Ä"]) + w[at + 1 :]
        out.append(w)
    return " ".join(out)


@pytest.mark.parametrize("every", [0, 3])
def test_words_are_counted_as_by_hand(spark, every):
    docs = nasty.documents(spark)
    got = {r["word"]: r["n"] for r in spelling.count_words(docs, every).collect()}
    assert got == plain_counts(nasty.pairs(), every)
    assert spelling.count_words(nasty.nothing(spark), every).count() == 0


def test_partial_counts_add_up(spark, monkeypatch):
    rows = [(i % 7, noisy_words(i, 40)) for i in range(60)]
    got = {r["word"]: r["n"] for r in spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == plain_counts(rows, 5)


def test_groups_match_brute_force(spark):
    rows = [(i, noisy_words(i, 60)) for i in range(40)] + nasty.pairs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_groups(plain_counts(rows, 7))
    assert any(f and r != f for _, f, r, *_ in want) and any(f is None for _, f, *_ in want)
    for symbols in (1, 3, 8):
        got = spelling.group_spellings(spelling.count_words(docs, 7), symbols=symbols)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        rows_got = [tuple(r) for r in got.collect()]
        assert len(rows_got) == len(set(rows_got)) and set(rows_got) == want


def test_long_chains_ties_and_no_words(spark):
    # Each word is near the next and has half its n, so forms chain; the last two tie.
    chain = [("a" * i, 3 * 2 ** (i - 5)) for i in range(5, 30)] + [("zebra", 5), ("zebrb", 10), ("zebrc", 10), ("ü" * 3000, 4), ("ü" * 2999 + "é", 9), (None, 9)]
    counts = spark.createDataFrame(chain, "word string, n long")
    got = {r["word"]: r for r in spelling.group_spellings(counts).collect()}
    assert got["aaaaa"]["root"] == "a" * 29 and got["zebra"]["form"] == "zebrb" and got["zebrb"]["form"] is None
    assert got["ü" * 3000]["form"] == "ü" * 2999 + "é" and len(got) == len(chain) - 1
    assert spelling.group_spellings(counts.where("n < 0")).count() == 0


def test_neighbour_hashes_are_those_of_the_neighbours():
    rng = random.Random(3)
    letters = "abcdéü"

    def hashed(word):
        codes = np.array([[ord(c) for c in word]], dtype=np.uint32)
        return spelling.neighbour_hashes(codes, 4)

    for _ in range(50):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
        _, near = hashed(word)
        at, c = rng.randrange(len(word)), rng.choice(letters)
        for other in (word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :], word[:at] + c + word[at:], word + c):
            assert hashed(other)[0][0] in near[0]


def test_query_over_the_whole_table(spark, folder):
    docs = [tuple(r) for r in read_table(spark, folder, "documents").select("doc_id", "text").collect()]
    got = [tuple(r) for r in spelling.op12_spelling_variants(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_groups(plain_counts(docs, 97))


def test_joins_of_words_are_never_broadcast(spark):
    # Spark sized the neighbours by their words' compressed files and broadcast them, 18 million rows at 0.5 GB.
    counts = spark.createDataFrame([("abcde", 9), ("abcdef", 3), ("vwxyz", 4)], "word string, n long")
    found, grouped = spelling.near_words(counts), spelling.group_spellings(counts)
    for df in (found, grouped):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {tuple(r) for r in found.collect()} == {("abcde", "abcdef", 3), ("abcdef", "abcde", 9)}
    assert {r["word"]: r["root"] for r in grouped.collect()} == {"abcde": "abcde", "abcdef": "abcde", "vwxyz": "vwxyz"}
