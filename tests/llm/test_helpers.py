import random

import numpy as np
import pyarrow as pa
import pytest

from askgauge.llm import simhash, simple8b
from askgauge.llm.byte_words import ALNUM, NOT_BLANK, shingles, text_blocks, word_hashes
from askgauge.llm.graph import components, group_labels
from askgauge.llm.piece_tokens import PieceTokenizer
from askgauge.llm.suffix_array import search, suffix_array, with_stops
from tests.llm import brute


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 4000])
@pytest.mark.parametrize("top", [1, 2, 300, 50_257, 1 << 31, 1 << 59, (1 << 64) - 1])
def test_simple8b_round_trip(n, top):
    values = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    values[::7] = 0
    words, offsets = simple8b.encode(values)
    assert (simple8b.decode(words, offsets, n) == values).all()
    assert len(offsets) == -(-n // simple8b.BLOCK)
    if n > simple8b.BLOCK:
        # The second block alone, by its offset.
        some = simple8b.decode(words[offsets[1] :], offsets[1:] - offsets[1], n - simple8b.BLOCK)
        assert (some == values[simple8b.BLOCK :]).all()


def test_simple8b_is_small():
    assert len(simple8b.encode(np.zeros(1000, dtype=np.uint64))[0]) == 9
    assert len(simple8b.encode(np.full(1024, 4095, dtype=np.uint64))[0]) == 205


def test_words_match_patterns():
    texts = ["a B\tc", None, "", " x ", "É z 1.2", "w" * 5000 + " v"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    counts = []
    for _, _, buf, offsets in text_blocks(batch, "text", 4):
        counts += word_hashes(buf, offsets, NOT_BLANK)[1].tolist()
    assert counts == [3, 0, 0, 1, 2, 2]
    counts = []
    for _, _, buf, offsets in text_blocks(batch):
        counts += word_hashes(buf, offsets, ALNUM)[1].tolist()
    assert counts == [len(brute.bench_words(t)) for t in texts]


def test_equal_words_equal_hashes():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "AB", "abc", "x" * 8, "x" * 9, "é"]) for _ in range(30)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    (_, _, buf, offsets), = text_blocks(batch)
    hashes, counts = word_hashes(buf, offsets, NOT_BLANK)
    words = [brute.lower(w) for t in texts for w in t.split()]
    assert len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(words)) == len(set(hashes.tolist()))
    tokens, sizes = shingles(hashes, counts, 5)
    own = [tuple(brute.lower(t).split()[i : i + 5]) for t in texts for i in range(26)]
    assert sizes.tolist() == [26] * 20 and len(set(own)) == len(set(tokens.tolist()))


def test_suffix_array_orders_and_finds():
    rng = np.random.default_rng(2)
    words, counts = rng.integers(1, 4, 300).astype(np.uint64), np.array([100, 0, 150, 50])
    seq, starts = with_stops(words, counts)
    order = suffix_array(seq, len(seq))
    real = [i for i in order.tolist() if seq[i]]
    assert real == sorted(real, key=lambda i: seq[i:].tolist())
    queries = rng.integers(1, 4, (40, 5)).astype(np.uint64)
    lo, hi = search(seq, order, queries)
    for q, a, b in zip(queries, lo, hi, strict=True):
        assert sorted(order[a:b].tolist()) == [i for i in range(len(seq) - 4) if (seq[i : i + 5] == q).all()]


def test_pieces_give_the_librarys_ids():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizer = PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"), max_pieces=300)
    rng = random.Random(3)
    odd = ["", " ", "a ", "a  b", "\n\n b", "don't.\n\n'tis", "x <|endoftext|> y", "é×é÷ é", "a  b", "|'s|'re", "日本 語", "a\x1c b", "...\n...\n", None]
    texts = odd + ["".join(rng.choice(" \n'.,aést1é ß|$　\t") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    got = []
    for _, _, ids, counts in tokenizer.encode(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])):
        got += [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("per_task", [7, 40, 250_000])
def test_contracted_graph_has_the_same_components(spark, per_task):
    rng = random.Random(per_task)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = [tuple(r) for r in group_labels(spark.createDataFrame(edges, "a long, b long"), per_task).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in parent)
    named = spark.createDataFrame([(bytes([a % 256]), bytes([b % 256])) for a, b in edges[:20]], "a binary, b binary")
    assert sorted(map(tuple, group_labels(named, per_task).collect())) == sorted(map(tuple, components(named).collect()))
    assert group_labels(spark.createDataFrame([], "a long, b long"), per_task).count() == 0


def test_a_small_graph_is_whole_however_keys_are_dealt(spark, monkeypatch):
    """A path of few edges has one label also where repartition deals its keys to more tasks than asked for."""
    frame = type(spark.range(0))
    dealt = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: dealt(self, max(n, 7) if cols and isinstance(n, int) else n, *cols))
    got = group_labels(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(61)]


def test_lanes_count_as_single_bits_do():
    """Votes counted eight bits at a time against a plain sum, over rows of more than 255 terms and stretches that split rows."""
    rng = np.random.default_rng(3)
    sizes = np.array([1, 700, 0, 255, 256, 3])
    terms, row = rng.integers(0, 1 << 63, sizes.sum()).astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    votes = np.zeros((len(sizes), 256))
    simhash._count_votes(votes, terms, row, step=300)
    bits = 2 * simhash._term_bits(terms, 256).astype(int) - 1
    assert (votes == np.array([bits[row == r].sum(axis=0) for r in range(len(sizes))])).all()
