import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from askgauge.llm import contamination, jaccard_join, lang_kernel, mixing, packed_ids, simhash, suffix_dedup, toxic_kernel
from askgauge.session import scratch_path
from tests.llm import brute, nasty


def counted(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def test_jaccard_matches_brute_force(spark):
    got = jaccard_join.jaccard_components(nasty.documents(spark)).collect()
    assert counted(got) == counted(brute.jaccard_components(nasty.pairs()))
    assert jaccard_join.jaccard_components(nasty.nothing(spark)).count() == 0


def test_jaccard_with_small_trees_and_splits(spark, monkeypatch):
    """A chain of near copies in one big group, split over several tasks."""
    words = nasty.prose(4, 130).split()
    rows = [(i, " ".join([*words[: i + 1], f"w{i}", *words[i + 2 :]])) for i in range(90)] + [(200 + i, nasty.prose(50 + i, 60)) for i in range(20)]
    monkeypatch.setattr(jaccard_join, "SPLIT", 24)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert counted(got) == counted(brute.jaccard_components(rows))


def test_a_long_chain_of_near_copies_takes_few_jobs(spark):
    """Links are contracted task by task; joins round by round left the driver with the plans and tasks of 179 jobs."""
    words = nasty.prose(4, 130).split()
    rows = [(i, " ".join([*words[: i + 1], f"w{i}", *words[i + 2 :]])) for i in range(90)]
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["component_id"] for r in got} == {r[2] for r in brute.jaccard_components(rows)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 80


def test_tree_keeps_every_pair_within_the_bound():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (300, jaccard_join.GROUPS)).astype(np.int32)
    points[100:200] = points[:100] + rng.integers(0, 2, (100, jaccard_join.GROUPS))
    sizes = points.sum(axis=1)
    tree = jaccard_join.CountTree(sizes, points)
    for x in range(0, 300, 7):
        near = set(tree.order[tree.near(int(sizes[x]), points[x], 80)].tolist())
        want = {y for y in range(300) if 100 * min(sizes[x], sizes[y]) >= 80 * max(sizes[x], sizes[y]) and np.minimum(points[x], points[y]).sum() >= math.ceil(80 * (sizes[x] + sizes[y]) / 180)}
        assert near == want


def test_one_of_each_component_stays(spark):
    kept = jaccard_join.keep_one_of_each(nasty.documents(spark))
    assert kept.columns == nasty.documents(spark).columns
    rows = Counter(r["doc_id"] for r in kept.collect())
    parts = [(k, n, c) for k, n, c in brute.jaccard_components(nasty.pairs())]
    want = Counter({c for _, n, c in parts if n}) + Counter(k for k, n, _ in parts if not n)
    # Two rows with one key that are not linked both stay.
    assert rows == want + Counter([12]) and rows[1] == 1 and rows[3] == 0 and rows[None] == 0


ITEMS = [(1, nasty.prose(9, 30)), (2, "One, TWO"), (3, None), (4, ""), (5, nasty.prose(9, 12)), (5, "x"), (None, "12"), (10, nasty.prose(2, 10))]


@pytest.mark.parametrize("pass_words", [4_000_000, 30])
def test_contamination_matches_brute_force(spark, pass_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contamination.find_contamination(nasty.documents(spark), items, pass_words=pass_words)
    rows = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect())
    assert rows == Counter((k, n, h, tuple(i)) for k, n, h, i in brute.contamination(nasty.pairs(), ITEMS))
    clean = contamination.drop_contaminated(nasty.documents(spark), items, pass_words=pass_words)
    want = Counter(k for k, _, h, _ in brute.contamination(nasty.pairs(), ITEMS) if not h)
    assert Counter(r["doc_id"] for r in clean.collect()) == want and clean.columns == nasty.documents(spark).columns


def test_contamination_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination.find_contamination(nasty.documents(spark), items).where("contaminated").count() == 0
    assert contamination.find_contamination(nasty.nothing(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_longest_matches(spark):
    item = nasty.prose(9, 30)
    docs = [(1, "a b " + " ".join(item.split()[3:20]) + " c"), (2, " ".join(item.split()[5:18]))]
    got = contamination.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    best = {r["offset"]: (r["length"], r["doc_id"], r["position"]) for r in got}
    assert best[3] == (17, 1, 2) and best[5] == (15, 1, 4) and max(best) == 10


def test_repeats_match_brute_force(spark):
    got = suffix_dedup.remove_repeats(nasty.documents(spark)).collect()
    want = Counter((k, n, r, s, hashlib.sha256(kept).hexdigest()) for k, n, r, s, kept in brute.remove_repeats(nasty.pairs()))
    assert counted(got) == want
    assert suffix_dedup.remove_repeats(nasty.nothing(spark)).count() == 0


def test_repeats_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 40)
    shared = nasty.prose(60, 40)
    rows = [(i, nasty.prose(i, 20) + shared[i : 150 + i] + nasty.prose(100 + i, 10) + "ab" * (i % 5) * 20) for i in range(30)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert counted(got) == Counter((k, n, r, s, hashlib.sha256(kept).hexdigest()) for k, n, r, s, kept in brute.remove_repeats(rows))


def test_no_anchor_is_gathered_beyond_the_bound(spark):
    """A passage of many documents between unlike neighbours, and a long stretch of one letter."""
    shared = nasty.prose(60, 12)
    rows = [(i % 35, nasty.prose(i, 12) + shared + nasty.prose(100 + i, 12) + "-" * (i % 3) * 120) for i in range(40)] + [(None, "x" + shared), (50, "a" * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    runs, windows = suffix_dedup.suffix_runs(docs, heavy=200)
    sizes = runs.where("length(context) > 0").groupBy("lead", "next").agg(F.sum(F.col("end") - F.col("start") - 49).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 200 and windows.count() > 0
    want = Counter((k, n, r, s, hashlib.sha256(kept).hexdigest()) for k, n, r, s, kept in brute.remove_repeats(rows))
    for heavy in (0, 200):
        assert counted(suffix_dedup.remove_repeats(docs, heavy=heavy).collect()) == want


def test_packed_hashes_unpack():
    """Every hash comes back with its windows; one of two documents or blocks more than once."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    held = []
    for _ in range(3):
        h = np.unique(rng.choice(pool, 150))
        held.append((h, rng.integers(1, 900, len(h)), rng.random(len(h)) < 0.2))
    want, several = Counter(), Counter()
    for h, windows, shared in held:
        for x, w, s in zip(h.tolist(), windows.tolist(), shared.tolist(), strict=True):
            key = (x >> 40) % 7 << 40 | x & (1 << 40) - 1
            want[key] += w
            several[key] += 1 + s
    got, entries = Counter(), Counter()
    packed = suffix_dedup._packed(held, 7)
    assert packed.column(0).to_pylist() == list(range(7))
    for group, raw in zip(packed.column(0).to_pylist(), packed.column(1).to_pylist(), strict=True):
        keys, windows = suffix_dedup._unpacked(group, raw)
        entries.update(keys.tolist())
        for x, w in zip(keys.tolist(), windows.tolist(), strict=True):
            got[x] += w
    assert got == want
    assert all(entries[x] == max(-(-w // 255), min(several[x], 2)) for x, w in want.items())
    nothing = np.zeros(0, dtype=np.uint64)
    assert suffix_dedup._packed([(nothing, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))], 7).num_rows == 0


def test_token_files_round_trip(spark):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = scratch_path(spark, "ids")
    packed_ids.write_ids(nasty.documents(spark), path, packed_ids.default_tokenizer())
    packed = packed_ids.read_packed(spark, path)
    tokenizer = Tokenizer.from_file(packed_ids.default_tokenizer())
    order = sorted(nasty.pairs(), key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""))
    want, start = [], 0
    for key, text in order:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert counted(packed_ids.token_digests(packed).collect()) == counted(want)
    assert sum(len(r["ids"]) for r in packed_ids.token_ids(packed).collect()) == start
    empty = scratch_path(spark, "ids")
    packed_ids.write_ids(nasty.nothing(spark), empty, packed_ids.default_tokenizer())
    assert packed_ids.token_digests(packed_ids.read_packed(spark, empty)).count() == 0


def test_mix_reaches_its_targets(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        own = by.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        own[0] += r["taken"]
        own[3] = max(own[3], r["size"])
        assert 0 <= r["copies"] <= 2
    assert abs(sum(v[1] for v in by.values()) - 1.5 * total) < 1e-6 * total
    for taken, target, size, largest in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= largest / 2 + 1
    assert sorted(rows) == sorted(mixing.mix_sources(docs.repartition(5)).join(docs.select("doc_id", "source"), "doc_id").collect())


def test_mix_of_nasty_rows(spark):
    docs = nasty.documents(spark)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_sources(nasty.nothing(spark)).count() == 0 and mixing.mixed_rows(nasty.nothing(spark)).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix_sources(nulls).collect()] == [(0, 0.0, 0)] * 2


def test_water_fill_against_a_loop(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), float(w), float(c)) for i, (w, c) in enumerate(zip(rng.integers(1, 5, 30), rng.integers(0, 200, 30), strict=True))]
    for total in (10.0, 1500.0, 1e6):
        got = {r["i"]: r["target"] for r in mixing.water_fill(spark.createDataFrame(rows, "i long, weight double, cap double"), total).collect()}
        shut: set = set()
        while True:
            left = total - sum(c for i, _, c in rows if i in shut)
            weight = sum(w for i, w, _ in rows if i not in shut)
            more = {i for i, w, c in rows if i not in shut and weight and left * w / weight > c}
            if not more:
                break
            shut |= more
        for i, w, c in rows:
            assert got[i] == pytest.approx(c if i in shut else left * w / weight)


def test_fingerprints_of_edits(spark):
    pairs = nasty.pairs()
    got = simhash.compare_with_edits(nasty.documents(spark)).collect()
    order = sorted(pairs, key=lambda p: (p[0] is None, -(p[0] or 0), p[1] or ""))
    want = Counter()
    for (key, text), (_, other) in zip(order, order[1:] + order[:1], strict=True):
        text, other = text or "", other or ""
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        want[(key, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {}
    for r in simhash.fingerprint_documents(nasty.documents(spark)).join(nasty.documents(spark).select("doc_id", "text"), "doc_id").collect():
        prints.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert len(prints[""]) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert simhash.compare_with_edits(nasty.nothing(spark)).count() == 0
    one = simhash.compare_with_edits(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    rows = [base]
    for flips in (1, 3, 7, 8, 12):
        bits = np.unpackbits(base, axis=1)
        for r in bits:
            r[rng.choice(256, flips, replace=False)] ^= 1
        rows.append(np.packbits(bits, axis=1))
    every = np.concatenate(rows)
    df = spark.createDataFrame([(r.tobytes().hex(),) for r in every], "fingerprint string")
    got = {(r["query"], r["fingerprint"]): r["distance"] for r in simhash.within_radius(df, df.limit(50), 7).collect()}
    asked = {r["fingerprint"] for r in df.limit(50).collect()}
    want = {}
    for a in every:
        for b in every:
            d = int(np.unpackbits(a ^ b).sum())
            if d <= 7 and a.tobytes().hex() in asked:
                want[(a.tobytes().hex(), b.tobytes().hex())] = d
    assert got == want


def test_near_copies_are_found(spark):
    """One word in 50 changed: beyond 7 bits, found nearly always; exactly the pairs with two equal blocks."""
    rows = []
    for i in range(60):
        words = nasty.prose(i, 200).split()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(w if j % 50 else f"new{j}" for j, w in enumerate(words)))]
    prints = {r[0]: r[1] for r in simhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    df = spark.createDataFrame([(p,) for p in prints.values()], "fingerprint string")
    got = {(r["query"], r["fingerprint"]): r["distance"] for r in simhash.near_prints(df, df).collect()}
    value = {p: np.frombuffer(bytes.fromhex(p), dtype=">u8").astype(np.uint64)[None] for p in set(prints.values())}
    keys = {p: simhash.table_keys(v)[0] for p, v in value.items()}
    want = {}
    for p, x in value.items():
        for o, y in value.items():
            d = int(np.bitwise_count(x ^ y).sum())
            if 0 < d <= simhash.RADIUS and (keys[p] == keys[o]).any():
                want[(p, o)] = d
    assert got == want
    own = [(prints[2 * i], prints[2 * i + 1]) for i in range(60)]
    assert sum(p in got for p in own) >= 55 and sum(got.get(p, 0) > 7 for p in own) >= 50


def test_language_on_held_out_texts(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet")
    out = lang_kernel.op8_language(spark, folder.replace("sf0.001", "sf0.01")).join(docs.select("doc_id", "lang"), "doc_id")
    row = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert row["n"] > 150 and row["a"] > 0.97


def test_language_of_nasty_rows(spark):
    docs = nasty.documents(spark)
    rows = lang_kernel.predict_language(docs, lang_kernel.fit_language(docs)).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert lang_kernel.fit_language(nasty.nothing(spark)) is None
    assert lang_kernel.predict_language(docs, None).where("lang_pred <> 'und'").count() == 0
    assert lang_kernel.predict_language(nasty.nothing(spark), lang_kernel.fit_language(docs)).count() == 0


@pytest.fixture(scope="module")
def toxic_model(spark):
    big = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{big}/documents.parquet")
    return toxic_kernel.fit_toxicity(docs, spark.read.parquet(f"{big}/labels.parquet"), ~toxic_kernel.held_out("id", 3, 1)), docs


def test_toxicity_on_held_out_texts(spark, toxic_model):
    model, docs = toxic_model
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxic_kernel.score_toxicity(docs.where(toxic_kernel.held_out("doc_id", 3, 1)).join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").collect()
    hit = sum(r["score"] >= 0.7 and r["toxic"] == 1 for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.8
    assert sum(r["score"] >= 0.7 and r["toxic"] == 0 for r in rows) / sum(r["toxic"] == 0 for r in rows) < 0.01


def test_disguised_insults_are_found(spark, toxic_model):
    model, docs = toxic_model
    clean = "The and attion to thanedble the, anea. Eriner thanea of the ther and this onread to it."
    texts = ["idiot", "i.d.i.o.t", "1d1ot", "i d i o t", "IDIOT!", "idxiot", "wortthless", "d-i-s-g-u-s-t-i-n-g", "path3tic", "mor*on"]
    data = [(i, f"{clean} {t} {clean}") for i, t in enumerate(texts)] + [(100, clean), (101, ""), (102, None)]
    got = {r["doc_id"]: r["score"] for r in toxic_kernel.score_toxicity(spark.createDataFrame(data, "doc_id long, text string"), model).collect()}
    assert got[100] < 0.3 and got[101] == got[102] == 0
    assert sum(got[i] >= 0.7 for i in range(len(texts))) >= 8, got


def test_toxicity_of_nasty_rows(spark, toxic_model):
    model, _ = toxic_model
    docs = nasty.documents(spark)
    assert toxic_kernel.score_toxicity(docs, model).where("score BETWEEN 0 AND 1").count() == docs.count()
    kept = toxic_kernel.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    empty = toxic_kernel.fit_toxicity(docs.drop("toxic"), labels)
    assert toxic_kernel.score_toxicity(docs, empty).where("score > 0").count() == 0
    assert toxic_kernel.score_toxicity(nasty.nothing(spark), model).count() == 0


def test_pipeline_stages(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        path = scratch_path(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.count() == sizes[3]
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
