"""Near fingerprints against brute force, among them pairs without equal blocks."""

import numpy as np

from askgauge.llm import simhash


def test_pairs_without_equal_blocks_are_found(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 30)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    bits = np.unpackbits(base, axis=1)
    # One unlike bit every seven: no run of 12 bits stays equal, 37 bits differ.
    bits[:, ::7] ^= 1
    some = np.unpackbits(base, axis=1)
    for r in some:
        r[rng.choice(256, 38, replace=False)] ^= 1
    every = np.concatenate([base, np.packbits(bits, axis=1), np.packbits(some, axis=1), base[:5]])
    hexed = [r.tobytes().hex() for r in every]
    df = spark.createDataFrame([(h,) for h in hexed], "fingerprint string")
    got = simhash.near_prints(df, df.limit(50)).collect()
    asked = {r["fingerprint"] for r in df.limit(50).collect()}
    apart = lambda a, b: int(np.bitwise_count(a ^ b).sum())
    want = {(h, o): apart(a, b) for h, a in zip(hexed, every) for o, b in zip(hexed, every) if h in asked and 0 < apart(a, b) <= 38}
    assert len(got) == len(want) and {(r["query"], r["fingerprint"]): r["distance"] for r in got} == want
    assert all((hexed[i], hexed[40 + i]) in want for i in range(40) if hexed[i] in asked)


def test_no_queries_and_no_prints(spark):
    none = spark.createDataFrame([], "fingerprint string")
    one = spark.createDataFrame([("0" * 64,)], "fingerprint string")
    assert simhash.near_prints(one, none).count() == 0 and simhash.near_prints(none, one).count() == 0
