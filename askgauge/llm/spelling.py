"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols. Two words one edit apart are, once reduced, equal or one edit apart too.
So the whole one-edit neighbourhood of every reduced word is generated (deletions, replacements, insertions),
as 64-bit hashes that follow from the word's own hash without spelling the neighbour out; neighbours that no
reduced word has are dropped where they arise, the others are joined with the reduced vocabulary, and the pairs
are verified on the words as written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_words import SEED, give_back, mix
from .tables import bit_filter, read_table, stored, text_or_empty

#: Runs of Latin letters; A-Z are lower-cased before, nothing else is.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Words of a task that are counted before they are handed on.
HELD = 200_000
#: Neighbours computed at a time.
BLOCK = 400_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _counts(damage_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for row in range(batch.num_rows):
                # Bytes know no case beyond ASCII; a text's words are counted before any is looked at.
                own = Counter(RUN.findall((texts[row].as_py() or "").encode().lower().decode()))
                if damage_every:
                    start = zlib.crc32(f"{ids[row].as_py() or ''}:".encode())
                    for word in [w for w in own if zlib.crc32(w.encode(), start) % damage_every == 0]:
                        at = zlib.crc32(word.encode(), start) % len(word)
                        seen[word[:at] + word[at + 1 :]] += own.pop(word)
                seen.update(own)
                if len(seen) >= HELD:
                    yield flush()
        yield flush()
        give_back()

    return run


def count_words(docs: DataFrame, damage_every: int = 0, key: str = "doc_id") -> DataFrame:
    """(word, n) for the words of all texts: runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.

    With ``damage_every``, a word of a text loses one code point where the crc32 of key, colon and word is
    divisible by that number: known misspellings for tests. A null key is written as nothing; null and empty
    texts have no words; repeated rows count again; other columns take no part. Tasks hand on partial counts.
    """
    rows = docs.select(F.col(key).cast("string").alias("id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_counts(damage_every), "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def reduce_letters(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol of each code point."""
    return (mix(codes.astype(np.uint64) + SEED) >> np.uint64(32)) % np.uint64(symbols)


def _finish(total: np.ndarray, length: int) -> np.ndarray:
    return mix(total ^ mix(np.array([length], dtype=np.uint64) + SEED))


def neighbour_hashes(codes: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length (a row of code points each): the hash of the reduced word, and those of its neighbours.

    A word's hash sums its symbols' values times powers of an odd base, so that what follows an edit is shifted
    by one multiplication. Neighbours include the word itself and may repeat.
    """
    many, length = codes.shape
    values = mix(np.arange(1, symbols + 1, dtype=np.uint64))
    powers = np.array([pow(_BASE, i, 1 << 64) for i in range(length + 1)], dtype=np.uint64)
    own = values[reduce_letters(codes, symbols).astype(np.int64)]
    parts = own * powers[:length]
    before = np.zeros((many, length + 1), dtype=np.uint64)
    np.cumsum(parts, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    after = whole - before
    deleted = before[:, :-1] + after[:, 1:] * np.uint64(_BACK)
    replaced = (whole - parts)[:, :, None] + values * powers[:length, None]
    inserted = (before + after * np.uint64(_BASE))[:, :, None] + values * powers[:, None]
    same = _finish(whole, length)
    near = [same, _finish(deleted, length - 1), _finish(replaced.reshape(many, -1), length), _finish(inserted.reshape(many, -1), length + 1)]
    return same[:, 0], np.concatenate(near, axis=1)


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(places, reduced hashes, neighbour hashes) for the words, a block of one length at a time."""
    places: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        places.setdefault(len(word), []).append(i)
    for length, own in places.items():
        step = max(1, BLOCK // (2 * (symbols + 1) * length))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            codes = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le"), dtype="<u4").reshape(len(some), length)
            yield some, *neighbour_hashes(codes, symbols)


def _reduced(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, dtype=np.uint64)
            for some, same, _ in _by_length(batch.column("word").to_pylist(), symbols):
                keys[some] = same
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("word"), batch.column("n")], names=["reduced", "word", "n"])

    return run


def _neighbours(sent, bits_log2: int, symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = np.frombuffer(sent.value, dtype=np.uint8), np.uint64((1 << bits_log2) - 1)
        for batch in batches:
            for some, _, near in _by_length(batch.column("word").to_pylist(), symbols):
                near = np.sort(near, axis=1)
                live = np.ones(near.shape, dtype=bool)
                live[:, 1:] = near[:, 1:] != near[:, :-1]
                at = near & mask
                live &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                row, column = np.nonzero(live)
                take = pa.array(np.array(some)[row])
                yield pa.RecordBatch.from_arrays([pa.array(near[row, column].view(np.int64)), batch.column("word").take(take)], names=["reduced", "word"])
        give_back()

    return run


def near_words(words: DataFrame, symbols: int = 8) -> DataFrame:
    """All ordered pairs (word, near, n of near) of rows of ``words`` (word, n) that are exactly one edit apart.

    Words are distinct. What a word meets is bounded by its own neighbourhood, not by how often words occur.
    The bitmap of reduced words is sized by their count (16 bits each, 128 MB at most): beyond that more
    neighbours reach the join, and the result stays the same.
    """
    reduced = stored(words.mapInArrow(_reduced(symbols), "reduced long, word string, n long"), "reduced-words")
    bits_log2 = min(30, max(20, (16 * reduced.count()).bit_length()))
    sent = words.sparkSession.sparkContext.broadcast(bit_filter(reduced, "reduced", bits_log2))
    asked = reduced.select("word").mapInArrow(_neighbours(sent, bits_log2, symbols), "reduced long, word string")
    # Spark sizes neighbours by the words they come from, many times too low: without the hint it broadcasts them.
    found = asked.join(reduced.select("reduced", F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "reduced")
    return found.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def follow(links: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms are followed until a word without one.

    Chains have no rings. Every round doubles the steps taken, so the rounds grow with the logarithm of the
    longest chain. Joins are sorted, never broadcast: links may be as many as words, and their files are small only because
    they are compressed.
    """
    reached = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = reached.join(further.hint("merge"), "root", "left")
        step = stored(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def group_spellings(counts: DataFrame, min_length: int = 5, least: int = 3, ratio: int = 2, symbols: int = 8) -> DataFrame:
    """Per word of ``counts`` (word, n) with ``min_length`` code points and ``least`` occurrences: word, n, n_near,
    form, form_n and root.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of
    largest n (ties: smallest in code-point order) if that n is at least ``ratio`` times (more than once) the word's own; the root is
    the last word reached by forms, the word itself without one. Rows with a null word are left out.
    """
    words = stored(counts.where((F.char_length("word") >= min_length) & (F.col("n") >= least)).select("word", "n"), "vocabulary")
    best = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    joined = words.join(best.hint("merge"), "word", "left").withColumn("larger", -F.col("best.minus") >= ratio * F.col("n"))
    forms = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("larger"), F.col("best.near")).alias("form"), F.when(F.col("larger"), -F.col("best.minus")).alias("form_n"),
        ),
        "forms",
    )
    roots = follow(forms.where("form IS NOT NULL").select("word", "form"))
    return forms.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(count_words(read_table(spark, sf_dir, "documents"), damage_every=97))
