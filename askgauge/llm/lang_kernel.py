"""Language identification with a blended-spectrum presence kernel, Nyström landmarks and kernel ridge regression.

A text is read in stretches of letters. The kernel of two stretches counts the letter n-grams (one to
three letters, word breaks included) that both hold, each once, divided by the root of both counts. One
ridge regression per language is fitted on the kernel values with landmark stretches; a text's score is
the mean over all its stretches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_words import text_blocks
from .tables import read_table, text_or_empty
from .toxic_kernel import held_out

STRETCH = 1024
_CLASSES = 64


def _classes() -> np.ndarray:
    """Letter class of each UTF-8 byte: 0 between words, 63 for bytes that add nothing."""
    table = np.zeros(256, dtype=np.uint8)
    for i in range(26):
        table[[65 + i, 97 + i]] = i + 1
    for b in range(0x80, 0xC0):
        table[b] = 27 + (b & 0x1F)
    table[0xC0:0x100] = 60
    table[0xC3] = 63
    return table


_TABLE = _classes()


def gram_stretches(buf: np.ndarray, offsets: np.ndarray, length: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram numbers, stretch of each gram, row of each stretch); rows without letters have no stretch."""
    if not len(buf):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    # A break before each row keeps grams from crossing rows.
    kept_rows = np.flatnonzero(np.diff(offsets) > 0)
    c = np.insert(_TABLE[buf], offsets[kept_rows], 0)
    row = np.insert(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), offsets[kept_rows], kept_rows)
    keep = (c != 63) & ((c > 0) | np.append(True, c[:-1] > 0))
    c, row = c[keep].astype(np.int64), row[keep]
    begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    letters = np.add.reduceat((c > 0).astype(np.int64), begins)
    sizes = np.diff(np.append(begins, len(row)))
    has = np.repeat(letters > 0, sizes)
    place = np.arange(len(row)) - np.repeat(begins, sizes)
    own = np.where(letters > 0, -(-sizes // length), 0)
    first = np.cumsum(own) - own
    stretch = np.repeat(first, sizes) + place // length
    rows = np.repeat(row[begins], own)
    c1, c2 = np.append(c[1:], 0), np.append(c[2:], [0, 0])[: len(c)]
    left = np.repeat(sizes, sizes) - place
    grams, owner = [], []
    for number, ok in ((62 * 4096 + c, c > 0), (61 * 4096 + c * 64 + c1, left > 1), (c * 4096 + c1 * 64 + c2, left > 2)):
        ok = ok & has
        grams.append(number[ok])
        owner.append(stretch[ok])
    return np.concatenate(grams), np.concatenate(owner), rows


def presence(grams: np.ndarray, owner: np.ndarray, n: int, index: np.ndarray, width: int) -> np.ndarray:
    """0/1 matrix of which of the known grams each of n stretches holds."""
    out = np.zeros((n, width + 1), dtype=np.float32)
    out[owner, index[grams]] = 1
    return out[:, :width]


class LanguageModel:
    """Known grams, landmark weights folded with the regression (grams x languages), and the languages."""

    def __init__(self, languages: list[str], index: np.ndarray, weights: np.ndarray) -> None:
        self.languages, self.index, self.weights = languages, index, weights

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean regression value per language, number of stretches) of each row."""
        rows = len(offsets) - 1
        grams, owner, row = gram_stretches(buf, offsets)
        width = len(self.weights)
        out = np.zeros((rows, len(self.languages)))
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
        step = 256
        for a in range(0, len(row), step):
            lo, hi = np.searchsorted(owner, [a, a + step])
            x = presence(grams[lo:hi], owner[lo:hi] - a, min(step, len(row) - a), self.index, width)
            value = (x @ self.weights) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
            np.add.at(out, row[a : a + step], value)
        n = np.bincount(row, minlength=rows)
        return out / np.maximum(n, 1)[:, None], n


def fit_kernel_ridge(samples: list[np.ndarray], languages: list[str], per_language: int, ridge: float) -> LanguageModel:
    """Fit on gram sets and their languages; the first ``per_language`` sets of each are the landmarks."""
    names = sorted(set(languages))
    y = np.array([names.index(v) for v in languages])
    marks = np.concatenate([np.flatnonzero(y == k)[:per_language] for k in range(len(names))])
    known = np.unique(np.concatenate([samples[i] for i in marks]))
    index = np.full(_CLASSES**3, len(known), dtype=np.int32)
    index[known] = np.arange(len(known))
    x = np.zeros((len(samples), len(known) + 1), dtype=np.float32)
    for i, s in enumerate(samples):
        x[i, index[s]] = 1
    x = x[:, :-1]
    x /= np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
    land = x[marks]
    k_nm, k_mm = (x @ land.T).astype(float), (land @ land.T).astype(float)
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    # Every language weighs the same, however many samples it has.
    weight = (len(y) / len(names) / np.bincount(y, minlength=len(names)))[y]
    gram = k_nm.T @ (k_nm * weight[:, None]) + ridge * k_mm + 1e-8 * np.trace(k_mm) * np.eye(len(marks))
    alpha = np.linalg.solve(gram, k_nm.T @ (target * weight[:, None]))
    return LanguageModel(names, index, (land.T @ alpha).astype(np.float32))


def _sample_grams(pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, _, buf, offsets in text_blocks(batch, "text"):
                grams, owner, row = gram_stretches(buf, offsets)
                own, sets = [], []
                for r in np.unique(row).tolist():
                    mine = np.flatnonzero(row == r)
                    # Evenly over the whole text.
                    for s in np.unique(mine[np.linspace(0, len(mine) - 1, min(pieces, len(mine))).astype(int)]).tolist():
                        own.append(langs[first + r])
                        sets.append(np.unique(grams[owner == s]))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([s.tolist() for s in sets], pa.list_(pa.int32()))], names=["lang", "grams"])

    return run


def fit_language(docs: DataFrame, keep: Column | None = None, max_docs: int = 400, pieces: int = 3, landmarks: int = 60, ridge: float = 0.1, key: str = "doc_id") -> LanguageModel | None:
    """Fit on at most ``max_docs`` texts of each non-null lang, those with the smallest hash of key and text.

    ``keep`` is a condition on ``id``. Each text gives at most ``pieces`` stretches; their gram sets reach the
    driver. None when no text with letters has a lang.
    """
    rows = docs.select(F.col(key).alias("id"), text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.lit(True) if keep is None else keep) & F.col("text").rlike(r"\p{L}"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id", "text"), "id", "text"))
    sample = rows.withColumn("place", place).where(F.col("place") <= max_docs).select("lang", "text")
    got = sample.mapInArrow(_sample_grams(pieces), "lang string, grams array<int>").collect()
    got = sorted((r["lang"], r["grams"]) for r in got if r["grams"])
    # A fixed shuffle: landmarks come from all over the sample.
    got = [got[i] for i in np.random.default_rng(3).permutation(len(got))]
    if not got:
        return None
    return fit_kernel_ridge([np.array(g) for _, g in got], [v for v, _ in got], landmarks, ridge)


def _predict(sent, sharpness: float):
    loaded = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not loaded:
            loaded.append(LanguageModel(*pickle.loads(sent.value)))
        model = loaded[0]
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            for first, end, buf, offsets in text_blocks(batch, "text"):
                value, n = model.scores(buf, offsets)
                best = value.argmax(axis=1)
                odds = np.exp(sharpness * (value - value.max(axis=1, keepdims=True)))
                score = 1 / odds.sum(axis=1)
                texts = batch.column("text")
                # Bytes beyond ASCII, or none of a letter's: ask Python what is a letter.
                ascii_letter = np.isin(buf | 0x20, np.arange(97, 123, dtype=np.uint8))
                seen = np.concatenate([[0], np.cumsum(ascii_letter)])[offsets]
                for r in np.flatnonzero(seen[1:] == seen[:-1]).tolist():
                    if not any(c.isalpha() for c in texts[first + r].as_py() or ""):
                        best[r], score[r] = len(model.languages), 0.0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, model: LanguageModel | None, sharpness: float = 3.0, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, lang_pred, score (softmax of the mean regression values).

    Whole texts are read, in one pass without a shuffle. Null texts and texts without a letter are ``und`` with
    score 0, as is every text when there is no model. Other columns take no part.
    """
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty().alias("text"))
    if model is None:
        return rows.select(F.col("doc_id").alias(key), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps((model.languages, model.index, model.weights)))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(_predict(sent, sharpness), kind).withColumnRenamed("doc_id", key)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = predict_language(docs, fit_language(docs, ~held_out("id", 4, 2)))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
