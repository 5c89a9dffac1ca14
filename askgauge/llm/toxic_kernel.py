"""Toxicity by a gap-weighted subsequence string kernel, Nyström landmarks and a linear SVM.

Words are compared by the letters they share in order: three letters at most four places apart, each gap
weighing ``DECAY``. Marks between letters are dropped, look-alike digits and marks count as letters, and
runs of single letters are one word, so ``i.d.i.o.t``, ``1d1ot`` and ``i d i o t`` are the word itself and an
inserted letter costs little.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_words import NOT_BLANK, hash_spans, text_blocks
from .fit import inverse_root, linear_svm, logistic
from .tables import read_table, stored, text_or_empty

DECAY = 0.75
#: Offsets of the second and third letter, and the weight of their gaps.
_STEPS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
_CLASSES = 64
_START = 63
#: Words are compared in stretches of this many letters, overlapping by half.
STRETCH = 24


def _letter_classes() -> np.ndarray:
    """Class of each UTF-8 byte: letters without case, look-alikes as letters, 0 for what is dropped."""
    table = np.zeros(256, dtype=np.uint8)
    for i in range(26):
        table[[65 + i, 97 + i]] = i + 1
    for mark, letter in zip("013457@$!", "oieastasi", strict=True):
        table[ord(mark)] = ord(letter) - 96
    # Second bytes of U+00C0 to U+00FF carry the letter; capitals lie 0x20 below the small ones.
    for b in range(0x80, 0xC0):
        table[b] = 27 + (b | 0x20) - 0xA0
    return table


_TABLE = _letter_classes()


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letter classes, starts, ends, row) of all words with at least two letters."""
    rows = len(offsets) - 1
    if not len(buf):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint8), none, none, none
    # Marks at the edge of a word are no look-alikes: "idiot!" ends at its t.
    inside = NOT_BLANK[buf]
    classes = np.where(inside, _TABLE[buf], 0)
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    follows = np.append(inside[1:], False) & ~edge[1:]
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    mark = (buf == 33) | (buf == 36) | (buf == 64)
    classes[mark & (~follows | ~before | np.append(mark[1:], False) | np.concatenate([[False], mark[:-1]]))] = 0
    begins = inside & ~before
    word = np.cumsum(begins) - 1
    keep = classes > 0
    letters, owner = classes[keep], word[keep]
    n_words = int(begins.sum())
    size = np.bincount(owner, minlength=n_words)
    row = np.searchsorted(offsets, np.flatnonzero(begins), side="right") - 1
    # Words of one letter that follow each other in a row are one word.
    single = size == 1
    joins = np.zeros(n_words, dtype=bool)
    joins[1:] = single[1:] & single[:-1] & (row[1:] == row[:-1])
    group = np.cumsum(~joins) - 1
    first = np.flatnonzero(~joins)
    size = np.bincount(group, weights=size, minlength=len(first)).astype(np.int64)
    ends = np.cumsum(size)
    starts, row = ends - size, row[first]
    ok = size >= 2
    assert len(letters) == (ends[-1] if len(ends) else 0) and rows >= 0
    return letters, starts[ok], ends[ok], row[ok]


def stretches(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut into overlapping stretches: (starts, ends, word of each)."""
    half = STRETCH // 2
    parts = np.maximum(1, -(-(ends - starts - half) // half))
    word = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = starts[word] + nth * half
    return at, np.minimum(at + STRETCH, ends[word]), word


def _matrix(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Letters of each stretch behind a start sign, padded with 0."""
    width = int((ends - starts).max(initial=0))
    grid = np.zeros((len(starts), width + 1 + 4), dtype=np.int64)
    grid[:, 0] = _START
    for j in range(width):
        live = starts + j < ends
        grid[live, 1 + j] = letters[starts[live] + j]
    return grid


def subsequences(grid: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(feature numbers by stretch and place, weight) for each gap pattern; 0 where there is none."""
    n = grid.shape[1] - 4
    for a, b in _STEPS:
        first, second, third = grid[:, :n], grid[:, a : n + a], grid[:, b : n + b]
        yield np.where(third > 0, (first * _CLASSES + second) * _CLASSES + third, 0), DECAY ** (b - 2)


def folded_scores(grid: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the weights of each stretch's features, normed."""
    out, norm = np.zeros(len(grid)), np.zeros(len(grid))
    for number, weight in subsequences(grid):
        out += weight * table[number].sum(axis=1)
        norm += weight * weight * (number > 0).sum(axis=1)
    return out / np.sqrt(np.maximum(norm, 1.0))


@dataclass
class Landmarks:
    """Normed features of the landmark words, as rows of a matrix for those features that any has."""

    words: list[bytes]
    index: np.ndarray
    matrix: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Landmarks:
        grid = _grams(words)
        parts = [(number, weight) for number, weight in subsequences(grid)]
        used = np.unique(np.concatenate([n.reshape(-1) for n, _ in parts] + [np.zeros(1, dtype=np.int64)]))
        index = np.zeros(_CLASSES**3, dtype=np.int32)
        index[used] = np.arange(len(used))
        matrix = np.zeros((len(used), len(words)))
        norm = np.zeros(len(words))
        for number, weight in parts:
            np.add.at(matrix, (index[number], np.arange(len(words))[:, None]), weight)
            norm += weight * weight * (number > 0).sum(axis=1)
        matrix[0] = 0
        return cls(words, index, matrix / np.sqrt(np.maximum(norm, 1.0)))

    def kernel(self, grid: np.ndarray) -> np.ndarray:
        """Kernel values of each stretch (rows) with each landmark (columns)."""
        out, norm = np.zeros((len(grid), len(self.words))), np.zeros(len(grid))
        for number, weight in subsequences(grid):
            at = self.index[number]
            for j in range(at.shape[1]):
                out += weight * self.matrix[at[:, j]]
            norm += weight * weight * (number > 0).sum(axis=1)
        return out / np.sqrt(np.maximum(norm, 1.0))[:, None]

    def folded(self, w: np.ndarray) -> np.ndarray:
        """One weight per feature: kernel values times w, as a single lookup."""
        return (self.matrix @ w)[self.index]


@dataclass
class ToxicModel:
    """Word scores are one lookup per feature (kernel, landmarks and SVM are linear in the features); a
    document is judged by its counts of hits and by the kernel values of its hits with the landmarks."""

    landmarks: Landmarks | None
    table: np.ndarray
    offset: float
    document: np.ndarray

    def packed(self) -> bytes:
        """Plain arrays only, so that a worker needs no import path to read them."""
        marks = (self.landmarks.words, self.landmarks.index, self.landmarks.matrix) if self.landmarks else None
        return pickle.dumps((marks, self.table, self.offset, self.document))

    @classmethod
    def unpacked(cls, data: bytes) -> ToxicModel:
        marks, table, offset, document = pickle.loads(data)
        return cls(Landmarks(*marks) if marks else None, table, offset, document)

    def inputs(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(words, hits, soft hits, top score, summed kernel values of the hits with each landmark) by row."""
        letters, starts, ends, row = words_of(buf, offsets)
        rows, m = len(offsets) - 1, len(self.landmarks.words) if self.landmarks else 0
        out = np.zeros((rows, 4 + m))
        out[:, 3] = -2
        if not len(starts) or not m:
            out[:, 0] = np.bincount(row, minlength=rows)
            return out
        _, first, which = np.unique(hash_spans(letters, starts, ends), return_index=True, return_inverse=True)
        at, stop, word = stretches(starts[first], ends[first])
        size = stop - at
        score = np.full(len(first), -2.0)
        # Stretches of like length together: short words need few places.
        for low, high in ((0, 6), (7, 10), (11, 15), (16, STRETCH)):
            mine = np.flatnonzero((size >= low) & (size <= high))
            for part in np.array_split(mine, max(1, len(mine) // 20_000)):
                if len(part):
                    np.maximum.at(score, word[part], folded_scores(_matrix(letters, at[part], stop[part]), self.table) + self.offset)
        # Kernel values of the hits alone: a text has far more distinct words.
        hot = score > 0
        place = np.cumsum(hot) - 1
        values = np.zeros((int(hot.sum()), m))
        part = np.flatnonzero(hot[word])
        for piece in np.array_split(part, max(1, len(part) // 5000)):
            if len(piece):
                np.maximum.at(values, place[word[piece]], self.landmarks.kernel(_matrix(letters, at[piece], stop[piece])))
        score = score[which]
        out[:, 0] = np.bincount(row, minlength=rows)
        out[:, 1] = np.bincount(row, weights=score > 0, minlength=rows)
        out[:, 2] = np.bincount(row, weights=np.clip(score + 1, 0, 2) ** 3, minlength=rows)
        np.maximum.at(out[:, 3], row, score)
        hits = np.flatnonzero(score > 0)
        for piece in np.array_split(hits, max(1, len(hits) // 5000)):
            np.add.at(out[:, 4:], row[piece], values[place[which[piece]]] ** 4)
        return out

    def score(self, inputs: np.ndarray) -> np.ndarray:
        if not len(self.document):
            return np.zeros(len(inputs))
        z = design(inputs) @ self.document[:-1] + self.document[-1]
        return np.where(inputs[:, 0] == 0, 0.0, 1 / (1 + np.exp(-np.clip(z, -40, 40))))


def design(inputs: np.ndarray) -> np.ndarray:
    """The document model's inputs: counts and rates of hits in logarithms, and the landmarks' sums."""
    n, hits, soft, top = inputs[:, :4].T
    own = [np.log1p(hits), np.log1p(soft), np.log((hits + 0.2) / (n + 20)), np.log((soft + 0.2) / (n + 20)), np.log1p(n), np.clip(top, -2, 2), (hits >= 2).astype(float)]
    return np.hstack([np.stack(own, axis=1), np.log1p(inputs[:, 4:])])


def _grams(words: list[bytes]) -> np.ndarray:
    letters = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return _matrix(letters, ends - np.array([len(w) for w in words]), ends)


def _variants(word: bytes, rng: np.random.Generator, n: int) -> list[bytes]:
    """Copies with one letter put in or left out, as in disguised insults."""
    out = []
    for _ in range(n):
        at = int(rng.integers(1, len(word)))
        new = bytes([int(rng.integers(1, 27))])
        out.append(word[:at] + new + word[at:])
    return out


def fit_words(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, landmarks: int = 160, min_documents: int = 3, max_positive: int = 600, max_negative: int = 12_000, seed: int = 5) -> tuple[Landmarks | None, np.ndarray, float]:
    """Word model from how many toxic and clean sentences' documents hold each word.

    Positive examples are words of ``min_documents`` toxic documents and more, found far more often there than in clean
    ones, the ``max_positive`` strongest, each with two variants with a letter put in; negative ones are
    ``max_negative`` words of clean documents, a third of them the most frequent, the others drawn. Landmarks are the strongest positive words and evenly drawn negative ones.
    """
    rng = np.random.default_rng(seed)
    rate = {w: (n / max(n_toxic, 1), (clean[w] + 0.25) / max(n_clean, 1)) for w, n in toxic.items() if n >= min_documents and len(w) >= 3}
    strength = {w: toxic[w] * np.log(p / q) for w, (p, q) in rate.items() if p > 4 * q}
    positive = sorted(strength, key=lambda w: (-strength[w], w))[:max_positive]
    known = set(positive)
    negative = sorted((w for w in clean if w not in known and len(w) >= 3), key=lambda w: (-clean[w], w))
    if not positive or not negative:
        return None, np.zeros(_CLASSES**3), -1.0
    if len(negative) > max_negative:
        often = max_negative // 3
        negative = negative[:often] + [negative[often + i] for i in sorted(rng.choice(len(negative) - often, max_negative - often, replace=False).tolist())]
    chosen = positive[: landmarks * 3 // 4]
    chosen += [negative[i] for i in np.linspace(0, len(negative) - 1, landmarks // 4).astype(int)]
    chosen = sorted(set(chosen))
    marks = Landmarks.of(chosen)
    root = inverse_root(marks.kernel(_grams(chosen)), 1e-4)
    own = [v for w in positive for v in _variants(w, rng, 2)]
    words = [*positive, *own, *negative]
    y = np.array([1.0] * (len(positive) + len(own)) + [-1.0] * len(negative))
    share = np.array([strength[w] for w in positive])
    weight = np.concatenate([np.minimum(share / share.mean(), 3), np.repeat(np.minimum(share / share.mean(), 3), 2) / 1, np.ones(len(negative))])
    weight[y > 0] *= 0.3 * len(negative) / weight[y > 0].sum()
    z = np.vstack([marks.kernel(_grams(words[i : i + 2000])) for i in range(0, len(words), 2000)]) @ root
    w, b = linear_svm(z, y, weight, ridge=1.0)
    return marks, marks.folded(root @ w), b


def disguised(word: str, rng: np.random.Generator) -> str:
    """A word with a letter put in, or with a mark between two letters, somewhere inside."""
    at = int(rng.integers(1, max(2, len(word))))
    return word[:at] + (chr(97 + int(rng.integers(26))) if rng.random() < 0.75 else "-") + word[at:]


def passages(text: str, toxic: int, model: ToxicModel, around: int) -> list[str]:
    """Short examples from a labelled text: its most suspicious word among ``around`` words on either side.

    A toxic text's passage comes again with that word disguised in three ways; a clean text's is a hard negative.
    """
    words = text.split()
    if not words:
        return []
    raw = [w.encode() for w in words]
    ends = np.cumsum([0, *[len(w) for w in raw]])
    top = model.inputs(np.frombuffer(b"".join(raw), dtype=np.uint8), ends)[:, 3]
    at = int(top.argmax())
    if toxic and top[at] <= 0:
        return []
    low, high = max(0, at - around), at + 1 + around
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    forms = [words[at], *[disguised(words[at], rng) for _ in range(3 if toxic else 0)]]
    return [" ".join([*words[low:at], w, *words[at + 1 : high]]) for w in forms]


def _features(sent, around: int, passage_weight: float):
    """Inputs of whole sampled texts (weight 1) and of the passages cut from them (``passage_weight`` together)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicModel.unpacked(sent.value)
        for batch in batches:
            labels, texts = batch.column("toxic").to_pylist(), batch.column("text")
            rows, toxic, weight = [], [], []
            for i, label in enumerate(labels):
                text = texts[i].as_py()
                own = passages(text, label, model, around)
                rows += [text, *own]
                toxic += [label] * (1 + len(own))
                weight += [1.0, *[passage_weight / len(own) for _ in own]]
            whole = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["text"])
            found = [model.inputs(buf, offsets) for _, _, buf, offsets in text_blocks(whole, "text")]
            # Packed: the driver holds all rows of the sample.
            values = [x.astype("<f8").tobytes() for part in found for x in part]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(weight, pa.float64()), pa.array(values, pa.binary())], names=["toxic", "weight", "inputs"])

    return run


def _scores(sent):
    loaded = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not loaded:
            loaded.append(ToxicModel.unpacked(sent.value))
        for batch in batches:
            for first, end, buf, offsets in text_blocks(batch, "text"):
                f = loaded[0].inputs(buf, offsets)
                own = batch.column("doc_id").slice(first, end - first)
                yield pa.RecordBatch.from_arrays([own, pa.array(loaded[0].score(f)), pa.array(f[:, 0].astype(np.int64)), pa.array(f[:, 1].astype(np.int64))], names=["doc_id", "score", "words", "hits"])

    return run


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each document, from all of its sentences."""
    for batch in batches:
        for first, end, buf, offsets in text_blocks(batch, "text"):
            letters, starts, ends, row = words_of(buf, offsets)
            at, stop, word = stretches(starts, ends)
            data = letters.tobytes()
            sets: list[set] = [set() for _ in range(end - first)]
            for i, a, b in zip(row[word].tolist(), at.tolist(), stop.tolist(), strict=True):
                sets[i].add(data[a:b])
            own = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays([own.column("toxic"), pa.array([sorted(s) for s in sets], pa.list_(pa.binary()))], names=["toxic", "words"])


def sample_labelled(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, keep: Column, key: str) -> DataFrame:
    """At most so many labelled texts of each kind, those with the smallest hash of their key and text.

    Null labels, and ids with unlike labels, are left out.
    """
    own = labels.select(F.col(key).alias("id"), F.col("toxic").cast("int").alias("toxic")).groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    own = own.where((F.col("toxic") == F.col("most")) & F.col("toxic").isin(0, 1)).drop("most")
    texts = docs.select(F.col(key).alias("id"), text_or_empty().alias("text"))
    # Only ids and hashes are joined and ordered; the chosen rows, so many at most, then fetch their texts.
    rows = texts.select("id", F.xxhash64("text").alias("h")).where(keep).join(own, "id")
    order = [F.xxhash64("id", "h"), "id", "h"]
    toxic = rows.where("toxic = 1").orderBy(*order).limit(max_toxic)
    chosen = stored(toxic.unionByName(rows.where("toxic = 0").orderBy(*order).limit(max_clean)).distinct(), "toxic-chosen")
    return texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "h"]).select("id", "text", "toxic")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, keep: Column | None = None, max_toxic: int = 1200, max_clean: int = 3600, landmarks: int = 160, min_documents: int = 3,
    max_positive: int = 600, max_negative: int = 12_000, around: int = 15, passage_weight: float = 2.0, toxic_weight: float = 4.0, key: str = "doc_id",
) -> ToxicModel:
    """Fit on at most ``max_toxic`` and ``max_clean`` labelled documents for which ``keep`` (on ``id``) holds.

    The word model learns from the sample's words (bounds: see ``fit_words``). The document model learns from the
    whole texts and from passages of ``around`` words on either side of each text's most suspicious word, in toxic
    texts also with that word disguised; a text's passages weigh ``passage_weight`` together, toxic rows
    ``toxic_weight`` times as much as clean ones.

    Spark joins and samples; word sets and three numbers per sampled document reach the driver. Without
    usable labels every score is 0.
    """
    sample = stored(sample_labelled(docs, labels, max_toxic, max_clean, F.lit(True) if keep is None else keep, key), "toxic-sample")
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    n = Counter()
    sets = sample.select("toxic", "text").mapInArrow(_word_sets, "toxic int, words array<binary>")
    # One row per word: how many sampled documents of either kind hold it.
    words = sets.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    for row in words.where((F.col("t") >= min_documents) | (F.col("n") - F.col("t") >= 2)).toLocalIterator():
        counts[1][bytes(row["w"])], counts[0][bytes(row["w"])] = row["t"], row["n"] - row["t"]
    n.update({r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()})
    marks, table, offset = fit_words(counts[1], counts[0], n[1], n[0], landmarks, min_documents, max_positive, max_negative)
    model = ToxicModel(marks, table.astype(np.float32), offset, np.zeros(0))
    if marks is None:
        return model
    sent = docs.sparkSession.sparkContext.broadcast(model.packed())
    rows = sample.select("toxic", "text").mapInArrow(_features(sent, around, passage_weight), "toxic int, weight double, inputs binary").collect()
    y = np.array([r["toxic"] for r in rows], dtype=float)
    x = design(np.frombuffer(b"".join(r["inputs"] for r in rows), dtype="<f8").reshape(len(rows), -1))
    model.document = logistic(x, y, np.array([r["weight"] for r in rows]) * np.where(y == 1, toxic_weight, 1.0), ridge=0.1)
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, score (0 to 1), words, hits.

    Every word of every text is scored, in one pass without a shuffle. Null and empty texts have no words and
    the lowest score. Repeated rows give repeated rows; other columns take no part.
    """
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty().alias("text"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, words long, hits long"
    sent = docs.sparkSession.sparkContext.broadcast(model.packed())
    return rows.mapInArrow(_scores(sent), kind).withColumnRenamed("doc_id", key)


def _clean_rows(sent, threshold: float):
    loaded = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not loaded:
            loaded.append(ToxicModel.unpacked(sent.value))
        for batch in batches:
            score = [loaded[0].score(loaded[0].inputs(buf, offsets)) for _, _, buf, offsets in text_blocks(batch, "text")]
            yield batch.filter(pa.array(np.concatenate([*score, np.zeros(0)]) < threshold)).select(["row"])

    return run


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold; one pass, no shuffle."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty().alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model.packed())
    return packed.mapInArrow(_clean_rows(sent, threshold), packed.select("row").schema).select("row.*")


def held_out(column: str, parts: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold that is kept from training; a null id does not."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == fold, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), ~held_out("id", 3, 1))
    found = score_toxicity(docs, model)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
