"""Token-sort similarity of short texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_tokens(col: Column) -> Column:
    """Whitespace tokens of a text in sorted order, joined by one blank."""
    return F.array_join(F.array_sort(F.filter(F.split(col, r"\s+"), lambda t: t != "")), " ")


# Letters after which pairs that are too unlike are looked for, and from the second time on left out.
PREFIX_STEP = 8
# The places after the first 0 to 64 of a word.
_BEYOND = np.array([(1 << 64) - (1 << n) for n in range(65)], dtype=np.uint64)


@lru_cache(maxsize=4096)
def _positions(text: str) -> dict[str, int]:
    """Per character, the bit set of its positions; partners of one text come in runs."""
    where: dict[str, int] = {}
    for i, ch in enumerate(text):
        where[ch] = where.get(ch, 0) | (1 << i)
    return where


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer step per character of b."""
    where = _positions(a)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """100 * 2 * LCS / (len(a) + len(b)); two empty texts are alike."""
    for left, right in pairs:
        yield pd.Series(
            [
                100.0 if a == b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))
                for a, b in zip(left, right)
            ],
            dtype="float64",
        )


def text_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every text as one row, filled up with -1, and the lengths."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.full((len(texts), max(1, int(sizes.max(initial=0)))), -1, dtype=np.int32)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<i4")
    return codes, sizes


def pair_marks(codes: np.ndarray, words: int) -> np.ndarray:
    """Bit sets (rows of 64-bit words) that mark the two-letter grams of every text; repeats count separately."""
    marks = np.zeros((len(codes), words), dtype=np.uint64)
    if codes.shape[1] < 2:
        return marks
    pair = np.where(codes[:, 1:] < 0, -1, (codes[:, :-1].astype(np.int64) << 21) | codes[:, 1:])
    pair.sort(axis=1)
    place = np.arange(pair.shape[1])
    new = np.concatenate([np.ones((len(pair), 1), dtype=bool), pair[:, 1:] != pair[:, :-1]], axis=1)
    nth = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    with np.errstate(over="ignore"):
        h = (pair.astype(np.uint64) + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
        h = ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
    bit = np.left_shift(np.uint64(1), h & np.uint64(63))
    word = (h >> np.uint64(6)) % np.uint64(words)
    for w in range(words):
        marks[:, w] = np.bitwise_or.reduce(np.where((pair >= 0) & (word == w), bit, np.uint64(0)), axis=1)
    return marks


def _letter_keys(codes: np.ndarray) -> np.ndarray:
    """Per text, one number for each letter and how often it came before (rows sorted); -1 where the text is filled up.

    Beyond 1,024 repeats of a letter in a text no more are told apart, they get -1 too.
    """
    letters = np.sort(codes, axis=1).astype(np.int64)
    place = np.arange(letters.shape[1])
    new = np.concatenate([np.ones((len(letters), 1), dtype=bool), letters[:, 1:] != letters[:, :-1]], axis=1)
    nth = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    return np.where((letters >= 0) & (nth < 1024), letters << 10 | nth, -1)


def letter_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nth occurrences of letters (as numbers) that the texts have, and in how many of the texts each is."""
    keys = _letter_keys(codes)
    return np.unique(keys[keys >= 0], return_counts=True)


def letter_marks(codes: np.ndarray, keys: np.ndarray, words: int) -> np.ndarray:
    """Bit sets (rows of 64-bit words): which of the sorted keys, 64 a word at most, every text has.

    A letter that is dropped from a text or added to it changes one bit at most.
    """
    bits = np.zeros((len(codes), 64 * words), dtype=bool)
    if len(keys):
        own = _letter_keys(codes)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        row, place = np.nonzero(keys[at] == own)
        bits[row, at[row, place]] = True
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def place_masks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of some texts, and per letter (one more that is nowhere), 64 places and text the bits of its places."""
    letters = np.unique(codes[codes >= 0])
    masks = np.zeros((len(letters) + 1, -(-codes.shape[1] // 64), len(codes)), dtype=np.uint64)
    for at in range(codes.shape[1]):
        row = np.flatnonzero(codes[:, at] >= 0)
        masks[np.searchsorted(letters, codes[row, at]), at >> 6, row] |= np.uint64(1 << (at & 63))
    return letters, masks


def letter_numbers(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Places of code points in ``letters``; what is not there gets the number after the last."""
    if not len(letters):
        return np.zeros(codes.shape, dtype=np.int64)
    at = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    return np.where(letters[at] == codes, at, len(letters))


def _take_letter(state: np.ndarray, hit: np.ndarray, moved: np.ndarray) -> None:
    """One letter of the other text: ``state = (state + hit) | (state - hit)`` over words of 64 places, low word first."""
    if len(state) == 1:
        np.add(state, hit, out=moved)
        np.subtract(state, hit, out=state)
        np.bitwise_or(state, moved, out=state)
        return
    carry = np.zeros(state.shape[1], dtype=np.uint64)
    for w in range(len(state)):
        np.add(state[w], hit[w], out=moved[w])
        over = moved[w] < hit[w]
        moved[w] += carry
        carry = (over | (moved[w] < carry)).astype(np.uint64)
        state[w] = moved[w] | (state[w] - hit[w])


def subsequences_of_one(masks: np.ndarray, letters: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of one text (as letter numbers) with all texts of the masks."""
    state = np.full(masks.shape[1:], ~np.uint64(0), dtype=np.uint64)
    hit, moved = np.empty_like(state), np.empty_like(state)
    for letter in letters:
        # The letter after the last stands in none of the texts.
        if letter < len(masks) - 1:
            np.bitwise_and(state, masks[letter], out=hit)
            _take_letter(state, hit, moved)
    return np.bitwise_count(~state).sum(axis=0, dtype=np.int64)


def subsequences_of_pairs(masks: np.ndarray, numbers: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The same for pairs: text ``row`` of the letter numbers and text ``column`` of the masks."""
    state = np.full((masks.shape[1], len(row)), ~np.uint64(0), dtype=np.uint64)
    moved = np.empty_like(state)
    texts = masks.shape[2]
    by_letter = masks.transpose(1, 0, 2).reshape(masks.shape[1], -1)
    for at in range(numbers.shape[1]):
        where = numbers[row, at] * texts + column
        _take_letter(state, state & by_letter[:, where], moved)
    return np.bitwise_count(~state).sum(axis=0, dtype=np.int64)


def pair_tables(masks: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks with one row for each 64 places, and where each letter of the other texts starts there."""
    return np.ascontiguousarray(masks.transpose(1, 0, 2)).reshape(masks.shape[1], -1), np.ascontiguousarray(numbers.T) * masks.shape[2]


def long_subsequences(
    tables: tuple[np.ndarray, np.ndarray], row: np.ndarray, column: np.ndarray, size: np.ndarray, dropped: np.ndarray, added: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs may keep within some unmatched letters, and the lengths of their longest common subsequences.

    Per pair, ``size`` are the letters of text ``row``, ``dropped`` and ``added`` how many letters of text ``row`` and of
    text ``column`` may stay without a partner. Of the first p letters of text ``row``, p - ``dropped`` then find theirs, with
    ``added`` others between them at most: so among the first p - ``dropped`` + ``added`` letters of text ``column``. Pairs
    that fail this on the way are left out; others are counted to the end.
    """
    by_letter, starts = tables
    left = np.arange(len(row))
    state = np.full((len(by_letter), len(row)), ~np.uint64(0), dtype=np.uint64)
    moved = np.empty_like(state)
    for at, start in enumerate(starts, 1):
        where = start.take(row)
        where += column
        _take_letter(state, state & by_letter.take(where, axis=1), moved)
        if at % PREFIX_STEP == 0 and 2 * PREFIX_STEP <= at < len(starts):
            owed = np.minimum(size, at) - dropped
            common = np.zeros(len(left), dtype=np.int64)
            for w in range(len(state)):
                beyond = _BEYOND.take(owed + (added - 64 * w), mode="clip")
                common += np.bitwise_count(~(state[w] | beyond))
            stays = np.flatnonzero(common >= owed)
            if 4 * len(stays) <= 3 * len(left):
                state = state.take(stays, axis=1)
                moved = np.empty_like(state)
                left, row, column, size, dropped, added = (x.take(stays) for x in (left, row, column, size, dropped, added))
                if not len(left):
                    break
    return left, np.bitwise_count(~state).sum(axis=0, dtype=np.int64)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))
