"""Token ids of whole texts by the tokenizers library, encoding every distinct piece once.

A byte-level vocabulary splits a text into pre-tokens first and merges inside them only. Texts are cut at
places where such a split is certain; equal pieces then have equal ids, so they are encoded once and
looked up afterwards. Any other text (special token strings, odd blanks) stays whole in its piece.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .byte_words import hash_spans, text_blocks

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
#: First bytes of characters that may be blanks beyond ASCII.
_UNSURE = np.zeros(256, dtype=bool)
_UNSURE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LONG = 256


def cut_points(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending starts of pieces; every row starts one.

    Certain splits: before a blank that a visible character follows, after a line break between two visible
    characters, between a letter (ASCII, or U+00C0 to U+00FF) and an ASCII character that is
    none, and between an ASCII mark and a line break.
    """
    n = len(buf)
    cut = np.zeros(n + 1, dtype=bool)
    if n > 1:
        here, after = buf[:-1], buf[1:]
        visible = ~(_BLANK[after] | _UNSURE[after])
        cut[:-2] |= (here == 0x20) & visible
        letter = _LETTER[buf]
        wide = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        ends = letter[:-1].copy()
        ends[1:] |= wide[:-1]
        cut[1:-1] |= ends & (after < 0x80) & ~letter[1:]
        lone = (here[1:] == 0x0A) & ~_BLANK[here[:-1]] & (here[:-1] < 0x80)
        cut[2:-1] |= lone & visible[1:]
        cut[1:-1] |= _MARK[here] & (after == 0x0A)
        # A blank at the end of a row has no follower; its split would depend on the next row.
        last = offsets[1:][np.diff(offsets) > 0] - 1
        cut[last] = ends_before(buf, last)
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


def ends_before(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the split before a row's last byte is certain without looking behind it."""
    before, here = buf[np.maximum(at - 1, 0)], buf[at]
    return (at > 0) & ((_LETTER[before] & (here < 0x80) & ~_LETTER[here]) | (_MARK[before] & (here == 0x0A)))


def kept_tokenizer(path: str):
    """The tokenizer of a file, read once by each process: the library keeps some MB of every one that has encoded a batch.

    Functions reach a worker anew with each task, and their globals with them; only its modules stay from task to task.
    The last file's tokenizer is kept, until another file or another state of it is asked for.
    """
    from tokenizers import Tokenizer

    kept = sys.modules.setdefault("_askgauge_kept", types.ModuleType("_askgauge_kept")).__dict__
    found = os.stat(path)
    name = (os.path.realpath(path), found.st_mtime_ns, found.st_size)
    if kept.get("name") != name:
        kept["tokenizer"] = Tokenizer.from_file(path)
        kept["name"] = name
    return kept["tokenizer"]


class PieceTokenizer:
    """Encodes Arrow text columns; keeps the ids of at most ``max_pieces`` pieces (some 32 bytes each) until ``forget``."""

    def __init__(self, path: str, max_pieces: int = 500_000) -> None:
        self.tokenizer = kept_tokenizer(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.max_pieces = max_pieces
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.forget()

    def forget(self) -> None:
        """Let go of all pieces."""
        #: Hashes of known pieces in ascending order, and the number of each piece.
        self.keys, self.slots = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        #: Where each piece's ids begin, and the ids, with room for more.
        self.starts, self.pieces = np.zeros(1 << 12, dtype=np.int32), 0
        self.ids, self.used = np.zeros(1 << 14, dtype=np.uint32), 0

    def _piece_ids(self, raw: list[bytes]) -> list[list[int]]:
        """Ids of pieces: those that are one pre-token for certain by the model alone, without the pattern, the others in one call."""
        out: list[list[int]] = [[]] * len(raw)
        rest = []
        for i, piece in enumerate(raw):
            text = piece.decode("utf-8")
            body = text[1:] if text[0] == " " else text
            if body.isalpha() and max(body) < "ɐ":
                out[i] = [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.alphabet))]
            else:
                rest.append((i, text))
        for (i, _), found in zip(rest, self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    def _append(self, raw: list[bytes]) -> np.ndarray:
        """The numbers of new pieces."""
        found = self._piece_ids(raw)
        lengths = np.array([len(x) for x in found])
        flat = np.fromiter((t for x in found for t in x), dtype=np.uint32, count=int(lengths.sum()))
        end, last = self.used + len(flat), self.pieces + len(found)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used, 2 * len(flat)), dtype=np.uint32)])
        if last >= len(self.starts):
            self.starts = np.concatenate([self.starts[: self.pieces + 1], np.zeros(max(self.pieces, 2 * len(found)), dtype=np.int32)])
        self.ids[self.used : end] = flat
        self.starts[self.pieces + 1 : last + 1] = self.used + np.cumsum(lengths)
        own = np.arange(self.pieces, last)
        self.used, self.pieces = end, last
        return own

    def _block(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = cut_points(buf, offsets)
        ends = np.append(starts[1:], len(buf))
        keep = ends > starts
        starts, ends = starts[keep], ends[keep]
        keys, first, where = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        if self.pieces + len(keys) > self.max_pieces or self.used > 8 * self.max_pieces:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys
        slots = np.empty(len(keys), dtype=np.int64)
        slots[known] = self.slots[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            data, at, stop = buf.tobytes(), starts[first[new]], ends[first[new]]
            slots[new] = self._append([data[a:b] for a, b in zip(at.tolist(), stop.tolist(), strict=True)])
            # Long pieces hardly repeat; they are encoded each time they come up.
            kept = new[stop - at < _LONG]
            self.keys, self.slots = np.insert(self.keys, place[kept], keys[kept]), np.insert(self.slots, place[kept], slots[kept])
        lengths = (self.starts[slots + 1] - self.starts[slots]).astype(np.int64)[where]
        total = np.cumsum(lengths)
        at = np.repeat(self.starts[slots].astype(np.int64)[where] - (total - lengths), lengths) + np.arange(int(total[-1]) if len(total) else 0)
        ids = self.ids[at]
        row_end = np.searchsorted(starts, offsets[1:])
        counts = np.diff(np.concatenate([[0], np.concatenate([[0], total])[row_end]]))
        return ids, counts

    def encode(self, batch: pa.RecordBatch, column: str = "text"):
        """Yield (first row, end row, ids, ids per row) for consecutive rows of a batch."""
        texts = batch.column(column)
        plain = None
        for word in self.special:
            hit = pc.match_substring(texts, word)
            plain = hit if plain is None else pc.or_(plain, hit)
        special = np.flatnonzero(np.asarray(pc.fill_null(plain, False))) if plain is not None else np.zeros(0, dtype=np.int64)
        for start, end, buf, offsets in text_blocks(batch, column):
            odd = special[(special >= start) & (special < end)] - start
            ids, counts = self._block(buf, offsets)
            if len(odd):
                parts = np.split(ids, np.cumsum(counts)[:-1])
                for i in odd.tolist():
                    parts[i] = np.array(self.tokenizer.encode(texts[start + i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
                ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
            yield start, end, ids, counts
