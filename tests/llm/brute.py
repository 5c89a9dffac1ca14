"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def jaccard_components(rows: list[tuple], percent: int = 80) -> list[tuple]:
    """(key, n, component) per row."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        if not sets[i]:
            out.append((key, 0, key))
            continue
        keys = [rows[j][0] for j in range(len(rows)) if sets[j] and find(j) == find(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(keys, default=None)))
    return out


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """(key, n_words, n_hit, sorted item ids) per row."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = bench_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1):
            if n:
                windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    out = []
    for key, text in docs:
        words, hit, found = bench_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                owners = windows.get(tuple(words[i : i + n]))
                if owners is not None:
                    hit |= set(range(i, i + n))
                    found |= {str(o) for o in owners if o is not None}
        out.append((key, len(words), len(hit), sorted(found)))
    return out


def remove_repeats(rows: list[tuple], width: int = 50) -> list[tuple]:
    """(key, bytes, removed, spans, kept) per row."""
    last = 1 << 63
    least: dict[bytes, int] = {}
    for key, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            k = last if key is None else key
            least[w] = min(least.get(w, last), k)
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if least[raw[i : i + width]] < (last if key is None else key):
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out.append((key, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out
