"""Word shingles of many texts at once: 64-bit hashes, computed by numpy over the bytes of a batch."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bytes of text that are hashed together (a longer text is hashed alone).
SLICE = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE + 2)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _words(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word; ends: where each text (and the blank after it) ends."""
    b = np.frombuffer(data, np.uint8)
    up, down = _power(len(b))
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[:len(b)], out=total[1:])
    h = (total[stop] - total[start]) * down[start]
    return mix(h + (stop - start).astype(np.uint64)), np.searchsorted(ends, start, side="right")


def _shingled(data: bytes, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin (one more at the end)."""
    w, doc = _words(data, ends)
    n = len(ends)
    words = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)])
    size = np.where(words == 0, 0, np.maximum(words - k + 1, 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(n), size)
    at = np.arange(begin[-1]) - begin[owner] + first[owner]
    length = np.minimum(words, k)[owner]
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        live = length > j
        h = np.where(live, mix(h * _BASE + w[np.where(live, at + j, 0)]), h) if len(w) else h
    h = mix(h + length.astype(np.uint64))
    for i in range(n):
        h[begin[i]:begin[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=n))])


def shingle_sets(texts: Sequence[str | None], k: int):
    """Yields (hashes, bounds, texts covered) for consecutive slices of the texts."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        if part and size + len(data) > SLICE:
            yield *_shingled(b"".join(part), np.cumsum([len(p) for p in part]), k), len(part)
            part, size = [], 0
        part.append(data + b" ")
        size += len(data) + 1
    if part:
        yield *_shingled(b"".join(part), np.cumsum([len(p) for p in part]), k), len(part)


def sets_of(texts: Sequence[str | None], k: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for h, bounds, n in shingle_sets(texts, k):
        out += [h[bounds[i]:bounds[i + 1]] for i in range(n)]
    return out
