"""Word shingles of many texts at once, as sorted distinct 64-bit hashes, in numpy over Arrow's byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from skirmish.llm.common import chunks, mix64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64), 5)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 to the 64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, 1 << 19)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, base, dtype=np.uint64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """p with n + 1 values; span_hash(p, i, j) is the hash of the bytes i to j."""
    up, _ = _powers(len(raw) + 1)
    p = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUE[raw] * up[: len(raw)], out=p[1:])
    return p


def span_hash(p: np.ndarray, i: np.ndarray | slice, j: np.ndarray | slice, at: np.ndarray) -> np.ndarray:
    """Hashes of the spans from i to j, scaled to the same place; at: the numbers i."""
    _, down = _powers(len(p))
    with np.errstate(over="ignore"):
        return (p[j] - p[i]) * down[at]


def word_edges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; no word reaches over the end of a row."""
    inside = ~_SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the n + 1 bounds of each row's words."""
    starts, ends = word_edges(raw, offsets)
    p = prefix_hash(_LOWER[raw])
    h = mix64(span_hash(p, starts, ends, starts) ^ (ends - starts).astype(np.uint64), 1)
    return h, np.searchsorted(starts, offsets)


def distinct_shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingles, ascending in each row, and the n + 1 bounds of the rows.

    A row with fewer words than the width has its whole word sequence as its one shingle; a row without words has none.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    h, bounds = words(raw, offsets)
    weights = mix64(np.arange(1, width + 1, dtype=np.uint64), 9)
    with np.errstate(over="ignore"):
        joined = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            joined += h[k : k + len(joined)] * weights[k]
        joined = mix64(joined, 2)
    parts, sizes = [], np.zeros(len(offsets), np.int64)
    for r, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if j - i >= width:
            s = np.sort(joined[i : j - width + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif j > i:
            with np.errstate(over="ignore"):
                s = mix64((h[i:j] * weights[: j - i]).sum(dtype=np.uint64)[None], 100 + int(j - i))
        else:
            continue
        parts.append(s)
        sizes[r + 1] = len(s)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(sizes)


def by_chunk(raw: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingles, bounds) over runs of rows of bounded bytes."""
    for i, j in chunks(offsets):
        yield i, j, *distinct_shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
