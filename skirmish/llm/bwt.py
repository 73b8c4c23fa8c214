"""Long common strings of short byte strings, from a Burrows-Wheeler transform.

Breadth-first backward extension: the intervals of the suffix order that start with a string w of length l are extended by
every byte in front of them; the end of a new interval, if no shorter string ended there, is where neighbouring suffixes
have exactly l bytes in common. So common prefixes become known by increasing value, and the search stops at the wanted
minimum length: the ends still unknown then part suffixes with at least that much in common.
"""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of at least their first `depth` codes; further ties by place. Codes are below 257."""
    n = len(codes)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = codes
    rank = np.zeros(n, np.uint64)
    for k in range(7):  # nine bits a code
        rank = (rank << np.uint64(9)) | wide[k : k + n]
    order = np.argsort(rank, kind="stable")
    known = 7
    while True:
        r = rank[order]
        fresh = np.concatenate([[True], r[1:] != r[:-1]])
        number = np.cumsum(fresh)
        if known >= depth or number[-1] == n:
            return order
        now = np.empty(n, np.int64)
        now[order] = number
        after = np.zeros(n, np.int64)
        after[: max(0, n - known)] = now[known:]
        rank = now * (n + 1) + after
        order = order[np.argsort(rank[order], kind="stable")]  # nearly sorted already
        known *= 2


def unknown_ends(codes: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place in the order, whether its suffix shares `least` codes with the one before. Code 0 parts strings.

    Only meaningful where the suffix before has no code 0 among its first `least` codes.
    """
    n = len(codes)
    used, dense = np.unique(codes, return_inverse=True)
    sigma = len(used)
    front = dense[order - 1]  # the code before each suffix; the first suffix's is the last code, a 0
    seen = np.zeros((n + 1, sigma), np.uint16 if n < 65536 else np.int32)
    seen[np.arange(1, n + 1), front] = 1
    np.cumsum(seen, axis=0, out=seen)
    first = np.concatenate([[0], np.cumsum(np.bincount(dense, minlength=sigma))])[:sigma]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    begin = 1 if used[0] == 0 else 0
    for _ in range(least):
        a, b = seen[lo, begin:], seen[hi, begin:]
        i, c = np.nonzero(b > a)
        at = first[c + begin]
        new_lo, new_hi = at + a[i, c], at + b[i, c]
        fresh = ~known[new_hi]
        lo, hi = new_lo[fresh], new_hi[fresh]
        if not len(lo):
            break
        known[hi] = True
    return ~known[:n]


def repeated_starts(strings: list[bytes], owners: np.ndarray, least: int) -> list[np.ndarray]:
    """For each string, the offsets at which a string of `least` bytes starts that also starts somewhere else.

    owners: for each string, a number to which an offset is added to name a place of the corpus. The same place may be in
    several strings; it counts once.
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    codes = np.zeros(int(ends[-1]), np.uint16)
    starts = ends - sizes - 1
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    codes[:] = raw
    codes += 1
    codes[ends - 1] = 0
    order = suffix_order(codes, least + 1)
    joined = unknown_ends(codes, order, least)
    which = np.repeat(np.arange(len(strings)), sizes + 1)
    offset = np.arange(len(codes)) - starts[which]
    valid = (sizes[which] - offset >= least)[order]
    run = np.cumsum(~joined)[valid]
    if not len(run):
        return [np.zeros(0, np.int64) for _ in strings]
    at = order[valid]
    with np.errstate(over="ignore"):
        place = owners[which[at]].astype(np.uint64) + offset[at].astype(np.uint64)
    edge = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    low, high = np.minimum.reduceat(place, edge), np.maximum.reduceat(place, edge)
    many = np.repeat(low != high, np.diff(np.append(edge, len(run))))
    found = np.sort(at[many])
    cut = np.searchsorted(found, np.append(starts, len(codes)))
    return [found[i:j] - s for i, j, s in zip(cut[:-1], cut[1:], starts, strict=True)]
