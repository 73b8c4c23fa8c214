"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict


def components(n_of, links):
    root = {i: i for i in n_of}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in n_of}


def near_duplicates(rows, width, threshold):
    sets = {}
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", low) if x]
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    links = []
    for i, s in sets.items():
        common = Counter(j for x in s for j in where[x] if j < i)
        links += [(i, j) for j, n in common.items() if 100 * n >= threshold * (len(s) + len(sets[j]) - n)]
    comp = components(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def without_repeats(rows, least):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[x : x + least] for _, b in data for x in range(len(b) - least + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for x in range(len(b) - least + 1):
            if seen[b[x : x + least]] > 1:
                gone[x : x + least] = b"\1" * least
        runs = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def best_fit(histogram, capacity):
    room = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fit = [(r, i) for i, r in enumerate(room) if r >= n]
            if fit:
                room[min(fit)[1]] -= n
            else:
                room.append(capacity - n)
    return len(room)
