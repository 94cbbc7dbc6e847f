"""The matching blocks of two texts, the same as difflib's without junk, by arrays.

difflib looks at every pair of equal items for each block that it finds. Here the maximal equal runs of at least k items come from a
join of windows, and blocks are taken from them, longest first; k falls in what is left. Memory is bounded: where a join would make over
PAIRS pairs k grows, and then runs are found row by row.
"""

from __future__ import annotations

import difflib

import numpy as np

# Pairs of a join at most, runs from which arrays pay, cells up to which difflib is faster.
PAIRS, FEW, CELLS = 1 << 18, 12, 400
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def as_texts(a: list[str], b: list[str]) -> tuple[str, str]:
    """Two lists as texts with a character an item, equal where the items are."""
    ids: dict[str, str] = {}
    for x in a + b:
        ids.setdefault(x, chr(0x10000 + len(ids)))
    return "".join(map(ids.__getitem__, a)), "".join(map(ids.__getitem__, b))


def lists(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """blocks() of two lists."""
    if len(a) + len(b) > 1_000_000:  # more than there are characters
        return [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    return blocks(*as_texts(a, b))


def blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(place in a, place in b, size) in order, adjacent ones merged, without the empty one at the end."""
    if a == b:
        return [(0, 0, len(a))] if a else []
    out: list[tuple[int, int, int]] = []
    if a and b:
        if len(a) == 1 or len(b) == 1 or len(a) * len(b) <= CELLS:
            _small(a, b, 0, 0, out)
        else:
            both = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32)
            known, ids = np.unique(both, return_inverse=True)
            bits = max(1, int(len(known) - 1).bit_length())
            ids = ids.astype(np.int64)
            _solve(a, b, ids[: len(a)], ids[len(a) :], bits, out)
    out.sort()
    merged: list[tuple[int, int, int]] = []
    for i, j, n in out:
        if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
            i, j, n = merged[-1][0], merged[-1][1], merged.pop()[2] + n
        merged.append((i, j, n))
    return merged


def _small(a: str, b: str, i: int, j: int, out: list) -> None:
    if len(a) == 1:
        at = b.find(a)
        if at >= 0:
            out.append((i, j + at, 1))
    elif len(b) == 1:
        at = a.find(b)
        if at >= 0:
            out.append((i + at, j, 1))
    elif not set(a).isdisjoint(b):
        out += [(i + m.a, j + m.b, m.size) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


def _windows(a: np.ndarray, b: np.ndarray, bits: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each window of k items, the same for the same items."""
    most = 63 // bits
    w = min(k, most)
    made = []
    for x in (a, b):
        key, have = x, 1
        while have < w:  # windows of `have` items overlap to give longer ones
            more = min(have, w - have)
            key = (key[: len(key) - more] << (bits * more)) | (key[more:] & ((1 << (bits * more)) - 1))
            have += more
        made.append(key)
    while w < k:
        at = len(made[0])
        known, ranks = np.unique(np.concatenate(made), return_inverse=True)
        more = min(w, k - w)
        made = [r[: len(r) - more] * len(known) + r[more:] for r in (ranks[:at], ranks[at:])]
        w += more
    return made[0], made[1]


def _runs(a: np.ndarray, b: np.ndarray, bits: int, k: int, stop: int | None) -> tuple[int, Runs]:
    """The window's length, at least k and less than stop, and place, place and size of all maximal runs that have it."""
    n, m = len(a), len(b)
    most, longest = max(PAIRS, 8 * (n + m)), min(n, m) if stop is None else min(n, m, stop - 1)
    for k in (k, 2 * k, 4 * k):
        if k > longest:
            break
        x, y = _windows(a, b, bits, k)
        order = np.argsort(y, kind="stable")
        y = y[order]
        low = np.searchsorted(y, x, "left")
        count = np.searchsorted(y, x, "right") - low
        total = int(count.sum())
        if total > most:
            continue
        i = np.repeat(np.arange(len(x)), count)
        j = order[np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        first = (i == 0) | (j == 0) | (a[i - 1] != b[j - 1])
        ni, nj = i + k, j + k
        last = (ni >= n) | (nj >= m) | (a[np.minimum(ni, n - 1)] != b[np.minimum(nj, m - 1)])
        si, sj, ei, ej = i[first], j[first], ni[last], nj[last]
        s, e = np.lexsort((si, si - sj)), np.lexsort((ei, ei - ej))
        si, sj = si[s], sj[s]
        return k, (si, sj, ei[e] - si)
    k = max(1, min(longest, n * m // most + 1))
    return k, _by_row(a, b, k)


def _by_row(a: np.ndarray, b: np.ndarray, k: int) -> Runs:
    """The maximal runs of k items or more, without a join: at most a k-th of all pairs."""
    before, now = np.zeros(len(b) + 2, np.int32), np.zeros(len(b) + 2, np.int32)  # how long the run is that ends with an item of b, one place on
    found: list[Runs] = []
    for i in range(len(a) + 1):
        now[1:-1] = before[:-2] + 1
        now[1:-1] *= b == a[i] if i < len(a) else False
        at = np.flatnonzero((before[:-1] >= k) & (now[1:] == 0))
        if len(at):
            size = before[at].astype(np.int64)
            found.append((i - size, at - size, size))
        before, now = now, before
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 3


def _solve(a: str, b: str, x: np.ndarray, y: np.ndarray, bits: int, out: list) -> None:
    """Adds the blocks of a and b; x and y are their characters' numbers."""
    todo: list[tuple[int, int, int, int, int, int | None]] = [(0, len(a), 0, len(b), max(1, 63 // bits), None)]
    while todo:
        p, q, r, s, k, stop = todo.pop()
        if p == q or r == s:
            continue
        if q - p == 1 or s - r == 1 or (q - p) * (s - r) <= CELLS:
            _small(a[p:q], b[r:s], p, r, out)
            continue
        k, runs = _runs(x[p:q], y[r:s], bits, min(k, q - p, s - r), stop)
        left: list[tuple[int, int, int, int]] = []
        _taken(p, q, r, s, k, (runs[0] + p, runs[1] + r, runs[2]), out, left)
        if k > 1:
            todo += [(*box, max(1, k // 3), k) for box in left]


def _cut(p: int, q: int, r: int, s: int, k: int, runs: Runs | list) -> Runs | list:
    """The parts of k items or more that lie in a[p:q] and b[r:s]; few as a list of threes."""
    if not isinstance(runs, list):
        i, j, n = runs
        by = np.maximum(np.maximum(p - i, r - j), 0)
        n = np.minimum(np.minimum(n, q - i), s - j) - by
        keep = n >= k
        runs = (i + by)[keep], (j + by)[keep], n[keep]
        return runs if len(runs[0]) > FEW else list(zip(*(c.tolist() for c in runs), strict=True))
    out = []
    for i, j, n in runs:
        by = max(p - i, r - j, 0)
        n = min(n, q - i, s - j) - by
        if n >= k:
            out.append((i + by, j + by, n))
    return out


def _taken(p: int, q: int, r: int, s: int, k: int, runs: Runs, out: list, left: list) -> None:
    """Adds the blocks of k items or more in a[p:q] and b[r:s], and the boxes between them that have none to left."""
    todo = [(p, q, r, s, _cut(p, q, r, s, k, runs))]
    while todo:
        p, q, r, s, runs = todo.pop()
        if not runs:
            left.append((p, q, r, s))
            continue
        if isinstance(runs, list):
            n, i, j = max((n, -i, -j) for i, j, n in runs)
            i, j = -i, -j
        else:
            at = np.flatnonzero(runs[2] == runs[2].max())
            at = at[runs[0][at] == runs[0][at].min()]
            one = at[runs[1][at].argmin()]
            i, j, n = (int(c[one]) for c in runs)
        out.append((i, j, n))
        for box in ((p, i, r, j), (i + n, q, j + n, s)):
            if box[0] < box[1] and box[2] < box[3]:
                todo.append((*box, _cut(*box, k, runs) if min(box[1] - box[0], box[3] - box[2]) >= k else []))
