"""Banded alignment of word sequences, many pairs at a time.

``within`` tells exactly which pairs have an edit distance within their limit.
Common ends are trimmed, a bound on the shared words drops hopeless pairs, and
the rest is aligned in a band around the diagonal, which is widened until a
cost within the limit is found or the band passes the limit.
"""

from __future__ import annotations

import numpy as np

#: Pairs aligned together, and cells of a row of theirs.
PAIRS, CELLS = 128, 1 << 18


def trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences without their common start and end."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = differ[0] if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    tail = differ[0] if len(differ) else n
    return a[:len(a) - tail], b[:len(b) - tail]


def least_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: the longer length less the words shared as multisets."""
    va, na = np.unique(a, return_counts=True)
    vb, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    return max(len(a), len(b)) - int(np.minimum(na[ia], nb[ib]).sum())


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Cost of the best alignment of each pair within ``band`` cells of the
    diagonal: exact where it is at most ``band``."""
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    rows, width = int(n.max()), 2 * band + 1
    ids = np.unique(np.concatenate([x for p in pairs for x in p] or [np.zeros(0, np.uint64)]))
    left = np.full((len(pairs), rows), -1, np.int32)
    right = np.full((len(pairs), rows + 2 * band + 1), -2, np.int32)
    for k, (a, b) in enumerate(pairs):
        left[k, :len(a)] = np.searchsorted(ids, a)
        b = b[:rows + band]
        right[k, band:band + len(b)] = np.searchsorted(ids, b)
    far = np.int32(1 << 29)
    steps = np.arange(width, dtype=np.int32)
    now = np.tile(np.where(steps >= band, steps - band, far).astype(np.int32), (len(pairs), 1))
    out = np.full(len(pairs), far, np.int64)
    goal = m - n + band  # the last cell's place in the band
    inside = (goal >= 0) & (goal < width)
    done = np.flatnonzero(inside & (n == 0))
    out[done] = now[done, goal[done]]
    for i in range(1, rows + 1):
        cost = now + (right[:, i - 1:i - 1 + width] != left[:, i - 1:i])
        np.minimum(cost[:, :-1], now[:, 1:] + 1, out=cost[:, :-1])
        if i <= band:
            cost[:, :band - i] = far
            cost[:, band - i] = i
        now = np.minimum.accumulate(cost - steps, axis=1) + steps
        done = np.flatnonzero(inside & (n == i))
        if len(done):
            out[done] = now[done, goal[done]]
    return out


def within(pairs: list[tuple[np.ndarray, np.ndarray]], limits: list[int]) -> np.ndarray:
    """Whether each pair's edit distance is at most its limit.

    The cost found in a band is never below the distance, so a cost within the
    limit accepts at once; a pair is rejected by the bound on shared words, or
    when the band is as wide as the limit, where the cost is exact.
    """
    out = np.zeros(len(pairs), bool)
    todo = []
    for k, ((a, b), limit) in enumerate(zip(pairs, limits)):
        if abs(len(a) - len(b)) > limit:
            continue
        a, b = trim(a, b)
        if max(len(a), len(b)) <= limit:
            out[k] = True
        elif len(a) and len(b) and least_distance(a, b) <= limit:
            todo.append((max(len(a), len(b)), k, a, b))
    band = 8
    while todo:
        todo.sort(key=lambda x: x[0])
        later, at = [], 0
        while at < len(todo):
            size = max(1, min(PAIRS, CELLS // (2 * band + 1)))
            part, at = todo[at:at + size], at + size
            for (n, k, a, b), cost in zip(part, banded([(a, b) for _, _, a, b in part], band)):
                if cost <= limits[k]:
                    out[k] = True
                elif band < limits[k]:
                    later.append((n, k, a, b))
        todo, band = later, band * 3
    return out
