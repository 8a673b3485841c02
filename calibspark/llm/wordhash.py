"""Word and byte hashes of many texts at once, with numpy.

A polynomial with wrapped 64-bit arithmetic over a table of random byte values:
prefix sums of ``table[byte] * P**i`` give the hash of any span by one
difference, brought to position 0 with the inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def powers(n: int, base: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n.  Not kept between calls: these helpers
    are shipped to the executors by value, with all that they hold."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _table() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _in_word() -> np.ndarray:
    """ASCII letters and digits, and every byte of other characters."""
    ok = np.zeros(256, bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        ok[lo:hi] = True
    return ok


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums, one longer than the uint8 array ``data``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_table()[data] * powers(len(data), BASE), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); equal bytes have equal hashes at any place."""
    return (sums[end] - sums[start]) * powers(len(sums), INVERSE)[start]


def text_groups(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters, one row at least."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n
    if texts:
        yield first, len(texts)


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words per text): lower-cased runs of
    letters and digits; null has none."""
    data = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    inside = _in_word()[flat]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(d) + 1 for d in data])
    per_text = np.diff(np.searchsorted(start, ends), prepend=0) if len(data) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, np.uint64), per_text
    sums = prefix_sums(flat)
    return mix(span_hashes(sums, start, end) + (end - start).astype(np.uint64)), per_text


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(BASE) + words[j:n + j]
    return mix(out)
