"""Elias-Fano sequences in numpy: increasing integers in about two bits each
plus the low bits that the universe asks for, read in place.

A sequence is stored as flat bytes (low bits packed, high bits in unary with a
zero between buckets), which a task maps as arrays without decoding them.
"""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64
#: 1 and 128 in each byte of a word.
EACH, HIGH = _U(0x0101010101010101), _U(0x8080808080808080)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)
#: Position of the r-th one in a byte.
SELECT = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    _ones = np.flatnonzero(_BITS[_byte])
    SELECT[_byte, :len(_ones)] = _ones


def select_in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th (from 0) one of each 64-bit word."""
    ones = words - ((words >> _U(1)) & _U(0x5555555555555555))
    ones = (ones & _U(0x3333333333333333)) + ((ones >> _U(2)) & _U(0x3333333333333333))
    ones = ((ones + (ones >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * EACH  # of each byte and those below it
    r = r.astype(np.uint64)
    at = np.bitwise_count((r * EACH + HIGH - ones) & HIGH).astype(np.uint64) * _U(8)  # bytes whose sum is at most r
    before = ((ones << _U(8)) >> at) & _U(255)
    octet = (words >> at) & _U(255)
    return (at + SELECT.ravel()[((octet << _U(3)) + r - before).astype(np.int64)]).astype(np.int64)


class EliasFano:
    """``n`` increasing integers (equal ones allowed)."""

    def __init__(self, data: memoryview | bytes):
        self.n, self.shift, low, high = struct.unpack_from("<4q", data)
        # eight bytes from any byte on
        self.windows = np.ndarray((max(low - 7, 0),), np.uint64, data, 32, (1,)) if low > 7 else np.zeros(0, np.uint64)
        self.words = np.frombuffer(data, np.uint64, high, 32 + low)
        self.size = 32 + low + 8 * high
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(counts)])
        self.zeros = 64 * np.arange(len(self.ones)) - self.ones

    @staticmethod
    def build(values: np.ndarray) -> bytes:
        """The sequence as bytes, a multiple of eight long."""
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        shift = max(0, int(np.log2(top / n))) if n and top > n else 0
        octets = np.ascontiguousarray(values, np.int64).astype("<i8", copy=False).view(np.uint8).reshape(n, 8)[:, :-(-shift // 8)]
        low = np.packbits(np.unpackbits(octets, axis=1, count=shift, bitorder="little"), bitorder="little").tobytes() if shift else b""
        low += bytes(8 + -len(low) % 8)  # a read of eight bytes stays inside
        bits = np.zeros((n + (top >> shift) + 2 + 63) // 64 * 64, np.uint8)
        bits[(values >> shift) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").tobytes()
        return struct.pack("<4q", n, shift, len(low), len(high) // 8) + low + high

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(i), np.int64)
        bit = i * self.shift
        window = self.windows[bit >> 3]
        return ((window >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.shift) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(counts, k, side="right") - 1
        return 64 * at + select_in_word(words[at], (k - counts[at]).astype(np.int64))

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        return ((self._select(i, self.ones, self.words) - i) << self.shift) | self._low(i)

    def successor(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value of at least ``target``, whether it is equal)."""
        bucket, low = target >> self.shift, target & ((1 << self.shift) - 1)
        inside = (bucket >= 0) & (bucket < int(self.zeros[-1]))
        b = np.where(inside, bucket, 0)
        end = self._select(b, self.zeros, ~self.words) - b
        start = np.zeros(len(b), np.int64)
        some = np.flatnonzero(b > 0)
        start[some] = self._select(b[some] - 1, self.zeros, ~self.words) - (b[some] - 1)
        start, end = np.where(inside, start, np.where(bucket < 0, 0, self.n)), np.where(inside, end, np.where(bucket < 0, 0, self.n))
        place, open_ = start.copy(), np.flatnonzero(start < end)
        left, right = start[open_], end[open_]
        while len(open_):
            middle = (left + right) >> 1
            less = self._low(middle) < low[open_]
            left, right = np.where(less, middle + 1, left), np.where(less, right, middle)
            place[open_] = left
            still = np.flatnonzero(left < right)
            open_, left, right = open_[still], left[still], right[still]
        equal = np.zeros(len(place), bool)
        hit = np.flatnonzero(place < end)
        equal[hit] = self._low(place[hit]) == low[hit]
        return place, equal
