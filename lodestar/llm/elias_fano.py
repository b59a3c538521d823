"""Elias-Fano codes of monotone numbers, read and searched many at a time without unpacking."""

from __future__ import annotations

import struct

import numpy as np

U = np.uint64
ONE, SIX, WORD = U(1), U(6), U(63)


#: By bits of a byte and n: position of the byte's n-th set bit.
IN_BYTE = np.array([([i for i in range(8) if x >> i & 1] + [0] * 8)[:8] for x in range(256)], np.uint8).reshape(-1)


def _nth_bit(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Position of the n-th (from 0) set bit of each word."""
    at = np.zeros(len(word), U)
    for width in (32, 16, 8):
        below = np.bitwise_count(word & U((1 << width) - 1))
        go = n >= below
        n = n - below * go
        step = go * U(width)
        at += step
        word = word >> step
    return at + IN_BYTE[((word & U(255)) << U(3)) + n]


class EliasFano:
    """n monotone numbers up to `top`: l low bits of each packed, the rest as gaps in unary."""

    def __init__(self, n: int, l: int, top: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.l, self.top, self.low, self.high, self.zeros = n, l, top, low, high, zeros
        self.ones = np.arange(len(zeros), dtype=U) * U(64) - zeros

    @classmethod
    def build(cls, values: np.ndarray, top: int | None = None) -> EliasFano:
        values = np.asarray(values, U)
        n = len(values)
        top = int(values[-1]) if top is None and n else top or 0
        l = min(max(0, (top // max(n, 1)).bit_length() - 1), 62)
        at = (values >> U(l)) + np.arange(n, dtype=U)
        bits = np.zeros(-(-(n + (top >> l) + 2) // 64) * 64, bool)
        bits[at.astype(np.int64)] = True
        high = np.packbits(bits, bitorder="little").view(U)
        low = np.zeros(n * l // 64 + 2, U)
        if l and n:
            own = values & U((1 << l) - 1)
            bit = np.arange(n, dtype=U) * U(l)
            word, shift = (bit >> SIX).astype(np.int64), bit & WORD
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[first]] = np.bitwise_or.reduceat(own << shift, first)
            over = np.flatnonzero(shift + U(l) > U(64))
            low[word[over] + 1] |= own[over] >> (U(64) - shift[over])  # one number at most reaches over into a word
        zeros = np.concatenate([np.zeros(1, U), np.cumsum(64 - np.bitwise_count(high).astype(np.int64)).astype(U)])[: len(high)]
        return cls(n, l, top, low, high, zeros)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U)
        bit = i.astype(U) * U(self.l)
        word, shift = (bit >> SIX).astype(np.int64), bit & WORD
        upper = np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & WORD), U(0))
        return ((self.low[word] >> shift) | upper) & U((1 << self.l) - 1)

    def _select(self, before: np.ndarray, words: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(before, k, side="right") - 1
        own = self.high[word]
        return word.astype(U) * U(64) + _nth_bit(~own if flip else own, k - before[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        i = np.asarray(i, U)
        return ((self._select(self.ones, self.high, i, False) - i) << U(self.l)) | self._low(i)

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one index of the numbers with these high bits."""
        end = self._select(self.zeros, self.high, h, True) - h
        behind = self._select(self.zeros, self.high, np.maximum(h, ONE) - ONE, True) + ONE
        return np.where(h > 0, behind - h, U(0)), end

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first number that is not less than each value, and whether it equals it. Values up to top only."""
        h, low = values >> U(self.l), values & U((1 << self.l) - 1)
        begin, end = self._bucket(h)
        last = end.copy()
        going = np.flatnonzero(begin < end)
        while len(going):  # halves, as frequent contexts fill their buckets
            a, b = begin[going], end[going]
            middle = (a + b) >> ONE
            less = self._low(middle) < low[going]
            begin[going] = a = np.where(less, middle + ONE, a)
            end[going] = b = np.where(less, b, middle)
            going = going[a < b]
        inner = np.flatnonzero(begin < last)
        equal = np.zeros(len(values), bool)
        equal[inner] = self._low(begin[inner]) == low[inner]
        return begin.astype(np.int64), equal

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first number that is not less than each value; n if there is none."""
        values = np.asarray(values, U)
        out = np.full(len(values), self.n, np.int64)
        inside = np.flatnonzero(values <= U(self.top))
        if self.n and len(inside):
            out[inside] = self._search(values[inside])[0]
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it is not among the numbers."""
        values = np.asarray(values, U)
        out = np.full(len(values), -1, np.int64)
        inside = np.flatnonzero(values <= U(self.top))
        if self.n and len(inside):
            at, equal = self._search(values[inside])
            out[inside[equal]] = at[equal]
        return out

    def dump(self) -> bytes:
        return struct.pack("<5Q", self.n, self.l, self.top, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.zeros.tobytes()

    @classmethod
    def load(cls, data: np.ndarray, at: int = 0) -> tuple[EliasFano, int]:
        """From a (memory-mapped) byte array; also the offset behind it."""
        n, l, top, k, m = struct.unpack_from("<5Q", data[at : at + 40].tobytes())
        at += 40
        view = data[at : at + 8 * (k + 2 * m)].view(U)
        return cls(n, l, top, view[:k], view[k : k + m], view[k + m :]), at + 8 * (k + 2 * m)
