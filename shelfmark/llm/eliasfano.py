"""Elias-Fano coded monotone sequences over numpy words, queried many at a time.

The low bits of each value are packed; the high bits are a bit vector with a one
for each value and a zero for each step of the high part. The ones and zeros
before every second word are counted, so a select is a search among the counts
and a look at two words, however the ones are spread.
"""

from __future__ import annotations

import numpy as np

from shelfmark.llm.sharedarrays import load, save

_BLOCK = 2
_U = np.uint64


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` low bits of each value, in 64-bit words; one word more than needed."""
    n = -(-len(values) // 64)
    own = np.zeros(n * 64, _U)
    own[: len(values)] = values & _U((1 << bits) - 1)
    own = own.reshape(n, 64)
    words = np.zeros((n, bits), _U)
    for k in range(64 if bits else 0):
        at, shift = divmod(k * bits, 64)
        words[:, at] |= own[:, k] << _U(shift)
        if shift + bits > 64:
            words[:, at + 1] |= own[:, k] >> _U(64 - shift)
    return np.concatenate((words.reshape(-1), np.zeros(2, _U)))


def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The position of the set bit of each word that ``rank`` set bits stand before."""
    x, r, at = words.copy(), rank.astype(np.int64), np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(x & _U((1 << width) - 1)).astype(np.int64)
        up = r >= below
        r -= below * up
        step = up * width
        x >>= step.astype(_U)
        at += step
    return at


class EliasFano:
    def __init__(self, meta, low, high, zeros, ones):
        self.n, self.bits = int(meta[0]), int(meta[1])
        self.low, self.high, self.zeros, self.ones = low, high, zeros, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """Of values in rising order, repeats allowed."""
        values = np.ascontiguousarray(values, dtype=_U)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1) if n else 0
        places = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        size = -(-((top >> bits) + n + 2) // 64) * 64
        flags = np.zeros(size, np.uint8)
        flags[places] = 1
        high = np.concatenate((np.packbits(flags, bitorder="little").view(_U), np.zeros(2, _U)))
        blocks = -(-len(high) // _BLOCK)
        counts = np.zeros(blocks * _BLOCK, np.int64)
        counts[: len(high)] = np.bitwise_count(high)
        kind = np.uint32 if size < 1 << 31 else _U
        ones = np.concatenate(([0], np.cumsum(counts.reshape(blocks, _BLOCK).sum(1))[:-1]))
        zeros = (np.arange(blocks) * (64 * _BLOCK) - ones).astype(kind)
        ones = ones.astype(kind)
        return cls(np.array([n, bits], np.int64), _pack(values, bits), high, zeros, ones)

    def save(self, folder: str, name: str) -> None:
        save(folder, f"{name}-low", self.low)
        save(folder, f"{name}-high", self.high)
        save(folder, f"{name}-zeros", self.zeros)
        save(folder, f"{name}-ones", self.ones)
        save(folder, f"{name}-meta", np.array([self.n, self.bits], np.int64))

    @classmethod
    def open(cls, folder: str, name: str) -> EliasFano:
        return cls(*(load(folder, f"{name}-{part}") for part in ("meta", "low", "high", "zeros", "ones")))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), _U)
        place = at * self.bits
        word, shift = place >> 6, (place & 63).astype(_U)
        both = (self.low[word] >> shift) | ((self.low[word + 1] << (_U(63) - shift)) << _U(1))
        return both & _U((1 << self.bits) - 1)

    def _select(self, which: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """The place of the set bit (``flip``: clear bit) that ``which`` others stand before."""
        block = np.searchsorted(before, which.astype(before.dtype), side="right") - 1
        rest = which - before[block].astype(np.int64)
        word = block * _BLOCK
        for k in range(_BLOCK):
            own = ~self.high[word] if flip else self.high[word]
            if k < _BLOCK - 1:
                have = np.bitwise_count(own).astype(np.int64)
                more = have <= rest
                rest -= have * more
                word += more
        return (word << 6) + _in_word(own, rest)

    def _zero_after(self, place: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The first clear bit after each place, which is clear bit number ``which``; mostly it is in the same word."""
        word = (place + 1) >> 6
        own = ~self.high[word] & (~_U(0) << ((place + 1) & 63).astype(_U))
        at = (word << 6) + np.bitwise_count((own & (~own + _U(1))) - _U(1)).astype(np.int64)
        far = np.flatnonzero(own == 0)
        at[far] = self._select(which[far], self.zeros, True)
        return at

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at these places."""
        at = np.asarray(at, np.int64)
        return ((self._select(at, self.ones, False) - at).astype(_U) << _U(self.bits)) | self._low(at)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value that is not less, and whether it is equal."""
        values = np.asarray(values, _U)
        at, same = np.full(len(values), self.n, np.int64), np.zeros(len(values), bool)
        if not self.n:
            return at, same
        top = int(self.get(np.array([self.n - 1]))[0])
        some = np.flatnonzero(values <= _U(top))
        high = (values[some] >> _U(self.bits)).astype(np.int64)
        low = values[some] & _U((1 << self.bits) - 1)
        before = np.full(len(some), -1, np.int64)  # the zero that ends the high part before
        inner = np.flatnonzero(high > 0)
        before[inner] = self._select(high[inner] - 1, self.zeros, True)
        end = self._zero_after(before, high) - high
        left, right = before + 1 - high, end.copy()
        open_ = np.flatnonzero(left < right)
        while len(open_):
            mid = (left[open_] + right[open_]) >> 1
            less = self._low(mid) < low[open_]
            left[open_[less]] = mid[less] + 1
            right[open_[~less]] = mid[~less]
            open_ = open_[left[open_] < right[open_]]
        at[some] = left
        inside = left < end
        same[some[inside]] = self._low(left[inside]) == low[inside]
        return at, same
