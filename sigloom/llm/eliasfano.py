"""Elias-Fano coding of non-decreasing integers: low bits packed, high bits in unary, sampled select."""

from __future__ import annotations

import struct

import numpy as np

#: A select sample is kept for every so many values, as a 32-bit bit position.
SAMPLE = 64
_HEAD = struct.Struct("<IBq")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """About 2 + log2(range / n) bits a value; ``select(i)`` gives value i, ``decode()`` all of them."""

    def __init__(self, n: int, width: int, base: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.base, self.low, self.high, self.samples = n, width, base, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """``values``: int64, non-decreasing; fewer than 2^31 of them."""
        n = len(values)
        if not n:
            return cls(0, 0, 0, *[np.zeros(0, np.uint8)] * 2, np.zeros(0, np.uint32))
        base = int(values[0])
        v = values.astype(np.uint64) - np.uint64(base % (1 << 64))  # the difference is right modulo 2^64
        width = max(0, (int(v[-1]) // n).bit_length() - 1)
        bits = np.unpackbits(v.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :width]
        at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1, np.uint8)
        high[at] = 1
        return cls(n, width, base, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"),
                   at[::SAMPLE].astype(np.uint32))

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.width:
            return np.zeros(count, np.int64)
        a, b = first * self.width, (first + count) * self.width
        bits = np.unpackbits(self.low[a // 8:(b + 7) // 8], bitorder="little")[a % 8:a % 8 + b - a]
        return bits.reshape(count, self.width).astype(np.int64) @ (np.int64(1) << np.arange(self.width))

    def select(self, i: int) -> int:
        """Value number ``i``: jump to the sample before it, then count ones byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> at % 8 << at % 8
        while left >= _ONES[word]:
            left -= int(_ONES[word])
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        at = 8 * byte + (word & -word).bit_length() - 1
        return self.base + (at - i << self.width) + int(self._lows(i, 1)[0])

    def decode(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return self.base + (at - np.arange(self.n) << self.width) + self._lows(0, self.n)

    def to_bytes(self) -> bytes:
        return b"".join([_HEAD.pack(self.n, self.width, self.base), struct.pack("<II", len(self.low), len(self.high)),
                         self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, width, base = _HEAD.unpack_from(raw)
        a, b = struct.unpack_from("<II", raw, _HEAD.size)
        at = _HEAD.size + 8
        return cls(n, width, base, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a),
                   np.frombuffer(raw, "<u4", offset=at + a + b))
