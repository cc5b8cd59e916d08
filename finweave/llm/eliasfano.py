"""Elias-Fano code of a rising sequence of integers, with a select structure.

``n`` values below ``u`` take about ``n * (2 + log2(u / n))`` bits: the low bits of each value are
packed, the high parts are unary gaps in a bit vector.  Value ``i`` is found by the place of the
``i``-th one bit; every ``SAMPLE``-th such place is kept in 32 bits relative to nothing but the
vector's start, so a lookup scans a bounded piece.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
#: Values whose low bits are laid out at once.
PIECE = 65_536
HEAD = struct.Struct("<QQqBxxxQQ")


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing int64 sequence; the smallest value is kept apart as base."""
    values = np.asarray(values, dtype=np.int64)
    n = len(values)
    base = int(values[0]) if n else 0
    rel = (values - base).astype(np.uint64)
    u = int(rel[-1]) + 1 if n else 1
    low_bits = max(0, (u // n).bit_length() - 1) if n else 0
    high = (rel >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    bits[high] = 1
    upper = np.packbits(bits, bitorder="little").tobytes()
    if low_bits:
        # A piece is a multiple of 8 values, so each ends at a whole byte.
        places = np.arange(low_bits, dtype=np.uint64)[None, :]
        pieces = (((rel[a : a + PIECE, None] >> places) & np.uint64(1)).astype(np.uint8).ravel() for a in range(0, n, PIECE))
        lower = b"".join(np.packbits(p, bitorder="little").tobytes() for p in pieces)
    else:
        lower = b""
    samples = high[::SAMPLE].astype("<u4").tobytes()
    return HEAD.pack(n, u, base, low_bits, len(lower), len(upper)) + lower + upper + samples


class EliasFano:
    """Random access to an encoded sequence; the whole sequence is never laid out."""

    def __init__(self, data: bytes | memoryview) -> None:
        self.n, self.u, self.base, self.low_bits, lower, upper = HEAD.unpack_from(data, 0)
        at = HEAD.size
        self.lower = np.frombuffer(data, np.uint8, lower, at)
        self.upper = np.frombuffer(data, np.uint8, upper, at + lower)
        self.samples = np.frombuffer(data, "<u4", -(-self.n // SAMPLE), at + lower + upper)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def slice(self, a: int, b: int) -> np.ndarray:
        """Values ``a`` to ``b - 1`` as int64; only their part of the vectors is unpacked."""
        b = min(b, self.n)
        if a >= b:
            return np.zeros(0, np.int64)
        first = a // SAMPLE
        begin = int(self.samples[first])
        last = (b - 1) // SAMPLE + 1
        end = int(self.samples[last]) if last < len(self.samples) else len(self.upper) * 8
        bits = np.unpackbits(self.upper[begin // 8 : -(-(end + 1) // 8)], bitorder="little")
        ones = np.flatnonzero(bits) + (begin // 8) * 8
        ones = ones[ones >= begin]
        skip = a - first * SAMPLE
        places = ones[skip : skip + (b - a)]
        high = places - np.arange(a, b)
        out = high.astype(np.int64) << self.low_bits
        if self.low_bits:
            start = a * self.low_bits
            stop = b * self.low_bits
            low = np.unpackbits(self.lower[start // 8 : -(-stop // 8)], bitorder="little")[start - (start // 8) * 8 :][: stop - start]
            out |= (low.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return out + self.base

    @property
    def n_bytes(self) -> int:
        return HEAD.size + self.lower.nbytes + self.upper.nbytes + self.samples.nbytes
