"""Elias-Fano coded monotone sequences in numpy arrays: about log2(universe / n) + 2 bits a value, without decoding.

A value's low bits are packed; its high part is the number of zeros before its one in a bit vector. A count of ones
before each 64-bit word is the only directory. All look-ups take arrays.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits side by side, one spare word at the end."""
    out = []
    for lo in range(0, len(values), 1 << 16):                          # 65,536 values fill whole words at any width
        part = np.ascontiguousarray(values[lo:lo + (1 << 16)], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width].ravel()
        out.append(np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)]), bitorder="little").view("<u8"))
    return np.concatenate([*out, np.zeros(1, "<u8")])


def unpack(words: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(i), U)
    p = i.astype(U) * U(width)
    w, o = (p >> U(6)).astype(np.int64), p & U(63)
    v = words[w] >> o
    over = o > U(64 - width)
    v[over] |= words[w[over] + 1] << (U(64) - o[over])
    return v & U((1 << width) - 1)


def nth_bit(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the n-th set bit (from 0) of each word, by halving."""
    at, n = np.zeros(len(words), np.int64), n.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = (words >> at.astype(U)) & U((1 << half) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        right = n >= ones
        n -= np.where(right, ones, 0)
        at += np.where(right, half, 0)
    return at


class EliasFano:
    """``build`` gives named arrays; the object reads them, mapped or not."""

    @staticmethod
    def build(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
        n = len(values)
        low = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        v = values.astype(U)
        high = (v >> U(low)).astype(np.int64) + np.arange(n)
        words = (n + (universe >> low)) // 64 + 2
        bits = np.zeros(words * 64, np.uint8)
        bits[high] = 1
        bits = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)]).astype(np.uint32)
        return {f"{name}.size": np.array([n, low], np.int64), f"{name}.low": pack(v & U((1 << low) - 1), low) if low else np.zeros(1, U),
                f"{name}.high": bits, f"{name}.ones": ones}

    def __init__(self, arrays: dict, name: str):
        self.n, self.width = (int(x) for x in arrays[f"{name}.size"])
        self.low, self.high, self.ones = (arrays[f"{name}.{k}"] for k in ("low", "high", "ones"))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        w = np.searchsorted(self.ones, i, side="right") - 1
        at = w * 64 + nth_bit(self.high[w], i - self.ones[w])
        return ((at - i).astype(U) << U(self.width)) | unpack(self.low, i, self.width)

    def before_bucket(self, h: np.ndarray) -> np.ndarray:
        """Number of values whose high part is less than h: ones before the h-th zero."""
        out = np.zeros(len(h), np.int64)
        some = np.flatnonzero(h > 0)
        k = h[some] - 1
        w = np.searchsorted(self.zeros, k, side="right") - 1
        out[some] = w * 64 + nth_bit(~self.high[w], k - self.zeros[w]) - k
        return out

    def place(self, v: np.ndarray, least: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, or -1: a search of the low bits inside the value's bucket (and in [least, most))."""
        v = v.astype(U)
        h = (v >> U(self.width)).astype(np.int64)
        lo, hi = self.before_bucket(h), self.before_bucket(h + 1)
        if least is not None:
            lo, hi = np.maximum(lo, least), np.minimum(hi, most)
        end, want = hi.copy(), v & U((1 << self.width) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = unpack(self.low, mid, self.width) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        out = np.full(len(v), -1, np.int64)
        ok = np.flatnonzero(lo < end)
        ok = ok[unpack(self.low, lo[ok], self.width) == want[ok]]
        out[ok] = lo[ok]
        return out
