"""Elias-Fano sequences and a two-level n-gram trie over memory-mapped arrays, for many lookups at once."""

from __future__ import annotations

import os
import tempfile

import numpy as np

# For every byte and k: the place of its k-th one (lowest bit first).
_SELECT = np.zeros((256, 8), dtype=np.uint8)
for _byte in range(256):
    _ones = [b for b in range(8) if _byte >> b & 1]
    _SELECT[_byte, :len(_ones)] = _ones
_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8))


class Bits:
    """A bit vector with select for ones and zeros: running counts per 64-bit word, then a table per byte."""

    def __init__(self, words: np.ndarray, ones: np.ndarray) -> None:
        self.words, self.ones = words, ones

    @staticmethod
    def arrays(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The words with ones at the places, and the number of ones before each word."""
        flags = np.zeros((length // 64 + 1) * 64, dtype=np.uint8)
        flags[places] = 1
        words = np.packbits(flags, bitorder="little").view("<u8")
        return words, np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    def select(self, k: np.ndarray, zeros: bool = False) -> np.ndarray:
        """The place of the k-th (from 0) one or zero."""
        before = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones if zeros else self.ones
        word = np.searchsorted(before, k, side="right") - 1
        rest = (k - before[word]).astype(np.int64)
        value = self.words[word]
        octets = np.ascontiguousarray(~value if zeros else value).view(np.uint8).reshape(-1, 8)
        reached = np.cumsum(_ONES[octets], axis=1, dtype=np.int64)
        octet = (reached <= rest[:, None]).sum(axis=1)
        at = np.arange(len(k))
        rest -= np.where(octet > 0, reached[at, np.maximum(octet - 1, 0)], 0)
        return word * 64 + octet * 8 + _SELECT[octets[at, octet], rest]


class EliasFano:
    """A non-decreasing sequence below `universe`: low bits packed, high bits as a unary bit vector."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: Bits) -> None:
        self.n, self.low_bits, self.high = n, low_bits, high
        # Every byte offset read as a little-endian 64-bit number.
        self._windows = np.lib.stride_tricks.as_strided(low[:8].view("<u8"), (len(low) - 7,), (1,))
        self._mask = np.uint64((1 << low_bits) - 1)

    @staticmethod
    def arrays(values: np.ndarray, universe: int) -> tuple[int, list[np.ndarray]]:
        """Width of the low part, and the arrays to store: low bytes, high words, high counts."""
        n = len(values)
        width = min(48, max(0, (universe // max(n, 1)).bit_length() - 1))
        low = np.zeros(n * width // 8 + 16, dtype=np.uint8)
        if n and width:
            packed = [np.packbits((values[s:s + 65536, None] >> np.arange(width)) .astype(np.uint8) & 1, bitorder="little")
                      for s in range(0, n, 65536)]
            joined = np.concatenate(packed)
            low[:len(joined)] = joined
        words, ones = Bits.arrays((values >> width) + np.arange(n), n + (universe >> width) + 1)
        return width, [low, words, ones]

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        offset = i * self.low_bits
        return (self._windows[offset >> 3] >> (offset & 7).astype(np.uint64)) & self._mask

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.high.select(i) - i) << self.low_bits) | self.low(i).astype(np.int64)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The place of each value, -1 where it is missing: its high part names a run, whose low parts are
        searched for the successor, inside [begin, end) where given."""
        top = x >> self.low_bits
        lo = np.where(top > 0, self.high.select(np.maximum(top - 1, 0), zeros=True) - (top - 1), 0)
        hi = self.high.select(top, zeros=True) - top
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        hi = np.maximum(lo, hi)
        stop, want = hi.copy(), x.astype(np.uint64) & self._mask
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            less = self.low(middle) < want[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
            open_ = open_[lo[open_] < hi[open_]]
        inside = lo < stop
        hit = np.full(len(x), -1, dtype=np.int64)
        at = np.flatnonzero(inside)
        same = self.low(lo[at]) == want[at]
        hit[at[same]] = lo[at[same]]
        return hit


class Trie:
    """Contexts, pointers to the range of their successors, successors and codes, in one memory-mapped file.

    Level one holds the contexts that occur; pointers are monotone; a successor is stored relative to its
    context (context number * number of words + word), which makes level two monotone as well.
    """

    # Lookups at a time: select spreads every one over some eight numbers.
    SLAB = 1 << 16

    def __init__(self, context: np.ndarray, word: np.ndarray, code: np.ndarray, contexts: int, words: int) -> None:
        """Entries sorted by (context, word), without repeats; contexts and words are numbers below the totals."""
        self._words = words
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, dtype=np.int64)
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
        levels = [EliasFano.arrays(context[first], contexts), EliasFano.arrays(np.append(first, len(context)), len(context) + 1),
                  EliasFano.arrays(number * words + word, max(1, len(first)) * words)]
        counts = [len(first), len(first) + 1, len(context)]
        arrays = [a for _, parts in levels for a in parts] + [code]
        handle, path = tempfile.mkstemp(suffix=".trie")
        try:
            with os.fdopen(handle, "wb") as out:
                places = []
                for a in arrays:
                    out.write(b"\0" * (-out.tell() % 64))
                    places.append(out.tell())
                    out.write(a.tobytes())
            mapped = [np.memmap(path, dtype=a.dtype, mode="r", offset=p, shape=a.shape) if a.size else a for a, p in zip(arrays, places)]
        finally:
            # The mapping keeps the data; the name need not outlive it.
            os.unlink(path)
        sequences = [EliasFano(n, width, low, Bits(high, ones))
                     for n, (width, _), low, high, ones in zip(counts, levels, mapped[0:9:3], mapped[1:9:3], mapped[2:9:3])]
        self.contexts, self.pointers, self.successors = sequences
        self.codes = mapped[9]
        self.bytes = sum(a.nbytes for a in arrays)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of every (context, word), 0 where the pair is missing."""
        out = np.zeros(len(context), dtype=self.codes.dtype)
        if not self.successors.n:
            return out
        for s in range(0, len(context), self.SLAB):
            number = self.contexts.find(context[s:s + self.SLAB])
            known = np.flatnonzero(number >= 0)
            number = number[known]
            place = self.successors.find(number * self._words + word[s:s + self.SLAB][known],
                                         self.pointers.get(number), self.pointers.get(number + 1))
            out[s + known[place >= 0]] = self.codes[place[place >= 0]]
        return out
