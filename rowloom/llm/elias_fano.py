"""Elias-Fano coded sequences over arrays, with batched queries.

A monotone sequence of n integers below u is split into low parts of l bits,
packed one after another, and high parts, coded in unary: bit (high + index) is
one for each element.  About 2 + log2(u / n) bits an element.  All queries take
and return arrays; the parts are plain arrays, so they can be memory-mapped.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: One sample for each so many zeros or ones of the high bits.
STEP = 64
#: Items of a query that go through its steps together; their arrays stay in the processor's cache.
CHUNK = 1 << 14


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``values`` below 2**bits, packed into 64-bit words (one spare word at the end)."""
    out = np.zeros((len(values) * bits + 63) // 64 + 1, U64)
    if bits and len(values):
        at = np.arange(len(values), dtype=U64) * U64(bits)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        np.bitwise_or.at(out, word, values << shift)
        over = shift + U64(bits) > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (U64(64) - shift[over]))
    return out


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the (k + 1)th one of each word."""
    place = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count((word >> place.astype(U64)) & U64((1 << width) - 1)).astype(np.int64)
        skip = k >= ones
        place += skip * width
        k = k - skip * ones
    return place


class Sequences:
    """Monotone sequences side by side: ``words`` and ``halves`` (of 64 and 32 bits) hold the arrays of all of them.

    Queries give the number of the sequence for each item, so one call reaches many sequences.
    """

    def __init__(self, words: np.ndarray, halves: np.ndarray, n: np.ndarray, bits: np.ndarray, places: dict[str, np.ndarray], lengths: dict[str, np.ndarray]) -> None:
        self.words, self.halves, self.n, self.bits = words, halves, n, bits.astype(U64)
        self.places, self.lengths = places, lengths

    def _low(self, which: np.ndarray, index: np.ndarray) -> np.ndarray:
        bits = self.bits[which]
        at = index.astype(U64) * bits
        word, shift = self.places["low"][which] + (at >> U64(6)).astype(np.int64), at & U64(63)
        low = self.words[word] >> shift
        # Shifting in two steps keeps a shift of 64 from being undefined.
        high = (self.words[word + 1] << U64(1)) << (U64(63) - shift)
        return (low | high) & ((U64(1) << bits) - U64(1))

    def _before(self, which: np.ndarray, word: np.ndarray, ones: bool) -> np.ndarray:
        """Number of ones or zeros before each word."""
        rank = self.halves[self.places["rank"][which] + word].astype(np.int64)
        return rank if ones else word * 64 - rank

    def _select(self, which: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
        """Bit position of the (k + 1)th one or zero."""
        samples = "ones" if ones else "zeros"
        part = k // STEP
        first, size = self.places[samples][which] + part, self.lengths[samples][which]
        word = self.halves[first].astype(np.int64)
        last = part + 1 >= size
        after = np.where(last, self.lengths["high"][which] - 1, self.halves[np.where(last, first, first + 1)])
        # The last word with at most k before it, by halves: a run of ones can be long.
        left = np.flatnonzero(word < after)
        own, low, top, want = which[left], word[left], after[left], k[left]
        while len(left):
            mid = (low + top + 1) >> 1
            enough = self._before(own, mid, ones) <= want
            low, top = np.where(enough, mid, low), np.where(enough, top, mid - 1)
            done = low >= top
            word[left[done]] = low[done]
            go = ~done
            left, own, low, top, want = left[go], own[go], low[go], top[go], want[go]
        before = self._before(which, word, ones)
        bits = self.words[self.places["high"][which] + word]
        return word * 64 + _select_in_word(bits if ones else ~bits, k - before)

    def access(self, which: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Elements at ``index``."""
        return self._chunked(self._access, which, index, np.zeros(len(index), U64))

    def find(self, which: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where the sequence has no such element."""
        return self._chunked(self._find, which, values, np.zeros(len(values), np.int64))

    def _chunked(self, query, which: np.ndarray, asked: np.ndarray, out: np.ndarray) -> np.ndarray:
        for a in range(0, len(asked), CHUNK):
            out[a : a + CHUNK] = query(which[a : a + CHUNK], asked[a : a + CHUNK])
        return out

    def _access(self, which: np.ndarray, index: np.ndarray) -> np.ndarray:
        high = self._select(which, index, True) - index
        return (high.astype(U64) << self.bits[which]) | self._low(which, index)

    def _find(self, which: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), -1, np.int64)
        some = np.flatnonzero(self.n[which] > 0)
        if not len(some):
            return out
        which, values = which[some], values[some]
        bits = self.bits[which]
        high = (values >> bits).astype(np.int64)
        low = values & ((U64(1) << bits) - U64(1))
        # Elements with this high part are at begin .. end - 1.  Low parts rise
        # there, and a dense context puts many into one part: search by halves.
        at = np.zeros(len(values), np.int64)
        later = np.flatnonzero(high)
        at[later] = self._select(which[later], high[later] - 1, False) + 1
        begin = at - high
        # The ones from there on: mostly they end in the same word.
        room = 64 - (at & 63)
        word = self.words[self.places["high"][which] + (at >> 6)] >> (at & 63).astype(U64)
        with np.errstate(over="ignore"):
            ones = np.bitwise_count(word ^ (word + U64(1))).astype(np.int64) - 1
        ones[word == ~U64(0)] = 64
        end = begin + ones
        longer = np.flatnonzero(ones >= room)
        end[longer] = self._select(which[longer], high[longer], False) - high[longer]
        left = np.flatnonzero(begin < end)
        which, begin, end, low = which[left], begin[left], end[left], low[left]
        left = some[left]
        while len(left):
            mid = (begin + end) >> 1
            got = self._low(which, mid)
            hit = got == low
            out[left[hit]] = mid[hit]
            begin, end = np.where(got < low, mid + 1, begin), np.where(got > low, mid, end)
            go = ~hit & (begin < end)
            left, which, begin, end, low = left[go], which[go], begin[go], end[go], low[go]
        return out


class Sequence:
    """One monotone sequence, as a dictionary of arrays and two numbers."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        places, lengths, joined = {}, {}, []
        for names in (("low", "high"), ("rank", "ones", "zeros")):
            ends = np.cumsum([0, *(len(parts[x]) for x in names)])
            places |= {x: ends[i : i + 1] for i, x in enumerate(names)}
            lengths |= {x: np.diff(ends)[i : i + 1] for i, x in enumerate(names)}
            joined.append(np.concatenate([parts[x] for x in names]))
        self.all = Sequences(*joined, *parts["shape"].reshape(2, 1), places, lengths)

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        values = values.astype(U64)
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        highs = (values >> U64(bits)).astype(np.int64)
        size = n + int((max(universe, 1) - 1) >> bits) + 2
        flags = np.zeros((size + 63) // 64 * 64, bool)
        flags[highs + np.arange(n)] = True
        high = np.packbits(flags, bitorder="little").view(U64)
        count = np.bitwise_count(high).astype(np.int64)
        rank = np.concatenate([[0], np.cumsum(count)]).astype(np.uint32)
        ends = {"ones": np.cumsum(count), "zeros": np.cumsum(64 - count)}
        samples = {k: np.searchsorted(e, np.arange(0, int(e[-1]), STEP), side="right").astype(np.uint32) for k, e in ends.items()}
        return {"shape": np.array([n, bits], np.int64), "low": pack(values & U64((1 << bits) - 1), bits), "high": high, "rank": rank, **samples}

    def access(self, index: np.ndarray) -> np.ndarray:
        return self.all.access(np.zeros(len(index), np.int64), index)

    def find(self, values: np.ndarray) -> np.ndarray:
        return self.all.find(np.zeros(len(values), np.int64), values)
