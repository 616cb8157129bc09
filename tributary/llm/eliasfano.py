"""Elias-Fano sequences over flat buffers, and a two-level n-gram trie made of them."""

from __future__ import annotations

import mmap
from functools import cached_property

import numpy as np

#: Bits of a child's key; a level holds context rank and key in one monotone sequence.
KEY_BITS = 40

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: The place of each set bit of a byte.
_PLACE = np.array([[p for p in range(8) if i >> p & 1] + [0] * (8 - bin(i).count("1")) for i in range(256)], np.uint8)
#: Questions that are answered at once.
AT_ONCE = 250_000


_EACH, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _byte_sums(x: np.ndarray) -> np.ndarray:
    """In each byte of a word the set bits up to its end."""
    s = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    return ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH


def _select(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The place of the i-th set bit; before: set bits up to the end of each word."""
    word = np.searchsorted(before, i, "right")
    x = words[word]
    rest = (i - before[word] + np.bitwise_count(x)).astype(np.uint64)
    sums = _byte_sums(x)
    octet = np.bitwise_count((((rest * _EACH) | _HIGH) - sums) & _HIGH).astype(np.uint64)  # bytes whose sum is no more
    shift = octet << np.uint64(3)
    rest -= ((sums << np.uint64(8)) >> shift) & np.uint64(255)
    return word * 64 + (shift + _PLACE[(x >> shift) & np.uint64(255), rest]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of non-negative integers: low bits packed, high bits in unary.

    All state lies in one uint64 array, so a view of a mapped file or buffer is a sequence without a copy.
    """

    HEAD = 4

    def __init__(self, words: np.ndarray):
        self.words = words
        self.n, self.low_bits, n_low, n_high = (int(x) for x in words[: self.HEAD])
        self.low = words[self.HEAD : self.HEAD + n_low]
        self.high = words[self.HEAD + n_low : self.HEAD + n_low + n_high]
        self.size = self.HEAD + n_low + n_high

    @cached_property
    def ones(self) -> np.ndarray:
        """Set bits up to each word of the high part."""
        return np.cumsum(_POPCOUNT[self.high.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.int64))

    @cached_property
    def zeros(self) -> np.ndarray:
        return 64 * np.arange(1, len(self.high) + 1) - self.ones

    @cached_property
    def gaps(self) -> np.ndarray:
        return ~self.high

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at the places, by select on the high part."""
        upper = (_select(self.high, self.ones, i) - i).astype(np.uint64) << np.uint64(self.low_bits)
        return upper | self.low_at(i)

    def low_at(self, i: np.ndarray) -> np.ndarray:
        """The low bits of the values at the places."""
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        part = self.low[word] >> shift
        part |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return part & np.uint64((1 << self.low_bits) - 1)

    def stretch(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values with each one's high bits begin and end."""
        top = (values >> np.uint64(self.low_bits)).astype(np.int64)
        there = int(self.zeros[-1]) if len(self.high) else 0

        def ends(k: np.ndarray) -> np.ndarray:
            inside = (k >= 0) & (k < there)
            place = _select(self.gaps, self.zeros, np.where(inside, k, 0)) if there else np.zeros(len(k), np.int64)
            return np.where(k < 0, 0, np.where(inside, np.minimum(place - k, self.n), self.n))

        return ends(top - 1), ends(top)

    def successor(self, values: np.ndarray, low: np.ndarray, high: np.ndarray, at=None) -> np.ndarray:
        """The first place from low on, below high, whose value (by at) isn't smaller; high if there is none."""
        at = at or self.at
        low, high = low.copy(), high.copy()
        left = np.flatnonzero(low < high)
        while len(left):
            middle = (low[left] + high[left]) >> 1
            less = at(middle) < values[left]
            low[left] = np.where(less, middle + 1, low[left])
            high[left] = np.where(less, high[left], middle)
            left = left[low[left] < high[left]]
        return low

    def find(self, values: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """The place of each value from low on, below high, or -1.

        A single place is looked at; else the search is among the places with the value's high bits, by the low ones.
        """
        out = np.full(len(values), -1, np.int64)
        many = np.arange(len(values))
        if low is not None:
            one = np.flatnonzero(high - low == 1)
            same = one[self.at(low[one]) == values[one]] if len(one) else one
            out[same] = low[same]
            many = np.flatnonzero(high - low > 1)
        if len(many):
            wanted = values[many]
            start, stop = self.stretch(wanted)
            if low is not None:
                start, stop = np.maximum(start, low[many]), np.minimum(stop, high[many])
            part = wanted & np.uint64((1 << self.low_bits) - 1)
            place = self.successor(part, start, np.maximum(start, stop - 1), self.low_at)  # the last one is looked at here
            inside = np.flatnonzero(start < stop)
            same = inside[self.low_at(place[inside]) == part[inside]]
            out[many[same]] = place[same]
        return out

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n and np.any(values[1:] < values[:-1]):
            raise ValueError("the values must not decrease")
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = shift + np.uint64(bits) > 64  # the last one of a word at most
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((int(place[-1]) if n else 0) // 64 + 1) * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        return cls(np.concatenate([np.array([n, bits, len(low), len(high)], np.uint64), low, high]))

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The values from start to stop; reads the high bits of the words that hold them."""
        stop = self.n if stop is None else stop
        if stop <= start:
            return np.zeros(0, np.uint64)
        ones = self.ones
        first, last = int(np.searchsorted(ones, start, "right")), int(np.searchsorted(ones, stop - 1, "right"))
        before = int(ones[first - 1]) if first else 0
        place = np.flatnonzero(np.unpackbits(self.high[first : last + 1].view(np.uint8), bitorder="little"))[start - before : stop - before]
        index = np.arange(start, stop, dtype=np.uint64)
        upper = (place.astype(np.uint64) + np.uint64(first * 64) - index) << np.uint64(self.low_bits)
        if not self.low_bits:
            return upper
        at = index * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        part = self.low[word] >> shift
        spill = shift > np.uint64(64 - self.low_bits)
        part[spill] |= self.low[word[spill] + 1] << (np.uint64(64) - shift[spill])
        return upper | (part & np.uint64((1 << self.low_bits) - 1))


class Trie:
    """Contexts, pointers to their children, children's keys and one-byte probabilities, in one mapped buffer.

    Level one is the sorted context keys. Level two holds, for each context by rank, its children's sorted keys; rank
    and key together never decrease, so one sequence holds the level. Pointers say where a context's children begin.
    """

    def __init__(self, buffer):
        words = np.frombuffer(buffer, np.uint64)
        n_parts = int(words[0])
        at, self.parts = 1, []
        for _ in range(n_parts):
            self.parts.append(EliasFano(words[at:]))
            at += self.parts[-1].size
        self.contexts, self.pointers, self.children = self.parts
        n, m = self.contexts.n, self.children.n
        rest = words[at:].view(np.uint8)
        self.backoff, self.probability = rest[:n], rest[n : n + m]

    @classmethod
    def build(cls, contexts: np.ndarray, counts: np.ndarray, keys: np.ndarray, backoff: np.ndarray, probability: np.ndarray) -> Trie:
        """contexts: sorted and distinct; counts: children of each; keys: sorted in each context; codes of one byte."""
        rank = np.repeat(np.arange(len(contexts), dtype=np.uint64), counts)
        parts = [EliasFano.build(x).words for x in (contexts, np.concatenate(([0], np.cumsum(counts))), (rank << np.uint64(KEY_BITS)) | keys.astype(np.uint64))]
        codes = np.concatenate([backoff, probability]).astype(np.uint8)
        codes = np.append(codes, np.zeros(-len(codes) % 8 + 8, np.uint8)).view(np.uint64)
        words = np.concatenate([np.array([len(parts)], np.uint64), *parts, codes])
        level = mmap.mmap(-1, words.nbytes)
        level[:] = words.tobytes()
        return cls(level)

    def find_contexts(self, wanted: np.ndarray) -> np.ndarray:
        """The rank of each wanted context, or -1, by successor search among those of its high bits."""
        wanted, out = wanted.astype(np.uint64), []
        for at in range(0, len(wanted), AT_ONCE):
            part = wanted[at : at + AT_ONCE]
            out.append(self.contexts.find(part))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def bounds(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the contexts' children begin and end, by the pointers; nowhere for rank -1."""
        own = np.maximum(rank, 0).astype(np.int64)
        asked = np.zeros(self.pointers.n + 1, bool)
        asked[own] = asked[own + 1] = True
        asked = np.flatnonzero(asked)  # a pointer is where one context's children end and the next one's begin
        ends = np.zeros(self.pointers.n + 1, np.int64)
        ends[asked] = self.pointers.at(np.minimum(asked, self.pointers.n - 1)).astype(np.int64)
        low, high = ends[own], ends[own + 1]
        return low, np.where(rank >= 0, high, low)

    def find_children(self, rank: np.ndarray, keys: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """The place of each key among the children of context rank[of], or -1, by successor search from its pointer."""
        of = np.arange(len(keys)) if of is None else of
        low, high = self.bounds(rank)
        out = np.full(len(keys), -1, np.int64)
        for at in range(0, len(keys), AT_ONCE):
            own = of[at : at + AT_ONCE]
            wanted = (np.maximum(rank[own], 0).astype(np.uint64) << np.uint64(KEY_BITS)) | keys[at : at + AT_ONCE].astype(np.uint64)
            out[at : at + AT_ONCE] = self.children.find(wanted, low[own], high[own])
        return out
