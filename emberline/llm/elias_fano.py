"""Elias-Fano sequences and a three-level n-gram trie of them, read from a memory-mapped file."""
from __future__ import annotations

import tempfile
from functools import cached_property

import numpy as np

_PLACE = np.array([[(np.flatnonzero(np.unpackbits(np.uint8(b), bitorder="little")).tolist() + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of non-negative integers: low bits packed, high bits in unary."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
    v = values.astype(np.uint64)
    bits = np.unpackbits(v.astype("<u8").view(np.uint8).reshape(n, 8)[:, :(low + 7) // 8], axis=1, bitorder="little")[:, :low].ravel() if low else np.zeros(0, np.uint8)
    high = np.zeros(n + (top >> low) + 1, np.uint8)
    high[(v >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    a, b = np.packbits(bits, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()
    return np.array([n, low, len(a), len(b)], "<i8").tobytes() + a + b + bytes(8)


class EliasFano:
    """Random access over the encoded bytes. Only a count of ones per eight bytes of the high part is kept beside them.

    A batch that asks for a good part of the sequence decodes all of it once.
    """

    def __init__(self, data: np.ndarray):
        self.n, self.low, a, b = (int(x) for x in data[:32].view("<i8"))
        self.lows, self.highs = data[32:32 + a + 8], data[32 + a:32 + a + b]
        ones = _ONES[self.highs].astype(np.int64)
        self.before = np.concatenate([[0], np.add.reduceat(ones, np.arange(0, len(ones), 8)).cumsum()]) if len(ones) else np.zeros(1, np.int64)
        self.size = 32 + a + b + 8

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low
        first = bit >> 3
        raw = np.zeros(len(i), np.uint64)
        for k in range((self.low + 14) // 8):
            raw |= self.lows[first + k].astype(np.uint64) << np.uint64(8 * k)
        return ((raw >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)).astype(np.int64)

    @cached_property
    def values(self) -> np.ndarray:
        """The whole sequence."""
        i = np.arange(self.n)
        high = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[:self.n] - i
        return (high << self.low) | self._lows(i) if self.low else high

    def _many(self, asked: int) -> bool:
        return asked * 16 >= self.n

    def get(self, i: np.ndarray) -> np.ndarray:
        return self.values[i] if self._many(len(i)) else self.seek(i)

    def seek(self, i: np.ndarray) -> np.ndarray:
        """The values at some places, by the counts and the bytes around each place alone."""
        word = np.searchsorted(self.before, i, "right") - 1
        rest, at = i - self.before[word], word * 8
        for _ in range(7):  # the byte of the word that holds the wanted one
            here = _ONES[self.highs[np.minimum(at, len(self.highs) - 1)]]
            on = rest >= here
            rest, at = np.where(on, rest - here, rest), at + on
        high = at * 8 + _PLACE[self.highs[at], rest] - i
        return (high << self.low) | self._lows(i) if self.low else high

    def successor(self, target: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place in [begin, end) whose value is at least the target (end if none), and whether it is equal."""
        if self.n and self._many(len(target)):
            lo = np.clip(np.searchsorted(self.values, target), begin, np.maximum(begin, end))
            return lo, (lo < end) & (self.values[np.minimum(lo, self.n - 1)] == target)
        lo, hi = begin.copy(), end.copy()
        act = np.flatnonzero(lo < hi)
        while len(act):
            mid = (lo[act] + hi[act]) >> 1
            less = self.seek(mid) < target[act]
            lo[act] = np.where(less, mid + 1, lo[act])
            hi[act] = np.where(less, hi[act], mid)
            act = act[lo[act] < hi[act]]
        hit = lo < end
        equal = np.zeros(len(lo), bool)
        at = np.flatnonzero(hit)
        equal[at] = self.seek(lo[at]) == target[at]
        return lo, equal


def build(v: np.ndarray, w: np.ndarray, codes: np.ndarray) -> bytes:
    """Trie of the sorted, distinct pairs (v, w): contexts, monotone pointers, successors relative to their context, codes.

    The successors of a context are stored as w plus one more than the last value of the context before, so the whole level
    is one increasing sequence.
    """
    start = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    last = w[np.append(start[1:], len(w)) - 1] if len(v) else w
    base = np.concatenate([[0], np.cumsum(last + 1)[:-1]]) if len(v) else np.zeros(0, np.int64)
    level = w + np.repeat(base, np.diff(np.append(start, len(v))))
    parts = [encode(v[start]), encode(np.append(start, len(v))), encode(level)]
    parts = [p + bytes(-len(p) % 8) for p in parts]
    return np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts) + codes.astype(np.uint8).tobytes()


class Trie:
    def __init__(self, data: np.ndarray):
        sizes = data[:24].view("<i8")
        cuts = 24 + np.concatenate([[0], np.cumsum(sizes)])
        self.contexts, self.pointers, self.level = (EliasFano(data[cuts[k]:cuts[k + 1]]) for k in range(3))
        self.codes = data[cuts[3]:]

    def find(self, ctx: np.ndarray, back: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the successors of every context begin in the level; of the pairs (ctx[back], w) the place and whether it is there."""
        if not self.contexts.n or not len(w):
            return np.zeros(len(ctx), np.int64), np.zeros(len(w), np.int64), np.zeros(len(w), bool)
        at, known = self.contexts.successor(ctx, np.zeros(len(ctx), np.int64), np.full(len(ctx), self.contexts.n))
        at = np.minimum(at, self.contexts.n - 1)
        begin, end = self.pointers.get(at), self.pointers.get(at + 1)
        base = np.where(begin > 0, self.level.get(np.maximum(begin - 1, 0)) + 1, 0)
        end = np.where(known, end, begin)
        place, found = self.level.successor(base[back] + w, begin[back], end[back])
        return begin, place, found

    def lookup(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The code of every pair, 0 where it is not in the trie."""
        out = np.zeros(len(v), np.uint8)
        _, place, found = self.find(*np.unique(v, return_inverse=True), w)
        out[found] = self.codes[place[found]]
        return out


def build_third(place: np.ndarray, rank: np.ndarray, codes: np.ndarray, backoffs: np.ndarray) -> bytes:
    """The level below the pairs, from its sorted, distinct entries: the place of the pair that is the context, the rank of the
    last word among the successors of the shorter context, the code. ``backoffs`` has a code for every pair of the level above.

    Pointers run from the pairs; ranks are stored as the successors are in ``build``.
    """
    start = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    last = rank[np.append(start[1:], len(rank)) - 1] if len(place) else rank
    base = np.concatenate([[0], np.cumsum(last + 1)[:-1]]) if len(place) else np.zeros(0, np.int64)
    level = rank + np.repeat(base, np.diff(np.append(start, len(place))))
    pointers = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(backoffs)))])
    parts = [p + bytes(-len(p) % 8) for p in (encode(pointers), encode(level))]
    sizes = np.array([*[len(p) for p in parts], len(codes)], "<i8").tobytes()
    return sizes + b"".join(parts) + codes.astype(np.uint8).tobytes() + backoffs.astype(np.uint8).tobytes()


class Third:
    def __init__(self, data: np.ndarray):
        sizes = data[:24].view("<i8")
        cuts = 24 + np.concatenate([[0], np.cumsum(sizes)])
        self.pointers, self.level = (EliasFano(data[cuts[k]:cuts[k + 1]]) for k in range(2))
        self.codes, self.backoffs = data[cuts[2]:cuts[3]], data[cuts[3]:]

    def lookup(self, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The code of the entry of that rank below the pair at that place, 0 where there is none."""
        out = np.zeros(len(place), np.uint8)
        if not self.level.n or not len(place):
            return out
        begin, end = self.pointers.get(place), self.pointers.get(place + 1)
        base = np.where(begin > 0, self.level.get(np.maximum(begin - 1, 0)) + 1, 0)
        at, found = self.level.successor(base + rank, begin, end)
        out[found] = self.codes[at[found]]
        return out


def mapped(data: bytes, kind=Trie) -> tuple:
    """The trie, or its third level, over an unnamed temporary file that is mapped, not read; closing the returned file frees it."""
    f = tempfile.TemporaryFile()
    f.write(data)
    f.flush()
    return kind(np.memmap(f, np.uint8, "r")), f
