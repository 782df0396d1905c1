"""One level of a trie in Elias-Fano form: unary monotone pointers, packed children, searched many at a time."""

from __future__ import annotations

import os
from uuid import uuid4

import numpy as np

_SELECT = np.array([[next((p for p in range(8) if not b >> p & 1 and sum(not b >> q & 1 for q in range(p)) == k), 8) for k in range(8)] for b in range(256)], np.uint8)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Whole numbers of so many bits, end to end in 64-bit words, one word to spare."""
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    v = values.astype(np.uint64)
    np.bitwise_or.at(out, word, v << shift)
    over = shift + np.uint64(bits) > np.uint64(64)
    np.bitwise_or.at(out, word[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
    return out


def unpack(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    bit = at * bits
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((low | high) & np.uint64((1 << bits) - 1)).astype(np.int64)


class Level:
    """Children of the nodes first..first+nodes-1 of the level above.

    pointers: for each node a one per child and then a zero; ranks: zeros
    before each word. children: the words, ascending within a node.
    prob and back: quantised log10 of a child's probability and of a node's
    share for words it lacks.
    """

    NAMES = ("pointers", "ranks", "children", "prob", "back")

    def __init__(self, first: int, bits: int, pointers, ranks, children, prob, back) -> None:
        self.first, self.bits = first, bits
        self.pointers, self.ranks, self.children, self.prob, self.back = pointers, ranks, children, prob, back

    @classmethod
    def build(cls, first: int, degrees: np.ndarray, children: np.ndarray, bits: int, prob: np.ndarray, back: np.ndarray) -> Level:
        total = len(children) + len(degrees)
        ends = np.cumsum(degrees) + np.arange(len(degrees))
        flags = np.ones(-(-(total + 65) // 64) * 64, np.uint8)
        flags[ends] = 0
        pointers = np.packbits(flags, bitorder="little").view(np.uint64)
        ranks = np.concatenate((np.zeros(1, np.int64), np.cumsum(64 - np.bitwise_count(pointers).astype(np.int64))))
        return cls(first, bits, pointers, ranks, pack(children, bits), prob, back)

    def save(self, stem: str) -> None:
        """Write the parts under a name of this attempt, then move them: a repeated task changes nothing."""
        for name in self.NAMES:
            part = f"{stem}.{name}.{uuid4().hex}.npy"
            np.save(part, getattr(self, name))
            os.replace(part, f"{stem}.{name}.npy")

    @classmethod
    def map(cls, stem: str, first: int, bits: int) -> Level:
        return cls(first, bits, *(np.load(f"{stem}.{name}.npy", mmap_mode="r").view(np.ndarray) for name in cls.NAMES))

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of pointers, k ascending: by rank to the word, by halves to the byte, by table to the bit."""
        word = np.searchsorted(self.ranks, k, "right") - 1
        left = k - self.ranks[word]
        bits = self.pointers[word]
        place = word << 6
        for width in (32, 16, 8):
            zeros = width - np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            later = left >= zeros
            left -= zeros * later
            place += width * later
            bits = bits >> (np.uint64(width) * later.astype(np.uint64))
        return place + _SELECT[(bits & np.uint64(255)).astype(np.int64), left]

    def ranges(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of these nodes (counted from first, ascending) begin and end."""
        before = np.where(node > 0, self._zero(np.maximum(node - 1, 0)), -1)
        start = before + 1
        rest = ~(self.pointers[start >> 6] >> (start & 63).astype(np.uint64))
        run = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        end = start + run
        far = np.flatnonzero(run >= 64 - (start & 63))
        if len(far):
            end[far] = self._zero(node[far])
        return start - node, end - node

    def child(self, at: np.ndarray) -> np.ndarray:
        return unpack(self.children, self.bits, at)

    def find(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of the word among its node's children, -1 where it is none: a successor search within the node. Nodes ascend."""
        runs = np.flatnonzero(np.concatenate((np.ones(min(1, len(node)), bool), node[1:] != node[:-1])))
        begin, end = self.ranges(node[runs])
        asked = np.diff(np.append(runs, len(node)))
        low, stop = np.repeat(begin, asked), np.repeat(end, asked)
        last = stop - 1
        # a node that is asked for much is unpacked once; for the others every search goes on its own
        for k in np.flatnonzero((asked >= 64) & (end - begin <= 48 * asked)).tolist():
            own = slice(runs[k], runs[k] + asked[k])
            low[own] += np.searchsorted(self.child(np.arange(begin[k], end[k])), word[own])
            last[own] = low[own]
        at = np.flatnonzero(low < last)
        a, b, w = low[at], last[at], word[at]
        while len(at):
            middle = (a + b) >> 1
            less = self.child(middle) < w
            a = np.where(less, middle + 1, a)
            b = np.where(less, b, middle)
            more = a < b
            done = ~more
            low[at[done]] = a[done]
            at, a, b, w = at[more], a[more], b[more], w[more]
        out = np.full(len(node), -1, np.int64)
        inside = np.flatnonzero(low < stop)
        there = low[inside]
        hit = self.child(there) == word[inside]
        out[inside[hit]] = there[hit]
        return out
