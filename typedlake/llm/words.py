"""Words and shingles of whole Arrow columns as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in stretches of about this many bytes.
STRETCH = 1 << 21


class Stretch(NamedTuple):
    """Words of the rows first..first+len(counts)-1: a hash each, in order, and how many each row has.

    heads and tails hash the first and last bytes of each word, where the hasher is asked to.
    """

    first: int
    hashes: np.ndarray
    counts: np.ndarray
    heads: np.ndarray | None = None
    tails: np.ndarray | None = None

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.counts)))

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


class WordHasher:
    """Hashes words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. One for each task, for its tables.

    head and tail, up to 8, ask for hashes of the first and last bytes too. With bare, every
    ASCII character but letters and digits separates words, and letters of
    every script are lower-cased.
    """

    def __init__(self, head: int = 0, bare: bool = False, tail: int = 0) -> None:
        self.head, self.tail, self.bare = head, tail, bare
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.kept = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        self.solid = np.ones(256, bool)
        self.solid[[32, 9, 10, 11, 12, 13]] = False
        if bare:
            self.solid[:128] = [chr(c).isalnum() for c in range(128)]

    def stretches(self, column: pa.Array, rows: int = 4096) -> Iterator[Stretch]:
        """The column's words, a few rows at a time; every row comes once."""
        data, offsets = string_bytes(column)
        first = 0
        while first < len(column):
            last = int(np.searchsorted(offsets, offsets[first] + STRETCH, "right")) - 1
            last = min(max(last, first + 1), first + rows, len(column))
            own, cuts = data, offsets[first : last + 1]
            if self.bare:  # the two small letters of a Greek sigma count as one
                own, cuts = string_bytes(pc.replace_substring(pc.utf8_lower(column.slice(first, last - first)), "ς", "σ"))
            yield self._stretch(first, own[cuts[0] : cuts[-1]], cuts - cuts[0])
            first = last

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end; no word runs over the end of a row."""
        solid = self.solid[data]
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        end = solid.copy()
        end[:-1] &= ~solid[1:]
        at = offsets[:-1][offsets[:-1] < len(data)]
        start[at] |= solid[at]
        at = offsets[1:][offsets[1:] > 0] - 1
        end[at] |= solid[at]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def _stretch(self, first: int, data: np.ndarray, offsets: np.ndarray) -> Stretch:
        start, end = self.spans(data, offsets)
        size = end - start
        low = np.zeros(len(data) + 8, np.uint8)
        np.take(self.lower, data, out=low[: len(data)])
        eight = np.ndarray((len(data) + 1,), "<u8", low.data, 0, (1,))  # the eight bytes from every place on
        with np.errstate(over="ignore"):
            hashes = mix64((eight[start] & self.kept[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            done, long = 8, np.flatnonzero(size > 8)
            while len(long):
                more = eight[start[long] + done] & self.kept[np.minimum(size[long] - done, 8)]
                hashes[long] = mix64(hashes[long] * np.uint64(0xD6E8FEB86659FD93) + more)
                done += 8
                long = long[size[long] > done]
        heads = mix64((eight[start] & self.kept[np.minimum(size, self.head)]) + np.uint64(self.head << 56)) if self.head else None
        last = np.minimum(size, self.tail)
        tails = mix64((eight[end - last] & self.kept[last]) + np.uint64(self.tail << 56 | 1 << 55)) if self.tail else None
        return Stretch(first, hashes, np.diff(np.searchsorted(start, offsets)), heads, tails)


def ngrams(stretch: Stretch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash and row of every run of n words; rows with fewer words have none."""
    total = len(stretch.hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.repeat(stretch.starts[1:], stretch.counts)
    whole = np.arange(total) + n <= ends
    with np.errstate(over="ignore"):
        out = np.full(total, np.uint64(n), np.uint64)
        for k in range(n):
            shifted = stretch.hashes[k : total - n + 1 + k]
            out[: total - n + 1] = out[: total - n + 1] * np.uint64(0x9E3779B97F4A7C15) + shifted
    return mix64(out[whole]), stretch.rows[whole]


def shingles(stretch: Stretch, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The n-word shingles with their rows; a row of fewer words has its whole sequence as one."""
    hashes, rows = [], []
    for k in range(1, n + 1):
        own = stretch.counts >= n if k == n else stretch.counts == k
        if own.any():
            h, r = ngrams(stretch, k)
            keep = own[r]
            hashes.append(h[keep])
            rows.append(r[keep])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)
