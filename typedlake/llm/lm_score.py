"""LM scoring with an n-gram trie in Elias-Fano levels, built in shards and memory-mapped.

Each level is counted by one pass over the training texts and one shuffle of
(n-gram, count) arrays, dealt to shards by ranges of the context. A shard's
task smooths its counts and writes its level to the shared folder; scoring
tasks map the files, so what they hold is what they touch. Nothing passes the
driver but one row for each shard.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlparse
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import goes_at_end, shared_dir, shuffle_width
from .elias_fano import Level
from .words import Stretch, WordHasher

#: The token that ends every text.
END = np.uint64(0x5EED0FE0D0FE0D01)
#: Steps of the quantised log10 probabilities: 1/4096, down to -16.
STEPS = 4096
#: A task sends its counts on when it holds so many different ones.
PENDING = 1 << 22
#: Tokens of the training texts for each shard of a level, so that what a task gathers doesn't grow with the corpus.
SHARD = 1 << 22
#: Words that are looked up at once, with one stretch more below a million: their places then fit 20 bits.
GROUP = 600_000


class Shard(NamedTuple):
    """A shard of a level: its number, its first context and first entry, how many of both, and what they count."""

    shard: int
    first: int
    contexts: int
    base: int
    entries: int
    total: int


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-log10 * STEPS), 65_535).astype(np.uint16)


def together(stretches: Iterator[Stretch]) -> Iterator[Stretch]:
    """Neighbouring stretches as one, up to GROUP words: sorted searches then walk the levels in few strides."""
    held: list[Stretch] = []
    for s in stretches:
        held.append(s)
        if sum(len(x.hashes) for x in held) >= GROUP:
            yield Stretch(held[0].first, np.concatenate([x.hashes for x in held]), np.concatenate([x.counts for x in held]))
            held = []
    if held:
        yield Stretch(held[0].first, np.concatenate([x.hashes for x in held]), np.concatenate([x.counts for x in held]))


def with_end(s: Stretch) -> tuple[np.ndarray, np.ndarray]:
    """The stretch's tokens with one END after each row, and the tokens per row."""
    rows = len(s.counts)
    tokens = np.empty(len(s.hashes) + rows, np.uint64)
    tokens[np.arange(len(s.hashes)) + s.rows] = s.hashes
    tokens[s.starts[1:] + np.arange(rows)] = END
    return tokens, s.counts + 1


def order_of(keys: np.ndarray) -> np.ndarray:
    """The order that sorts keys: key and place sorted as one number where both fit 64 bits, which is several times faster."""
    bits = max(1, (len(keys) - 1).bit_length())
    if len(keys) and bits + int(keys.max()).bit_length() <= 64:
        both = np.sort(keys.astype(np.uint64) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64))
        return (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.argsort(keys, kind="stable")


class Trie:
    """The levels written so far, mapped by whoever uses them."""

    def __init__(self, folder: str, order: int) -> None:
        self.folder, self.order = folder, order
        self.levels: list[list[Shard]] = []
        self.open: dict[tuple[int, int], object] = {}

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "order": self.order, "levels": self.levels, "open": {}}

    @property
    def tokens(self) -> int:
        return sum(s.total for s in self.levels[0])

    @property
    def words(self) -> int:
        return sum(s.entries for s in self.levels[0])

    @property
    def bits(self) -> int:
        return max(1, (self.words - 1).bit_length())

    def stem(self, level: int, shard: int) -> str:
        return f"{self.folder}/level{level}-{shard:05d}"

    def vocabulary(self, s: Shard) -> tuple[np.ndarray, np.ndarray]:
        if (1, s.shard) not in self.open:
            self.open[1, s.shard] = tuple(np.load(f"{self.stem(1, s.shard)}.{name}.npy", mmap_mode="r").view(np.ndarray) for name in ("words", "counts"))
        return self.open[1, s.shard]

    def level(self, n: int, s: Shard) -> Level:
        if (n, s.shard) not in self.open:
            self.open[n, s.shard] = Level.map(self.stem(n, s.shard), s.first, self.bits)
        return self.open[n, s.shard]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of words by hash, -1 and 0 where not known."""
        order = order_of(hashes >> np.uint64(20))
        own = hashes[order]
        if len(own) and (own[1:] < own[:-1]).any():
            order = np.argsort(hashes, kind="stable")
            own = hashes[order]
        new = np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1]))
        back = np.empty(len(own), np.int64)
        back[order] = np.cumsum(new) - 1
        own = own[new]
        ids, counts = np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64)
        width = np.uint64(-(-(1 << 64) // len(self.levels[0]))) if len(self.levels[0]) > 1 else None
        for s in self.levels[0]:
            a, b = (0, len(own)) if width is None else np.searchsorted(own // width, [s.shard, s.shard + 1])
            if b > a and s.entries:
                words, seen = self.vocabulary(s)
                at = np.minimum(np.searchsorted(words, own[a:b]), s.entries - 1)
                hit = words[at] == own[a:b]
                ids[a:b][hit] = s.base + at[hit]
                counts[a:b][hit] = seen[at[hit]]
        return ids[back], counts[back]

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.words + 1))

    def find(self, n: int, context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of level n, -1 where there is none, and log10 probabilities; lower: those one level down."""
        known = np.flatnonzero(context >= 0)
        order = known[order_of(context[known])]
        node, words = context[order], word[order]
        found, log = np.full(len(order), -1, np.int64), lower[order]
        for s in self.levels[n - 1]:
            a, b = np.searchsorted(node, [s.first, s.first + s.contexts])
            if b > a:
                level, own = self.level(n, s), node[a:b] - s.first
                at = level.find(own, words[a:b])  # an unknown word, -1, is nobody's child
                hit, share = at >= 0, level.back[own] / -float(STEPS)
                share += log[a:b]
                share[hit] = level.prob[at[hit]] / -float(STEPS)
                log[a:b] = share
                at[hit] += s.base
                found[a:b] = at
        place, out = np.full(len(context), -1, np.int64), lower.copy()
        place[order], out[order] = found, log
        return place, out

    def scored(self, ids: np.ndarray, counts: np.ndarray, new: np.ndarray, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of every token after those before it in its row, and the longest context's entry.

        new: how many tokens of the row stand before it. top: highest level used.
        """
        entry, log = ids, self.unigram(counts)
        for n in range(2, min(top or self.order, len(self.levels)) + 1):
            context = np.full(len(ids), -1, np.int64)
            context[1:] = entry[:-1]
            context[new < n - 1] = -1
            entry, log = self.find(n, context, ids, log)
        return log, entry


def places(counts: np.ndarray) -> np.ndarray:
    """For every token how many stand before it in its row."""
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return np.arange(counts.sum()) - np.repeat(starts, counts)


def planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second bytes and so on: small and close values compress well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Counts(NamedTuple):
    """n-grams in ascending order, how often each comes, and the quantised probability it has one level down."""

    keys: np.ndarray
    counts: np.ndarray
    lower: np.ndarray


def _summed(parts: list[Counts]) -> Counts:
    keys, counts, lower = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = order_of(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    summed = np.add.reduceat(counts[order].astype(np.int64), starts) if len(starts) else counts.astype(np.int64)
    return Counts(keys[starts], summed, lower[order[starts]])


def _sent(all_: Counts, shard: np.ndarray) -> pa.RecordBatch:
    some, at = np.unique(shard, return_index=True)
    spans = list(zip(at, np.append(at[1:], len(shard)), strict=True))
    steps = [np.diff(all_.keys[a:b], prepend=np.uint64(0)) for a, b in spans]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(some.astype(np.int32)),
            pa.array([planes(x) for x in steps], pa.binary()),
            pa.array([planes(all_.counts[a:b].astype(np.uint32)) for a, b in spans], pa.binary()),
            pa.array([planes(all_.lower[a:b]) for a, b in spans], pa.binary()),
        ],
        ["shard", "steps", "counts", "lower"],
    )


def _counted(trie: Trie, n: int, shards: int):
    """n-grams of this task's texts with their counts, dealt by context."""

    def dealt(held: list[Counts]) -> pa.RecordBatch:
        every = _summed(held)
        if n == 1:
            width = np.uint64(-(-(1 << 64) // shards)) if shards > 1 else None
            return _sent(every, np.zeros(len(every.keys), np.int64) if width is None else (every.keys // width).astype(np.int64))
        above = sum(s.entries for s in trie.levels[n - 2])
        return _sent(every, (every.keys // np.uint64(trie.words)).astype(np.int64) * shards // above)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(), [], 0
        for batch in batches:
            for s in together(hasher.stretches(batch.column(0))):
                keys, sizes = with_end(s)
                lower = np.zeros(len(keys), np.uint16)
                if n > 1:
                    ids, seen = trie.ids(keys)
                    before = places(sizes)
                    log, context = trie.scored(ids, seen, before, n - 1)
                    at = np.flatnonzero(before >= n - 1)
                    keys = context[at - 1].astype(np.uint64) * np.uint64(trie.words) + ids[at].astype(np.uint64)
                    lower = quantised(log[at])
                held.append(_summed([Counts(keys, np.ones(len(keys), np.int64), lower)]))
                size += len(held[-1].keys)
                if size > PENDING:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, Counts]:
    held: dict[int, list[Counts]] = {}
    for batch in batches:
        for shard, steps, counts, lower in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = np.cumsum(from_planes(steps, np.uint64), dtype=np.uint64)
            held.setdefault(shard, []).append(Counts(keys, from_planes(counts, np.uint32), from_planes(lower, np.uint16)))
    return {shard: _summed(parts) for shard, parts in held.items()}


def _written(trie: Trie, n: int, shards: int):
    """Write this task's shards of level n; a row for each."""

    def words(shard: int, keys: np.ndarray, counts: np.ndarray) -> None:
        for name, values in (("words", keys), ("counts", counts)):
            part = f"{trie.stem(1, shard)}.{name}.{uuid4().hex}.npy"
            np.save(part, values)
            os.replace(part, f"{trie.stem(1, shard)}.{name}.npy")

    def ngrams(shard: int, found: Counts) -> tuple[int, int]:
        above = sum(s.entries for s in trie.levels[n - 2])
        first, last = -(-shard * above // shards), -(-(shard + 1) * above // shards)
        context, word = (found.keys // np.uint64(trie.words)).astype(np.int64) - first, (found.keys % np.uint64(trie.words)).astype(np.int64)
        degrees = np.bincount(context, minlength=last - first)
        totals = np.bincount(context, found.counts, minlength=last - first)
        prob = (found.counts + degrees[context] * 10.0 ** (found.lower / -float(STEPS))) / (totals + degrees)[context]
        back = np.where(degrees > 0, degrees / np.maximum(totals + degrees, 1), 1.0)
        Level.build(first, degrees, word, trie.bits, quantised(np.log10(prob)), quantised(np.log10(back))).save(trie.stem(n, shard))
        return first, last - first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for shard, found in _gathered(batches).items():
            first, contexts = (0, 0) if n == 1 else ngrams(shard, found)
            if n == 1:
                words(shard, found.keys, found.counts)
            rows.append((shard, first, contexts, len(found.keys), int(found.counts.sum())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["shard", "first", "contexts", "entries", "total"])

    return run


def train(texts: DataFrame, order: int = 3) -> Trie:
    """Count, smooth (Witten-Bell) and write an n-gram trie over the single text column of texts."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = texts.sparkSession
    place = urlparse(shared_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError("memory-mapped levels need a mounted shared folder in spark.checkpoint.dir")
    folder = f"{place.path}/typedlake-trie-{uuid4().hex}"
    os.makedirs(folder)
    goes_at_end(spark, f"file:{folder}")
    trie = Trie(folder, order)
    size = texts.agg(F.coalesce(F.sum(F.octet_length(texts.columns[0])), F.lit(0))).first()[0] // 6  # words, about
    for n in range(1, order + 1):
        size = trie.tokens if n > 1 else size
        shards = max(shuffle_width(spark), -(-size // SHARD))
        if n > 1 and sum(s.entries for s in trie.levels[-1]) * trie.words >= 1 << 64:
            raise ValueError("contexts and words do not fit one 64-bit number")
        counted = texts.mapInArrow(_counted(trie, n, shards), "shard int, steps binary, counts binary, lower binary")
        rows = counted.repartition(shards, "shard").mapInArrow(_written(trie, n, shards), "shard long, first long, contexts long, entries long, total long").collect()
        found = {r["shard"]: r for r in rows}
        base, level = 0, []
        above = sum(s.entries for s in trie.levels[-1]) if n > 1 else 0
        for k in range(shards):
            r = found.get(k)
            if r is not None:
                level.append(Shard(k, r["first"], r["contexts"], base, r["entries"], r["total"]))
                base += r["entries"]
            elif n == 1:
                level.append(Shard(k, 0, 0, base, 0, 0))
        trie.levels.append(level)
        if n > 1 and not above:
            break
    return trie


def _score(trie: Trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for s in together(hasher.stretches(batch.column(2))):
                tokens, sizes = with_end(s)
                ids, counts = trie.ids(tokens)
                log, _ = trie.scored(ids, counts, places(sizes))
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                part = slice(s.first, s.first + len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part],
                        batch.column(1)[part],
                        pa.array(sizes.astype(np.int64)),
                        pa.array(np.add.reduceat(counts > 0, starts).astype(np.int64)),
                        pa.array(np.full(len(sizes), trie.tokens)),
                        pa.array(np.add.reduceat(trie.unigram(counts), starts)),
                        pa.array(np.add.reduceat(log, starts)),
                    ],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, folds: int = 7, held: int = 2) -> DataFrame:
    """Score every whole text by an n-gram model learned from the rows outside one fold.

    The fold is crc32 of the id as text, modulo folds; a null id counts as the
    empty text. Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then
    one end. A null or empty text is the end alone. Probabilities are
    interpolated (Witten-Bell) down to (c + 1) / (N + V + 1), which unseen
    words get with c = 0; base_score uses that alone. With no training rows
    every token gets 1. Repeated rows count, and come out, each for itself. An
    empty table gives an empty result; other columns are not read.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    held_out = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")) % folds == held
    rows = docs.select(docs[id_col].alias("id"), held_out.alias("held_out"), docs[text_col].alias("text"))
    trie = train(rows.where("not held_out").select("text"), order)
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(_score(trie), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
