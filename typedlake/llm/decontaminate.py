"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words as TF-IDF vectors over hashed terms. A
distributed randomised SVD gives the latent space; windows of documents near a
benchmark window there are candidates, and a longest common subsequence of
words, with a check of the answer, decides. Items that need not fill a window
would be lost among their neighbours there; their rarest words point to
candidates too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width
from .words import Stretch, WordHasher

#: Hashed terms, latent dimensions and chunks of terms: fixed, and so are the tables sent about (8 MB).
TERM_BITS = 15
TERMS = 1 << TERM_BITS
RANK = 64
CHUNK = 1 << 7
#: A window is two cells of words.
CELL = 8
#: Items of fewer words need not fill a window of a document: they are also looked for by their rarest words.
SHORT = 3 * CELL
#: Benchmark items in one block: their tables are sent to every task, one scan of the documents for each block.
BLOCK = 10_000
#: The latent space is fitted on all documents; larger tables weigh together as much as so many of their documents beside the items.
FITTED = 4096
#: Windows that are sketched together, and pieces of sums that are multiplied together.
WINDOWS, PIECES = 1 << 14, 1 << 10
#: Words, about, that one task of the fit reads at least: its sums are 8 MB, whatever it reads.
TASK_WORDS = 1 << 22
#: Pairs of window and item that are looked at together.
PAIRS = 1 << 20
#: Weight of benchmark windows in the fit.
EMPHASIS = 8.0
#: Least latent cosine of a candidate, and the least part of its energy that must lie on the benchmark's terms.
COSINE, ENERGY = 0.6, 0.4
#: A leak has this part of an item's words in order, or the lesser part and the answer.
VERBATIM, PARAPHRASE, ANSWER = 0.75, 0.5, 0.8


class Item(NamedTuple):
    """A benchmark item: its words, where its answer's begin, and the bit of each word's places."""

    id: object
    words: np.ndarray
    answer: int
    places: dict[int, int]


class Space(NamedTuple):
    """What tasks get: idf and projection of every term, the items, their windows in latent space and where
    each item's begin, the items' words, ascending, with the items that have them (postings from starts on),
    and what each item has (item * words + place of the word, ascending). Of short items the anchors,
    ascending, whose they are, and which terms they have.
    """

    idf: np.ndarray
    projection: np.ndarray
    items: list[Item]
    windows: np.ndarray
    bounds: np.ndarray
    vocabulary: np.ndarray
    starts: np.ndarray
    postings: np.ndarray
    held: np.ndarray
    anchors: np.ndarray
    anchored: np.ndarray
    marked: np.ndarray


    def packed(self) -> tuple:
        """Plain tuples and arrays, for a broadcast: executors need not have this package."""
        return tuple(self._replace(items=[tuple(i) for i in self.items]))


def unpacked(parts: tuple) -> Space:
    space = Space(*parts)
    return space._replace(items=[Item(*i) for i in space.items])


def terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _parts(sums: np.ndarray, beside: np.ndarray) -> pa.RecordBatch:
    """A row for each chunk of terms that is not all zero; what belongs to no term is chunk -1."""
    chunks = sums.reshape(TERMS // CHUNK, -1)
    some = np.flatnonzero(chunks.any(1))
    return pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array([*(chunks[k].tobytes() for k in some), beside.tobytes()], pa.binary())], ["chunk", "sums"])


def _whole(sums: dict[int, np.ndarray], width: int) -> np.ndarray:
    """The sums of all terms, so many numbers each."""
    return np.concatenate([sums.get(k, np.zeros(CHUNK * width, np.float32)) for k in range(TERMS // CHUNK)])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, counts, rows, words = WordHasher(bare=True), np.zeros(TERMS, np.int64), 0, 0
    for batch in batches:
        rows += batch.num_rows
        for s in hasher.stretches(batch.column(0)):
            words += len(s.hashes)
            pairs = s.rows.astype(np.uint64) << np.uint64(TERM_BITS) | s.hashes >> np.uint64(64 - TERM_BITS)
            pairs.sort()
            new = np.concatenate((np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1]))
            counts += np.bincount((pairs[new] & np.uint64(TERMS - 1)).astype(np.int64), minlength=TERMS)
    if rows:
        yield _parts(counts.astype(np.uint32), np.array([rows, words], np.uint32))


def _added(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(part, kind).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())], ["chunk", "sums"])

    return run


def _summed(parts: DataFrame, kind: type) -> dict[int, np.ndarray]:
    width = min(TERMS // CHUNK + 1, shuffle_width(parts.sparkSession))
    rows = parts.repartition(width, "chunk").mapInArrow(_added(kind), "chunk int, sums binary").collect()  # TERMS * RANK numbers at most
    return {r["chunk"]: np.frombuffer(r["sums"], np.float32) for r in rows}


def inverse_frequencies(texts: DataFrame) -> tuple[np.ndarray, int, int]:
    """log((N + 1) / (n + 1)) over all documents, for each hashed term; how many documents and words there are, about."""
    sums = _summed(texts.mapInArrow(_document_counts, "chunk int, sums binary"), np.uint32)
    if not sums:
        return np.ones(TERMS, np.float32), 0, 0
    return np.log((sums[-1][0] + 1) / (_whole(sums, 1) + 1)).astype(np.float32), *(int(x) for x in sums[-1])


def _weighted_sums(table: np.ndarray, at: np.ndarray, weight: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The sum of table[at] * weight over each of the runs that begin at starts, as products of pieces of at most width rows."""
    size = np.diff(np.append(starts, len(at)))
    pieces = -(-size // width)
    base = np.cumsum(pieces) - pieces
    slot = np.arange(len(at)) + np.repeat(base * width - starts, size)
    index, factor = np.zeros((int(pieces.sum()), width), np.int64), np.zeros((int(pieces.sum()), 1, width), np.float32)
    index.ravel()[slot], factor.ravel()[slot] = at, weight
    out = np.empty((len(index), table.shape[1]), np.float32)
    for k in range(0, len(out), PIECES):
        out[k : k + PIECES] = (factor[k : k + PIECES] @ table[index[k : k + PIECES]])[:, 0]
    return out if len(out) == len(starts) else np.add.reduceat(out, base)


def _sketch(terms: np.ndarray, window: np.ndarray, windows: int, idf: np.ndarray, omega: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
    """Add to G = Y'Y and W = A'Y these windows' part: their unit TF-IDF rows A, where Y = A omega."""
    edges = np.searchsorted(window, np.arange(windows + 1))
    for k in range(0, windows, WINDOWS):
        cuts = edges[k : k + WINDOWS + 1]
        own, at = terms[cuts[0] : cuts[-1]], window[cuts[0] : cuts[-1]] - k
        value = idf[own]
        weight = value / np.sqrt(np.maximum(np.bincount(at, value**2), 1e-12)).astype(np.float32)[at]
        y = _weighted_sums(omega, own, weight, cuts[:-1] - cuts[0], 2 * CELL)
        order = np.argsort(own.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(own[order]) > 0)))
        w[own[order][first]] += _weighted_sums(y, at[order], weight[order], first, CELL)
        g += y.T @ y


def _fixed_windows(s: Stretch, size: int) -> tuple[np.ndarray, int]:
    """The number of every word's window, windows not overlapping, and how many there are."""
    per_row = -(-s.counts // size)
    base = np.concatenate(([0], np.cumsum(per_row)))
    place = np.arange(len(s.hashes)) - np.repeat(s.starts[:-1], s.counts)
    return np.repeat(base[:-1], s.counts) + place // size, int(base[-1])


def _sketches(idf, omega):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, g, w = WordHasher(bare=True), np.zeros((RANK, RANK)), np.zeros((TERMS, RANK))
        for batch in batches:
            for s in hasher.stretches(batch.column(0)):
                if len(s.hashes):
                    _sketch(terms_of(s.hashes), *_fixed_windows(s, 2 * CELL), idf.value, omega.value, g, w)
        if g.any():
            yield _parts(w.astype(np.float32), g.astype(np.float32))

    return run


def item_windows(item: Item) -> list[np.ndarray]:
    """The item's windows, one for every half cell, the last one to its end."""
    n, size = len(item.words), 2 * CELL
    return [item.words[a : a + size] for a in sorted({*range(0, max(n - size, 0), CELL // 2), max(n - size, 0)})]


def latent(terms: np.ndarray, lengths: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Unit latent vectors of windows given end to end."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    out = np.add.reduceat(projection[terms], starts)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def document_sums(texts: DataFrame, idf: np.ndarray, omega: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """G and W of every window of every document."""
    sent = (texts.sparkSession.sparkContext.broadcast(x) for x in (idf, omega))
    few = texts.coalesce(max(1, -(-words // TASK_WORDS)))  # small partitions share a task and its sums; nothing is left out
    sums = _summed(few.mapInArrow(_sketches(*sent), "chunk int, sums binary"), np.float32)
    if not sums:
        return np.zeros((RANK, RANK)), np.zeros((TERMS, RANK))
    return sums[-1].reshape(RANK, RANK).astype(float), _whole(sums, RANK).reshape(TERMS, RANK).astype(float)


def fit_space(idf: np.ndarray, omega: np.ndarray, items: list[Item], sums: tuple[np.ndarray, np.ndarray], share: float) -> Space:
    """Randomised SVD of the windows of all documents, whose sums weigh by this share, and of the items, whitened."""
    windows = [(k, x) for k, item in enumerate(items) for x in item_windows(item)]
    lengths = np.array([len(x) for _, x in windows])
    terms = terms_of(np.concatenate([x for _, x in windows]))
    g, w = np.zeros((RANK, RANK)), np.zeros((TERMS, RANK))
    _sketch(terms, np.repeat(np.arange(len(windows)), lengths), len(windows), idf, omega, g, w)
    g, w = share * sums[0] + EMPHASIS * g, (share * sums[1] + EMPHASIS * w).astype(np.float32)
    values, vectors = np.linalg.eigh(g)
    good = values > values.max() * 1e-9
    b = w @ (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)  # A'Q for the orthonormal basis Q of Y
    right, strength, _ = np.linalg.svd(b, full_matrices=False)
    kept = strength > strength.max() * 1e-6
    projection = (idf[:, None] * right[:, kept] / strength[kept]).astype(np.float32)
    bounds = np.searchsorted(np.array([k for k, _ in windows]), np.arange(len(items) + 1))
    return Space(idf, projection, items, latent(terms, lengths, projection), bounds, *words_of(items), *anchors_of(items, idf))


def words_of(items: list[Item]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The items' words, where each one's postings begin, the items in them, and item * words + word, ascending."""
    vocabulary, word = np.unique(np.concatenate([i.words for i in items]), return_inverse=True)
    item = np.repeat(np.arange(len(items)), [len(i.words) for i in items])
    pairs = np.unique(word.astype(np.int64) * len(items) + item)
    word, item = np.divmod(pairs, len(items))
    return vocabulary, np.searchsorted(word, np.arange(len(vocabulary) + 1)), item, np.sort(item * len(vocabulary) + word)


def anchors_of(items: list[Item], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the short items of which every leak has one, rare ones: their hashes, items and terms.

    A leak misses too few places of the item, or of its answer, to miss all anchors.
    """
    pairs = set()
    for k, item in enumerate(items):
        n = len(item.words)
        if n < SHORT:
            rare = np.argsort(-idf[terms_of(item.words)], kind="stable")
            said = rare[rare >= item.answer]
            places = *rare[: n - math.ceil(VERBATIM * n) + 1], *said[: len(said) - math.ceil(ANSWER * len(said)) + 1]
            pairs |= {(int(item.words[p]), k) for p in places}
    ordered = sorted(pairs)
    anchors = np.array([w for w, _ in ordered], np.uint64)
    marked = np.zeros(TERMS, bool)
    marked[terms_of(anchors)] = True
    return anchors, np.array([k for _, k in ordered], np.int64), marked


def common_length(words: np.ndarray, item: Item) -> tuple[int, int]:
    """Length of the longest common subsequence of these words and the item's, and how many of them are of its answer."""
    n = len(item.words)
    full = open_ = (1 << n) - 1
    for word in words.tolist():
        if places := item.places.get(word):
            hit = open_ & places
            open_ = ((open_ + hit) | (open_ - hit)) & full
    matched = full & ~open_
    return matched.bit_count(), (matched >> item.answer).bit_count()


def _runs(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers begin..end-1 of every run, end to end."""
    size = end - begin
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def short_leaks(s: Stretch, terms: np.ndarray, space: Space) -> dict[tuple[int, int], float]:
    """Leaks of short items among these rows: the share of the words in order, by row and item.

    Around each anchor the stretch is a cell and the item's length on both sides.
    """
    out: dict[tuple[int, int], float] = {}
    hit = np.flatnonzero(space.marked[terms])
    first, last = (np.searchsorted(space.anchors, s.hashes[hit], side) for side in ("left", "right"))
    at, item = np.repeat(hit, last - first), space.anchored[_runs(first, last)]
    if not len(at):
        return out
    sizes, answers = (np.array(x) for x in zip(*((len(i.words), i.answer) for i in space.items)))
    row = s.rows[at]
    begin = np.maximum(at - sizes[item] - CELL, s.starts[row])
    end = np.minimum(at + sizes[item] + CELL + 1, s.starts[row + 1])
    for k in range(0, len(at), 4096):
        a, b, who = begin[k : k + 4096], end[k : k + 4096], item[k : k + 4096]
        place = a[:, None] + np.arange(int((b - a).max()))
        outside = place >= b[:, None]
        there = s.hashes[np.minimum(place, len(s.hashes) - 1)]
        whole, said = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for p in range(int(sizes[who].max())):
            word = np.array([i.words[p] if p < len(i.words) else 0 for i in space.items], np.uint64)[who]
            same = ((there == word[:, None]) & ~outside).any(1) & (p < sizes[who])
            whole += same
            said += same & (p >= answers[who])
        fits = (whole >= VERBATIM * sizes[who]) | ((whole >= PARAPHRASE * sizes[who]) & (said >= ANSWER * (sizes - answers)[who]))
        for j in np.flatnonzero(fits).tolist():
            key = int(row[k + j]), int(who[j])
            if out.get(key, 0.0) < 1.0:
                out[key] = max(out.get(key, 0.0), overlap_of(s.hashes[a[j] : b[j]], space.items[key[1]]))
    return {key: found for key, found in out.items() if found}


def overlap_of(words: np.ndarray, item: Item) -> float:
    """The share of the item's words in order among these, 0 where that is no leak."""
    n = len(item.words)
    length, answered = common_length(words, item)
    return length / n if length >= VERBATIM * n or (length >= PARAPHRASE * n and answered >= ANSWER * (n - item.answer)) else 0.0


def candidates(begin: np.ndarray, end: np.ndarray, word: np.ndarray, energy: np.ndarray, terms: np.ndarray, space: Space) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows and items of which the item has words of at least ENERGY of the window's energy, and their best cosine if it is a candidate's.

    begin, end: the windows' words. word: each word's place in the items'
    vocabulary, -1 outside. An item with so much of the energy has one of the
    window's rarest words, those before which less than 1 - ENERGY of it
    lies: only their postings are read, and nothing is missed by that.
    """
    at, window = _runs(begin, end), np.repeat(np.arange(len(begin)), end - begin)
    own = energy[at]
    total = np.bincount(window, own, len(begin))
    order = np.lexsort((-own, window))
    sums = np.cumsum(own[order])
    base = np.concatenate(([0.0], sums))[np.searchsorted(window, np.arange(len(begin)))]
    before = sums - own[order] - base[window]
    rare = order[(total[window] - before >= (ENERGY - 1e-6) * total[window]) & (word[at[order]] >= 0)]
    window, word_at = window[rare], word[at[rare]]
    size = space.starts[word_at + 1] - space.starts[word_at]
    cuts = np.searchsorted(np.cumsum(size), np.arange(PAIRS, int(size.sum()) + PAIRS, PAIRS))
    edges = np.unique(np.concatenate(([0], np.searchsorted(window, window[np.minimum(cuts, len(window) - 1)]), [len(window)]))) if len(window) else np.zeros(1, np.int64)
    width = len(space.vocabulary)
    for a, b in zip(edges[:-1], edges[1:]):
        item = space.postings[_runs(space.starts[word_at[a:b]], space.starts[word_at[a:b] + 1])]
        pairs = np.unique(np.repeat(window[a:b], size[a:b]) * len(space.items) + item)
        for k in range(0, len(pairs), PAIRS // (2 * CELL)):
            w, item = np.divmod(pairs[k : k + PAIRS // (2 * CELL)], len(space.items))
            length = end[w] - begin[w]
            inside = _runs(begin[w], end[w])
            key = np.repeat(item, length) * width + word[inside]
            there = (word[inside] >= 0) & (space.held[np.minimum(np.searchsorted(space.held, key), len(space.held) - 1)] == key)
            share = np.add.reduceat(energy[inside] * there, np.cumsum(length) - length)
            near = share >= ENERGY * total[w]
            w, item = w[near], item[near]
            if len(w):
                some, place = np.unique(w, return_inverse=True)
                own_windows = latent(terms[_runs(begin[some], end[some])], end[some] - begin[some], space.projection)
                cosine = _best_cosines(own_windows, place, item, space)
                yield w[cosine >= COSINE], item[cosine >= COSINE], cosine[cosine >= COSINE]


def _best_cosines(vectors: np.ndarray, place: np.ndarray, item: np.ndarray, space: Space) -> np.ndarray:
    """For each pair the best cosine of the vector and the item's windows."""
    out = np.empty(len(item))
    for k in range(0, len(item), 4096):
        own = item[k : k + 4096]
        size = space.bounds[own + 1] - space.bounds[own]
        dots = np.einsum("ij,ij->i", vectors[np.repeat(place[k : k + 4096], size)], space.windows[_runs(space.bounds[own], space.bounds[own + 1])])
        out[k : k + 4096] = np.maximum.reduceat(dots, np.cumsum(size) - size)
    return out


def leaks_in(s: Stretch, space: Space) -> list[tuple[int, int, float, float]]:
    """Leaks among these rows: row, item, share of the item's words in order, latent cosine."""
    if not len(s.hashes) or not space.items:
        return []
    terms, rows_at = terms_of(s.hashes), s.starts
    short = short_leaks(s, terms, space)
    word = np.minimum(np.searchsorted(space.vocabulary, s.hashes), len(space.vocabulary) - 1)
    word[space.vocabulary[word] != s.hashes] = -1
    cell, cells = _fixed_windows(s, CELL)
    begin = np.searchsorted(cell, np.arange(cells))
    row = s.rows[begin]
    energy = space.idf[terms] ** 2
    total, inside = (np.add.reduceat(e, begin) for e in (energy, energy * (word >= 0)))
    pair = np.concatenate((row[1:] == row[:-1], [False]))  # the cell has one after it in its row
    first = np.flatnonzero(pair | ~np.concatenate(([False], pair[:-1])))
    second = first + pair[first]
    sums = [e[first] + np.where(second > first, e[second], 0) for e in (total, inside)]
    first, second = (x[sums[1] >= ENERGY * sums[0]] for x in (first, second))
    edges = np.append(begin, len(terms))
    best: dict[tuple[int, int], list] = {}
    for k in range(0, len(first), 4096):
        a, b = edges[first[k : k + 4096]], edges[second[k : k + 4096] + 1]
        for windows, item, cosine in candidates(a, b, word, energy, terms, space):
            for w, i, c in zip(windows.tolist(), item.tolist(), cosine.tolist()):
                span = best.setdefault((int(row[first[k + w]]), i), [set(), 0.0])
                span[0].add((int(a[w]), int(b[w])))
                span[1] = max(span[1], c)
    out = []
    for (r, k), (spans, cosine) in best.items():
        item, found = space.items[k], 0.0
        n, low, high = len(item.words), rows_at[r], rows_at[r + 1]
        done = -1
        for a, b in sorted(spans):
            if b <= done:
                continue
            a, done = max(low, a - n), min(high, b + n)
            region = s.hashes[a:done]
            if np.isin(item.words, region).mean() < PARAPHRASE:
                done = b
                continue
            done = b + n // 2
            found = max(found, overlap_of(region, item))
        found = max(found, short.pop((r, k), 0.0))
        if found:
            out.append((r, k, found, cosine))
    return out + [(r, k, found, _cosine(s, terms, r, k, space)) for (r, k), found in short.items()]


def _cosine(s: Stretch, terms: np.ndarray, row: int, item: int, space: Space) -> float:
    """The best latent cosine of a row's windows and an item's."""
    own = terms[s.starts[row] : s.starts[row + 1]]
    cuts = np.arange(0, len(own), CELL)
    ends = np.minimum(cuts + 2 * CELL, len(own))
    near = latent(own[_runs(cuts, ends)], ends - cuts, space.projection) @ space.windows[space.bounds[item] : space.bounds[item + 1]].T
    return float(near.max())


def read_items(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> Iterator[list[Item]]:
    """The benchmark in blocks of about BLOCK items; items without words match nothing and are left out."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(id_col).alias("id"), F.col(f"`{text_col}`").alias("text"), answer.alias("answer"))
    blocks = max(1, -(-items.count() // BLOCK))
    hasher = WordHasher(bare=True)
    for block in range(blocks):
        out = []
        for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect():
            words = next(hasher.stretches(pa.array([r["text"] or ""]))).hashes
            said = next(hasher.stretches(pa.array([r["answer"] or ""]))).hashes
            whole = np.concatenate((words, said))
            if len(whole):
                places: dict[int, int] = {}
                for at, word in enumerate(whole.tolist()):
                    places[word] = places.get(word, 0) | 1 << at
                out.append(Item(r["id"], whole, len(words) if len(said) else len(whole) - -(-len(whole) // 4), places))
        yield out


def spaces(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, answer_col: str | None, fitted: int, seed: int) -> Iterator[Space]:
    """For each block of items the fitted space; term statistics and the documents' part of the fit cover all documents."""
    texts = docs.select(docs[f"`{text_col}`"].alias("text"))
    omega = np.random.default_rng(seed).standard_normal((TERMS, RANK)).astype(np.float32)
    idf, sums, share = None, None, 1.0
    for items in read_items(benchmark, item_col, item_text, answer_col):
        if items:
            if idf is None:
                idf, rows, words = inverse_frequencies(texts)
                sums, share = document_sums(texts, idf, omega, words), min(1.0, fitted / max(rows, 1))
            yield fit_space(idf, omega, items, sums, share)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, fitted: int = FITTED, seed: int = 4) -> DataFrame:
    """Documents that hold an item of the benchmark, with the item.

    Words are runs of letters and digits, lower-cased in every script. An item leaks when
    a stretch of the document has three quarters of its words in order, or
    half of them and four fifths of its answer's. Items below SHORT words are
    found wherever that holds around one of their words, an item of one word
    wherever the word stands. Without an answer column the
    last quarter of the item stands for the answer. The space is fitted on
    every window of all documents and on the items; documents beyond fitted
    weigh together as much as so many, so that items count alike in tables of
    any size. Every window of every document is searched, and term statistics
    cover all documents. The items come in blocks of about 10,000, a scan for each.
    Texts and items that are null, empty or without words match nothing; an
    empty table gives an empty result; other columns are not read; repeated
    rows give one row.

    Returns id_col, item_col, overlap (share of the item's words in order) and
    cosine.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"id {kinds[0]}, item {kinds[1]}, overlap double, cosine double"
    out = spark.createDataFrame([], schema)
    for space in spaces(docs, benchmark, text_col, item_col, item_text, answer_col, fitted, seed):
        sent = spark.sparkContext.broadcast(space.packed())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hasher, space = WordHasher(bare=True), unpacked(sent.value)
            for batch in batches:
                for s in hasher.stretches(batch.column(1)):
                    found = leaks_in(s, space)
                    if found:
                        row, item, overlap, cosine = zip(*found)
                        ids = batch.column(0).take(pa.array([s.first + r for r in row]))
                        items = pa.array([space.items[k].id for k in item]).cast(batch_item_type)
                        yield pa.RecordBatch.from_arrays([ids, items, pa.array(overlap), pa.array(cosine)], ["id", "item", "overlap", "cosine"])

        batch_item_type = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
        out = out.unionByName(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")).mapInArrow(run, schema))
    best = out.groupBy("id", "item").agg(F.max("overlap").alias("overlap"), F.max("cosine").alias("cosine"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "overlap", "cosine")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, fitted: int = FITTED, seed: int = 4) -> DataFrame:
    """The rows of docs that hold no item, whole; each row decides for itself, so nothing is shuffled.

    Null and empty texts stay, repeated rows each decide alike, columns of any
    name are carried, and an empty table or benchmark changes nothing.
    """
    kept, names = docs, docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for space in spaces(docs, benchmark, text_col, item_col, item_text, answer_col, fitted, seed):
        sent = docs.sparkSession.sparkContext.broadcast(space.packed())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hasher, space = WordHasher(bare=True), unpacked(sent.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for s in hasher.stretches(batch.column(names.index(text_col))):
                    for r, *_ in leaks_in(s, space):
                        clean[s.first + r] = False
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(clean)) for c in batch.columns], names)

        kept = kept.mapInArrow(run, schema)
    return kept
