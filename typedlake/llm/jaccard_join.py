"""N-gram Jaccard join: shared rare shingles, a count-vector R-tree, exact verification.

The steps, each a Spark stage over the rows of the one before:

1. count shingle hashes in a table of fixed size, to tell common ones;
2. per document: the set's size and signature, its prefix (the fifth of its
   shingles that comes first, rare ones before common ones) and its count
   vector (shingles hashed into groups, counted);
3. equal sets are one class, known by its signature, and go on as one;
4. two sets that link share a shingle of both prefixes, so classes meet by
   prefix shingle; equal meeting lists become one;
5. in each list an R-tree over the count vectors finds pairs whose overlap
   bound, the sum of coordinate minima, still reaches the threshold;
6. connected candidates are verified on the shingles themselves; long lists
   and large groups are taken in chunks.

Only spanning edges leave steps 5 and 6, so a group of n near copies gives n
rows and not their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_of, join_groups, may_hold, probe, shuffle_width, stash, unused
from .components import connected
from .words import WordHasher, mix64, shingles

#: Counters of shingle hashes; their number is fixed, so is the size of what is broadcast (8 MB).
COUNTERS = 1 << 20
CHUNK = 1 << 13
#: Bits of a shingle's hash that are kept.
BITS = 48
#: Sets that one task verifies together; larger groups are dealt into chunks of about so many.
TOGETHER = 2000
#: Prefix shingles, and sets, that one task gathers, about.
TASK_TOKENS, TASK_SETS = 4 << 20, 50_000
#: Occurrences from which a shingle that is far more common than others is gathered by rows.
HOT = 1 << 20


def group_count(n: np.ndarray) -> np.ndarray:
    """Groups of the count vector: a power of two near an eighth of the set, so that the bound stays sharp."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(n, 1) / 8)), 4, 12).astype(np.int64)


def needed(a, b, percent: int):
    """The least overlap at which sets of these sizes link: inter * 100 >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """A two-level R-tree of count vectors; a box keeps the largest count of each group."""

    LEAF = 32

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((points.argmax(1), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        cuts = np.arange(0, len(points), self.LEAF)
        self.top = np.maximum.reduceat(self.points, cuts)
        self.small = np.minimum.reduceat(self.sizes, cuts)
        self.large = np.maximum.reduceat(self.sizes, cuts)
        self.alive = np.ones(len(points), bool)
        self.left = np.add.reduceat(self.alive, cuts)

    def remove(self, at: np.ndarray) -> None:
        self.alive[at] = False
        np.subtract.at(self.left, at // self.LEAF, 1)

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Places in order of live points whose overlap with this one may reach the threshold."""
        fits = (self.left > 0) & (self.large * 100 >= size * percent) & (self.small * percent <= size * 100)
        boxes = np.flatnonzero(fits)
        if len(boxes):
            bound = np.minimum(self.top[boxes], point).sum(1, dtype=np.int64)
            boxes = boxes[bound >= needed(size, self.small[boxes], percent)]
        if not len(boxes):
            return boxes
        at = (boxes[:, None] * self.LEAF + np.arange(self.LEAF)).ravel()
        at = at[at < len(self.points)]
        at = at[self.alive[at]]
        bound = np.minimum(self.points[at], point).sum(1, dtype=np.int64)
        return at[bound >= needed(size, self.sizes[at], percent)]


def fold(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector.reshape(-1, groups).sum(0)


def candidate_edges(sigs: np.ndarray, sizes: np.ndarray, vectors: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect, within this list, whatever pairs the count vectors can't rule out."""
    edges = []
    groups = np.array([len(v) for v in vectors])
    for g in np.unique(groups):
        own = np.flatnonzero((groups == g) | (groups == 2 * g))
        if len(own) < 2:
            continue
        tree = CountTree(np.stack([fold(vectors[i], g) for i in own]), sizes[own])
        exact = groups[own][tree.order] == g
        name = own[tree.order]
        while tree.alive.any():
            front = [int(tree.alive.argmax())]
            tree.remove(np.array(front))
            while front:
                q = front.pop()
                found = tree.near(tree.points[q], int(tree.sizes[q]), percent)
                found = found if exact[q] else found[exact[found]]
                tree.remove(found)
                front += found.tolist()
                edges += [(int(sigs[name[q]]), int(sigs[name[f]])) for f in found]
    return edges


def linked_edges(sigs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect exactly the sets that are connected by links."""
    edges, sizes = [], np.array([len(s) for s in sets])
    alive = np.ones(len(sets), bool)
    while alive.any():
        front = [int(alive.argmax())]
        alive[front] = False
        while front:
            q = front.pop()
            found = linked_to(q, np.flatnonzero(alive), sets, sizes, percent)
            alive[found] = False
            front += found.tolist()
            edges += [(int(sigs[q]), int(sigs[f])) for f in found]
    return edges


def linked_to(q: int, near: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Those of near whose sets link with set q."""
    found = [np.zeros(0, np.int64)]
    near = near[(sizes[near] * 100 >= sizes[q] * percent) & (sizes[near] * percent <= sizes[q] * 100)]
    for part in np.array_split(near, max(1, int(sizes[near].sum()) >> 22)):
        if len(part):
            every = np.concatenate([sets[i] for i in part])
            place = np.minimum(np.searchsorted(sets[q], every), len(sets[q]) - 1)
            same = np.add.reduceat(sets[q][place] == every, np.concatenate(([0], np.cumsum(sizes[part])[:-1])))
            found.append(part[same >= needed(sizes[q], sizes[part], percent)])
    return np.concatenate(found)


def stray_edges(sigs: np.ndarray, sets: list[np.ndarray], stray: np.ndarray, main: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of the stray sets to the others: all to sets that may be strays elsewhere, one to the main component."""
    edges, sizes = [], np.array([len(s) for s in sets])
    others = np.flatnonzero(~stray)
    for q in np.flatnonzero(stray).tolist():
        found = linked_to(q, others, sets, sizes, percent)
        kept = np.concatenate((found[~main[found]], found[main[found]][:1]))
        edges += [(int(sigs[q]), int(sigs[f])) for f in kept]
    return edges


def stray_candidates(sigs: np.ndarray, sizes: np.ndarray, vectors: list[np.ndarray], stray: np.ndarray, main: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Like stray_edges, for pairs that the count vectors can't rule out."""
    edges, groups = [], np.array([len(v) for v in vectors])
    others = np.flatnonzero(~stray)
    stacks = {}
    for g in np.unique(groups[others]).tolist():
        at = others[groups[others] == g]
        stacks[g] = at, np.stack([vectors[i] for i in at])
    for q in np.flatnonzero(stray).tolist():
        found = [np.zeros(0, np.int64)]
        for g in (groups[q] // 2, groups[q], 2 * groups[q]):
            if g in stacks:
                at, points = stacks[g]
                near = np.flatnonzero((sizes[at] * 100 >= sizes[q] * percent) & (sizes[at] * percent <= sizes[q] * 100))
                points = points[near]
                if g > groups[q]:
                    points = points.reshape(len(points), -1, groups[q]).sum(1)
                bound = np.minimum(points, fold(vectors[q], min(g, groups[q]))).sum(1, dtype=np.int64)
                found.append(at[near[bound >= needed(sizes[q], sizes[at[near]], percent)]])
        found = np.concatenate(found)
        kept = np.concatenate((found[~main[found]], found[main[found]][:1]))
        edges += [(int(sigs[q]), int(sigs[f])) for f in kept]
    return edges


def _count_shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = WordHasher(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for stretch in hasher.stretches(batch.column(0)):
                hashes, _ = shingles(stretch, shingle)
                counts += np.bincount((hashes >> np.uint64(64 - 20)).astype(np.int64), minlength=COUNTERS)
        if counts.any():
            small = np.minimum(counts, 65_535).astype(np.uint16).reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(small), dtype=np.int32)), pa.array([c.tobytes() for c in small], pa.binary())], ["chunk", "counts"])

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.uint16).astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["chunk", "counts"])


def shingle_levels(texts: DataFrame, shingle: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """For each counter how common its shingles are: 0 up to twice the mean, then one more per doubling; and whether they are hot."""
    width = min(COUNTERS // CHUNK, shuffle_width(texts.sparkSession))
    parts = texts.mapInArrow(_count_shingles(shingle), "chunk int, counts binary")
    summed = parts.repartition(width, "chunk").mapInArrow(_add_counts, "chunk int, counts binary").collect()  # COUNTERS numbers
    counts = np.zeros((COUNTERS // CHUNK, CHUNK), np.int64)
    for r in summed:
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    counts = counts.ravel()
    common = counts / max(2 * counts.mean(), 1.0)
    levels = np.clip(np.floor(np.log2(np.maximum(common, 0.5))) + 1, 0, 15).astype(np.uint8)
    return levels, (counts >= hot) & (common >= 4)


def distinct_sets(stretch, shingle: int, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The stretch's distinct shingles as level and 48-bit hash, in that order by row, and each row's count."""
    hashes, rows = shingles(stretch, shingle)
    key = hashes >> np.uint64(64 - BITS)
    if levels is not None:
        key |= levels[(hashes >> np.uint64(64 - 20)).astype(np.int64)].astype(np.uint64) << np.uint64(BITS)
    key |= rows.astype(np.uint64) << np.uint64(52)
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    counts = np.bincount((key >> np.uint64(52)).astype(np.int64), minlength=len(stretch.counts))
    return key & np.uint64((1 << 52) - 1), counts


def _describe(shingle: int, percent: int, levels):
    mask = np.uint64((1 << BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, level = WordHasher(), levels.value
        for batch in batches:
            for stretch in hasher.stretches(batch.column(2)):
                keys, n = distinct_sets(stretch, shingle, level)
                starts = np.concatenate(([0], np.cumsum(n)))
                hashes = keys & mask
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(hashes), dtype=np.uint64)))
                with np.errstate(over="ignore"):
                    sig = mix64(sums[starts[1:]] - sums[starts[:-1]] + n.astype(np.uint64)).view(np.int64)
                prefix = n - -(-percent * n // 100) + (n > 0)
                groups = group_count(n)
                vectors: list[bytes | None] = [None] * len(n)
                row = np.repeat(np.arange(len(n)), n)
                for g in np.unique(groups):
                    own = np.flatnonzero(groups == g)
                    place = np.full(len(n), -1)
                    place[own] = np.arange(len(own))
                    some = place[row] >= 0
                    counts = np.bincount(place[row[some]] * g + (hashes[some] & np.uint64(g - 1)).astype(np.int64), minlength=len(own) * g)
                    for i, v in zip(own, counts.reshape(-1, g), strict=True):
                        vectors[i] = v.astype(np.uint8 if v.max(initial=0) < 256 else np.uint32).tobytes()
                part = slice(stretch.first, stretch.first + len(n))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part],
                        batch.column(1)[part],
                        pa.array(n.astype(np.int64)),
                        pa.array(sig),
                        pa.array([hashes[s : s + p].tobytes() for s, p in zip(starts, prefix)], pa.binary()),
                        pa.array(vectors, pa.binary()),
                    ],
                    ["id", "key", "n", "sig", "prefix", "vector"],
                )

    return run


def _hot_tokens(hot):
    """The hot prefix shingles with their classes, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _binary(batch.column(1))
            token = data.view(np.uint64)
            own = hot.value[(token >> np.uint64(BITS - 20)).astype(np.int64)]
            sig = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(offsets) // 8)
            yield pa.RecordBatch.from_arrays([pa.array(token[own].view(np.int64)), pa.array(sig[own])], ["list", "sig"])

    return run


def _deal(width: int, hot):
    """Prefix shingles that aren't hot with their classes, dealt to so many shards, many rows in one; a task sends a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, np.int64)
        for batch in batches:
            own, at = np.unique(batch.column(0).to_numpy(), return_index=True)
            batch = batch.take(pa.array(at[~np.isin(own, sent)]))
            sent = np.union1d(sent, own)
            data, offsets = _binary(batch.column(1))
            token = data.view(np.uint64)
            sig = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(offsets) // 8)
            cold = ~hot.value[(token >> np.uint64(BITS - 20)).astype(np.int64)]
            token, sig = token[cold], sig[cold]
            shard = (mix64(token) % np.uint64(width)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(width + 1))
            token, sig = token[order], sig[order]
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some.astype(np.int32)),
                    pa.array([token[cuts[s] : cuts[s + 1]].tobytes() for s in some], pa.binary()),
                    pa.array([sig[cuts[s] : cuts[s + 1]].tobytes() for s in some], pa.binary()),
                ],
                ["shard", "tokens", "sigs"],
            )

    return run


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of classes that share a prefix shingle; equal lists once."""
    tokens, sigs = [], []
    for batch in batches:
        tokens.append(_binary(batch.column(1))[0].view(np.uint64))
        sigs.append(_binary(batch.column(2))[0].view(np.int64))
    if not tokens:
        return
    token, sig = np.concatenate(tokens), np.concatenate(sigs)
    order = np.lexsort((sig, token))
    token, sig = token[order], sig[order]
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])))
    token, sig = token[new], sig[new]
    first = np.concatenate(([True], token[1:] != token[:-1]))
    shared = ~first
    shared[:-1] |= ~first[1:]
    token, sig = token[shared], sig[shared]
    if not len(token):
        return
    starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    with np.errstate(over="ignore"):
        name = np.add.reduceat(mix64(sig.view(np.uint64)), starts)
    _, kept = np.unique(name, return_index=True)
    counts = np.diff(np.concatenate((starts, [len(token)])))
    keep = np.zeros(len(starts), bool)
    keep[kept] = True
    rows = np.repeat(keep, counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, counts)[rows].view(np.int64)), pa.array(sig[rows])], ["list", "sig"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal values of the first column, which is sorted, over batch ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                if held and held[0].column(0)[0].as_py() != values[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _points(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sizes and count vectors of a group's sets."""
    sizes = t.column("n").to_numpy()
    return sizes, [np.frombuffer(v, np.uint8 if len(v) == g else np.uint32).astype(np.int32) for v, g in zip(t.column("vector").to_pylist(), group_count(sizes), strict=True)]


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            edges = candidate_edges(t.column("sig").to_numpy(), *_points(t), percent)
            if edges:
                yield _edge_batch(edges)

    return run


def _bounded_strays(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            edges = stray_candidates(t.column("sig").to_numpy(), *_points(t), *(t.column(c).to_numpy().astype(bool) for c in ("stray", "main")), percent)
            if edges:
                yield _edge_batch(edges)

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for stretch in hasher.stretches(batch.column(1), 512):
                hashes, n = distinct_sets(stretch, shingle)
                starts = np.concatenate(([0], np.cumsum(n)))
                part = slice(stretch.first, stretch.first + len(n))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array([hashes[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary())], ["key", "shingles"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            sets = [np.frombuffer(v, np.uint64) for v in t.column("shingles").to_pylist()]
            edges = linked_edges(t.column("sig").to_numpy(), sets, percent)
            if edges:
                yield _edge_batch(edges)

    return run


def _strays(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            sets = [np.frombuffer(v, np.uint64) for v in t.column("shingles").to_pylist()]
            stray, main = (t.column(c).to_numpy().astype(bool) for c in ("stray", "main"))
            edges = stray_edges(t.column("sig").to_numpy(), sets, stray, main, percent)
            if edges:
                yield _edge_batch(edges)

    return run


def _dealt(rows: DataFrame, run, width: int) -> DataFrame:
    """Edges found within each group of rows; the first column names the group."""
    group = rows.columns[0]
    return rows.repartition(width, group).sortWithinPartitions(group).mapInArrow(run, "a long, b long")


class Search(NamedTuple):
    """How the sets of a group are compared: the columns that tell what is in them, and the work on a whole group and on strays."""

    columns: tuple[str, ...]
    whole: Callable
    strays: Callable


BY_VECTORS = Search(("n", "vector"), _bounded, _bounded_strays)
BY_SHINGLES = Search(("shingles",), _verified, _strays)


def group_edges(members: DataFrame, search: Search, percent: int, width: int, together: int) -> DataFrame:
    """Edges that connect within each group exactly what is connected, never a group of more than about together sets in one task.

    members: root, sig and the search's columns.
    """
    sizes = stash(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).select("root", F.col("n").alias("_n"), F.ceil(F.col("n") / together).cast("long").alias("chunks")), "groups")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("chunks"), F.lit(0))).first()
    width = max(width, -(-total[0] // TASK_SETS))
    own = members.join(sizes.drop("_n"), "root")
    edges = _dealt(own.where("chunks = 1").select("root", "sig", *search.columns), search.whole(percent), width)
    if total[1] > 1:
        edges = edges.unionByName(large_group_edges(own.where("chunks > 1"), search, percent, width, together))
    return edges


def large_group_edges(members: DataFrame, search: Search, percent: int, width: int, together: int) -> DataFrame:
    """The same for groups of several chunks.

    Each chunk of a group is worked on alone; then one set of each of its
    sizeable components meets those of the other chunks, as a smaller group; what is not
    in the group's largest component by then is compared, in blocks, with
    every chunk.
    """
    data = search.columns
    own = stash(members.withColumn("chunk", F.pmod(F.xxhash64("sig"), F.col("chunks"))), "large-groups")
    first = stash(_dealt(own.select(F.xxhash64("root", "chunk").alias("part"), "sig", *data), search.whole(percent), width), "large-edges")
    named = own.join(connected(first).select(F.col("node").alias("sig"), F.col("root").alias("comp")), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    sizeable = named.groupBy("root", "chunk", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("sig").alias("sig")).where(f"n >= {max(2, together // 20)}")
    probes = stash(own.join(sizeable.select("root", "sig"), ["root", "sig"], "left_semi").select("root", "sig", *data), "large-probes")
    second = stash(group_edges(probes, search, percent, width, together).unionByName(first), "large-edges")
    named = own.select("root", "chunks", "chunk", "sig").join(connected(second).select(F.col("node").alias("sig"), F.col("root").alias("comp")), "sig", "left")
    named = stash(named.withColumn("comp", F.coalesce("comp", "sig")), "large-named")
    largest = named.groupBy("root", "comp").count().groupBy("root").agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"))
    told = named.join(largest, "root").select("root", "sig", (F.col("comp") == F.col("largest")).alias("main"))
    flagged = own.join(told, ["root", "sig"])
    strays = flagged.where("not main")
    held = strays.groupBy("root").agg(F.count(F.lit(1)).alias("strays"))
    blocks = F.ceil(F.col("strays") / together).cast("int")
    where = lambda chunk, block: F.xxhash64("root", chunk, block).alias("part")
    asked = strays.join(held, "root").withColumn("block", F.pmod(F.xxhash64("sig", F.lit(1)), blocks)).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    there = flagged.join(held, "root").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))))
    columns = ["part", "sig", *data, "stray", "main"]
    meeting = asked.withColumn("stray", F.lit(True)).withColumn("part", where("at", "block")).select(*columns).unionByName(there.withColumn("stray", F.lit(False)).withColumn("part", where("chunk", "block")).select(*columns))
    return second.unionByName(_dealt(meeting, search.strays(percent), width))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, together: int = TOGETHER, hot: int = HOT) -> DataFrame:
    """Link documents whose sets of word shingles reach the similarity, and name the components.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a set holds the distinct
    shingles of that many words, of a shorter text its whole sequence as one.
    A null, empty or blank text has no set and links with nothing. Two
    documents link when 100 * intersection >= percent * union. Repeated rows
    each come out, in one component. component_id is the smallest id reachable
    by links; a null id is none, so it is null only where a component has no
    other. An empty table gives an empty result; other columns are not read.

    Returns id_col, n_shingles, component_id. Candidates lose no link: sets
    that link share a prefix shingle, and count vectors never bound an overlap
    too low. Hashes have 48 bits within sets and 64 between. A list of sets
    that share a prefix shingle and a group of candidates are worked on in
    chunks where they are larger than together. Shingles that occur hot times,
    and far more often than others, are gathered by rows and not by arrays.
    """
    keyed = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text_col}`"]).alias("key"), docs[f"`{text_col}`"].alias("text"))
    out = _components(keyed, shingle, percent, together, hot)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _components(keyed: DataFrame, shingle: int, percent: int, together: int, hot: int) -> DataFrame:
    """id, n and component_id of rows of id, key (the text's hash) and text; ids need only an order."""
    spark = keyed.sparkSession
    width = shuffle_width(spark)
    common, frequent = shingle_levels(keyed.select("text"), shingle, hot)
    levels, often = spark.sparkContext.broadcast(common), spark.sparkContext.broadcast(frequent)  # COUNTERS bytes each
    kind = dict(keyed.dtypes)["id"]
    rows = stash(keyed.mapInArrow(_describe(shingle, percent, levels), f"id {kind}, key long, n long, sig long, prefix binary, vector binary"), "sets")
    classes = stash(
        rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("id"), F.min("key").alias("key"), F.count(F.lit(1)).alias("rows")),
        "classes",
    )
    prefixes = rows.where("n > 0").select("sig", "prefix")
    tokens = prefixes.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8
    shards = max(width, -(-tokens // TASK_TOKENS))
    dealt = prefixes.mapInArrow(_deal(shards, often), "shard int, tokens binary, sigs binary")
    lists = dealt.repartition(shards, "shard").mapInArrow(_meet, "list long, sig long")
    if frequent.any():
        raw = stash(prefixes.mapInArrow(_hot_tokens(often), "list long, sig long").dropDuplicates(), "hot-lists")
        told = raw.groupBy("list").agg(F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
        lists = lists.unionByName(raw.join(told.groupBy("s", "n").agg(F.min("list").alias("list")), "list", "left_semi"))  # equal lists once
    lists = stash(lists.dropDuplicates(), "lists")
    vectors = may_hold(rows.where("n > 0").select("sig", "n", "vector"), "sig", bloom_of(lists, "sig", lists.count())).dropDuplicates(["sig"])
    met = lists.withColumnRenamed("list", "root").join(vectors, "sig").select("root", "sig", "n", "vector")
    edges = group_edges(met, BY_VECTORS, percent, width, together)
    candidates = stash(connected(edges), "candidates")  # node, root

    wanted = candidates.join(classes.select(F.col("sig").alias("node"), "key"), "node").select("root", F.col("node").alias("sig"), "key")
    wanted = stash(wanted, "wanted")
    texts = may_hold(keyed.select("key", "text"), "key", bloom_of(wanted, "key", wanted.count()))  # one document of each class
    sets = texts.dropDuplicates(["key"]).join(wanted.select("key").distinct(), "key", "left_semi").select("key", "text").mapInArrow(_sets(shingle), "key long, shingles binary")
    members = wanted.join(sets, "key").select("root", "sig", "shingles")
    links = group_edges(members, BY_SHINGLES, percent, width, together)
    linked = stash(connected(links).join(classes.select(F.col("sig").alias("node"), "id"), "node"), "linked")
    least = linked.groupBy("root").agg(F.min("id").alias("least"))
    named = classes.select("sig", "id", "rows").join(linked.join(least, "root").select(F.col("node").alias("sig"), "least"), "sig", "left")
    named = named.select("sig", "rows", F.coalesce("least", "id").alias("component_id"))
    bare = rows.select("id", "n", "sig")
    out = join_groups(bare.where("n > 0"), named, "sig", "rows", bare.count()).select("id", "n", "component_id")
    return out.unionByName(bare.where("n = 0").select("id", "n", F.col("id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, together: int = TOGETHER, hot: int = HOT) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays.

    Of rows of one id and component the smallest text hash stays, of equal rows
    one; rows that share an id only are told apart by their texts. Rows
    without an id are kept. Null, empty and blank texts are copies of nothing,
    but equal rows of them still are. Only rows that a Bloom filter may hold among
    those to drop or repeated are shuffled; the others pass straight through,
    with all their columns, whatever their names.
    """
    own, print_, suspect = unused(docs, "_row", "_print", "_suspect")
    told = docs.withColumn(print_, F.xxhash64(docs[f"`{text_col}`"]))
    keyed = told.select(F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(print_).alias("key")).alias("id"), F.col(print_).alias("key"), F.col(f"`{text_col}`").alias("text"))
    named = _components(keyed, shingle, percent, together, hot).where("not id.none").select("id.id", "id.key", (F.col("id") != F.col("component_id")).alias("gone"))
    rows = stash(named.groupBy("id", "key").agg(F.max("gone").alias("gone"), F.count(F.lit(1)).alias("n")).where("gone or n > 1").withColumn("row", F.xxhash64("id", "key")), "suspects")
    marked = told.withColumn(own, F.xxhash64(F.col(f"`{id_col}`"), F.col(print_)))
    probed = probe(marked, own, *bloom_of(rows, "row", rows.count()), suspect)
    clear = probed.where(~F.col(suspect) | F.col(f"`{id_col}`").isNull())
    held = probed.where(F.col(suspect) & F.col(f"`{id_col}`").isNotNull())
    gone = rows.where("gone").select(F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key"))
    stays = held.join(gone, (F.col(f"`{id_col}`") == F.col("_gone_id")) & (F.col(print_) == F.col("_gone_key")), "left_anti")
    return clear.unionByName(stays.dropDuplicates([id_col, print_])).select(*[f"`{c}`" for c in docs.columns])
