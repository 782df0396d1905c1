"""Mixing sources to target weights by drawing fixed-length blocks of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_total, stash

#: Words in a block.
BLOCK = 32
#: So many shards, the last ones, share their slots by what the sources still lack.
CLOSING = 64
#: Slots of one row while they are mapped, and about as many times more in one task.
RUN, TASK_RUNS = 16_384, 16
WORD = r"[^\x20\x09-\x0D]+"


def targets_of(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Share all sizes by weight; a target stops at most times its source, the excess is shared again."""
    out, open_, pool = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = pool / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        for i in over or open_:
            out[i] = most * sizes[i] if over else weights[i] * unit
        pool -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)] if over else []
    return out


def permuted(index: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """A keyed permutation of 0..n-1 at these indices: four Feistel rounds, walked until inside."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.SeedSequence(list(key)).generate_state(4, np.uint64) | np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            left, right = right, left ^ ((mixed * k) >> np.uint64(33) & mask)
        return left << np.uint64(half) | right

    with np.errstate(over="ignore"):
        x = once(index.astype(np.uint64))
        while (out := x >= n).any():
            x[out] = once(x[out])
    return x.astype(np.int64)


def shard_counts(slots: int, share: np.ndarray, seed: int, at: int) -> np.ndarray:
    """How many slots of an output shard each source gets: one multinomial draw, the same in every run."""
    if not slots or not share.any():
        return np.zeros(len(share), np.int64)
    return np.random.Generator(np.random.Philox(key=[seed, at])).multinomial(slots, share / share.sum())


def closing_counts(slots: list[int], lacking: np.ndarray, seed: int, first: int) -> list[np.ndarray]:
    """Draws of the last shards, each over what the sources lack after the ones before, so that the sums end near the targets."""
    out = []
    for k, n in enumerate(slots):
        out.append(shard_counts(n, np.maximum(lacking, 0.0), seed, first + k))
        lacking = lacking - out[-1]
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_slots: int = 65_536, most: float = 3.0, seed: int = 20, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Plan a mix of the sources: which blocks of words it takes, and how often.

    Sources in code-point order, null last, weigh 1, 2, 3 and again; together
    they take as many words as there are. A target stops at most times its
    source and the excess is shared again. The words of a source are packed
    into blocks of the given length. For each output shard the counts of the
    sources are drawn, multinomial over their shares of all slots; in the last
    CLOSING shards over what each source still lacks of its own, so that sums stray
    from the targets by the noise of one shard only. Slot numbers of a source run on over the shards and map
    through a keyed permutation of its blocks, a new one for each round, so no
    block is drawn more than most times; slots that a source draws beyond that stay empty. Documents stand in their source in an order
    of id and text hash, and everything is seeded: reruns agree however the
    table is partitioned.

    A null or wordless text has size 0 and nothing taken; an empty table gives
    empty results; repeated rows are rows of their own. The driver holds one
    row for each source, as the weights are given by source.

    Returns the documents (id_col, row, size, source, source_size, target,
    offset, number) and the slots (number, round, block). row tells repeated
    ids apart: the unique numbers of row_col, or numbers made here.
    """
    spark = docs.sparkSession
    digest = stash(
        docs.select(
            docs[id_col].alias(id_col),
            (docs[row_col] if row_col else F.monotonically_increasing_id()).alias("row"),
            docs[source_col].alias("source"),
            F.xxhash64(docs[text_col]).alias("print"),
            F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-digests",
    )
    found = digest.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"]))
    sizes, rows = [r["size"] for r in found], sum(r["rows"] for r in found)
    targets = targets_of(sizes, [1 + i % 3 for i in range(len(sizes))], most)
    blocks = [-(-s // block) for s in sizes]
    expected = np.array([t * b / s if s else 0.0 for t, b, s in zip(targets, blocks, sizes, strict=True)])

    known = spark.createDataFrame(
        [(r["source"], i, s, t, b) for i, (r, s, t, b) in enumerate(zip(found, sizes, targets, blocks, strict=True))],
        f"_source {dict(digest.dtypes)['source']}, number int, source_size long, target double, _blocks long",
    )
    few = F.broadcast(known) if len(found) <= 100_000 else known
    numbered = digest.join(few, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_blocks")
    documents = running_total(numbered, ["number"], [id_col, "print"], "size", "offset", rows, tie="row").drop("print")

    total = int(round(expected.sum()))
    shards = max(min(total, CLOSING), -(-total // shard_slots))
    sizes_of = lambda at: total // shards + (at < total % shards)
    opening = max(0, shards - CLOSING)

    def rows_of(at: int, counts: np.ndarray) -> pd.DataFrame:
        some = np.flatnonzero(counts)
        return pd.DataFrame({"shard": np.full(len(some), at, np.int64), "number": some.astype(np.int32), "n": counts[some]})

    def open_(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in pdf["id"]:
                yield rows_of(at, shard_counts(sizes_of(at), expected, seed, at))

    drawn = spark.range(0, opening, 1, max(1, -(-opening // CLOSING))).mapInPandas(open_, "shard long, number int, n long")
    lacking = expected.copy()
    for r in drawn.groupBy("number").agg(F.sum("n").alias("n")).collect() if opening else []:
        lacking[r["number"]] -= r["n"]

    def close(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in parts:
            for k, counts in enumerate(closing_counts([sizes_of(at) for at in range(opening, shards)], lacking, seed, opening)):
                yield rows_of(opening + k, counts)

    drawn = drawn.unionByName(spark.range(0, 1, 1, 1).mapInPandas(close, "shard long, number int, n long"))
    before = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    runs = runs.join(F.broadcast(known.select("number", "_blocks")) if len(found) <= 100_000 else known.select("number", "_blocks"), "number")
    runs = runs.withColumn("n", F.least("n", F.floor(F.lit(most) * F.col("_blocks")).cast("long") - F.col("first"))).where("n > 0")
    runs = runs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    runs = runs.select("shard", "number", (F.col("first") + F.col("part") * RUN).alias("first"), F.least(F.lit(RUN), F.col("n") - F.col("part") * RUN).alias("n"), F.col("_blocks").alias("blocks"))

    def map_slots(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                slot = np.arange(r.first, r.first + r.n)
                turn, at = slot // r.blocks, slot % r.blocks
                for t in np.unique(turn):
                    own = at[turn == t]
                    yield pd.DataFrame({"shard": r.shard, "number": np.int32(r.number), "round": np.int32(t), "block": permuted(own, r.blocks, (seed, r.number, int(t)))})

    tasks = 1 + total // (RUN * TASK_RUNS)
    slots = runs.repartition(tasks, "shard", "number", "first").mapInPandas(map_slots, "shard long, number int, round int, block long")
    return documents, slots


def pieces_of(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents' words by block: first (word of the document) and words, one null block where there are none."""
    last = F.floor((F.col("offset") + F.col("size") - 1) / block)
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("offset") / block), last))
    cut = documents.withColumn("block", F.explode_outer(spans))
    start = F.greatest("offset", F.col("block") * block)
    return cut.withColumns({"first": start - F.col("offset"), "words": F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block) - start})


def taken_of(documents: DataFrame, slots: DataFrame, id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """For each document the words that the mix takes, repeats counted."""
    times = slots.groupBy("number", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")  # as many rows as blocks: never broadcast
    joined = pieces_of(documents, block).join(times, ["number", "block"], "left")
    sums = joined.groupBy("row", id_col, "size", "source_size", "target").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return sums.select(id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, **options) -> DataFrame:
    """The mix as documents: for each round in which blocks of a document are drawn, a row with those words.

    The columns are those of docs. A document none of whose words are taken is
    gone; one drawn in three rounds gives three rows. Runs of white space
    inside the text become one space.
    """
    kept = stash(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-input")
    documents, slots = mix(kept, id_col, text_col, source_col, block, row_col="_mix_row", **options)
    drawn = pieces_of(documents, block).where("size > 0").join(slots.select("number", "round", "block").hint("merge"), ["number", "block"])
    spans = drawn.groupBy(F.col("row").alias("_mix_row"), F.col("round").alias("_mix_round")).agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("_mix_spans"))
    words = F.regexp_extract_all(kept[text_col], F.lit(f"({WORD})"))
    cut = lambda own: F.flatten(F.transform("_mix_spans", lambda s: F.slice(own, (s["first"] + 1).cast("int"), s["words"].cast("int"))))
    text = F.get(F.transform(F.array(words), lambda own: F.array_join(cut(own), " ")), F.lit(0))  # the text is split once
    return kept.join(spans, "_mix_row").withColumn(text_col, text).select(*docs.columns)
