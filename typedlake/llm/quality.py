"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_of, may_hold, probe, shuffle_width, stash, unused
from .words import Stretch, WordHasher, mix64, ngrams, shingles

#: Hash buckets of each kind of n-gram; their number is fixed, and so is what is broadcast (8 MB).
BUCKETS = 1 << 18
CHUNK = 1 << 13
RANGES = BUCKETS // CHUNK
#: The sums of a kind's seven tables.
TOTALS = [f"t{k}" for k in range(7)]
#: What tasks count: a range of buckets of one of the seven tables.
COUNTS = "chunk int, of int, counts binary"
#: Bytes of the n-grams at the beginnings and ends of words.
HEAD, TAIL = 5, 3
#: The kinds of n-grams: words, beginnings of words, ends of words, pairs of words.
KINDS = 4
#: Classes of text by label: the target, then what raw text is made of beside it.
TARGET, TOXIC, POOR = range(3)
#: A class has a probability of its own for a bucket where the documents that hold it differ from the target's by this many
#: standard errors and the probabilities by the class's factor (its logarithm); elsewhere it shares the target's. Toxic text is
#: like the target but for a few words; poor text differs all over.
ERRORS, FACTORS = 5.0, {TOXIC: 2.5, POOR: 0.0}
#: The sample has as many rows as have at least this chance to be of the target.
LEAST = 0.05
#: The raw model's part in every class's model.
RAW = 0.1
#: The hash of a pair of equal words, whatever the word.
TWICE = np.uint64(0x7A1C3D5E9B2F4861)
#: Least documents whose near copies are told by so many hashes of their rarest shingle.
PRINTS = 3


def _grams(s: Stretch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every n-gram, kind by kind."""
    pairs, rows = ngrams(s, 2)
    if len(pairs):
        ends = np.repeat(s.starts[1:], s.counts)
        first = np.flatnonzero(np.arange(len(s.hashes)) + 2 <= ends)
        pairs[s.hashes[first] == s.hashes[first + 1]] = TWICE
    bucket = lambda hashes: (hashes >> np.uint64(64 - 18)).astype(np.int64)
    own = s.rows
    return [(bucket(s.hashes), own), (bucket(s.heads), own), (bucket(s.tails), own), (bucket(pairs), rows)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of this task's texts, by kind: all n-grams, those of each class, the documents of each class that hold them.

    A document counts once more for every doubling of the n-gram in it.
    """
    hasher, counts = WordHasher(HEAD, tail=TAIL), np.zeros((7, KINDS, BUCKETS), np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for s in hasher.stretches(batch.column(0)):
            own = label[s.first : s.first + len(s.counts)]
            for kind, (where, row) in enumerate(_grams(s)):
                counts[0, kind] += np.bincount(where, minlength=BUCKETS)
                for c in np.unique(own[own >= 0]).tolist():
                    some = own[row] == c
                    counts[1 + c, kind] += np.bincount(where[some], minlength=BUCKETS)
                    once, times = np.unique(row[some] * BUCKETS + where[some], return_counts=True)
                    counts[4 + c, kind] += np.bincount(once % BUCKETS, np.floor(np.log2(times)) + 1, BUCKETS).astype(np.int64)
    for chunk in range(KINDS * RANGES if counts.any() else 0):  # a range of buckets of one kind, in the tables that have any, in as few bytes as hold them
        kind, part = divmod(chunk, RANGES)
        own = np.minimum(counts[:, kind, part * CHUNK : (part + 1) * CHUNK], 2**32 - 1)
        some = np.flatnonzero(own.any(1))
        rows = [t.astype(np.min_scalar_type(t.max())).tobytes() for t in own[some]]
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int32()), pa.array(some.astype(np.int32)), pa.array(rows, pa.binary())], ["chunk", "of", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each range, and how much there is in each table."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, table, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = sums.setdefault(chunk, np.zeros((7, CHUNK), np.int64))
            own[table] += np.frombuffer(counts, f"u{len(counts) // CHUNK}")
    for chunk, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([own.tobytes()], pa.binary()), *(pa.array([int(t)]) for t in own.sum(1))], ["chunk", "counts", *TOTALS])


def ratios(raw: np.ndarray, counts: np.ndarray, documents: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log ratio of each class's model to the target's for some buckets of one kind, 0 where they share a probability.

    raw: counts of all text. counts, documents: n-grams, and documents that
    hold them, by class. totals: the sums of the seven over all buckets of
    the kind. Each model is interpolated with the raw one.
    """
    totals = np.maximum(totals, 1).astype(float)
    log = np.log((1 - RAW) * counts / totals[1:4, None] + RAW * raw / totals[0] + 1e-12)
    out = log - log[TARGET]
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in FACTORS:
            here, there = documents[c], documents[TARGET]
            expected = (here + there) * (totals[4 + c] / (totals[4 + c] + totals[4 + TARGET]))
            part = lambda n, e: np.where(n > 0, n * np.log(n / e), 0.0)
            evidence = 2 * (part(here, expected) + part(there, here + there - expected))
            out[c][(evidence < ERRORS**2) | (np.abs(out[c]) < FACTORS[c])] = 0.0
    return out[1:].astype(np.float32)


def _ratios(totals: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, np.int64).reshape(7, CHUNK)
                found = ratios(own[0], own[1:4], own[4:], totals[chunk // RANGES])
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["chunk", "ratios"])

    return run


class Model:
    """The shares of the classes, and the log ratios of all but the target, by kind and bucket."""

    def __init__(self, shares: np.ndarray, log_ratios: np.ndarray) -> None:
        self.shares, self.log_ratios = shares, log_ratios

    def weights(self, s: Stretch) -> np.ndarray:
        """log(target / raw) for the rows of a stretch, where raw text is the mixture of all classes."""
        sums = np.zeros((len(self.log_ratios), len(s.counts)))
        for kind, (where, row) in enumerate(_grams(s)):
            for c, each in enumerate(self.log_ratios[:, kind]):
                sums[c] += np.bincount(row, each[where].astype(np.float64), len(s.counts))
        with np.errstate(divide="ignore"):
            return -np.logaddexp.reduce(np.vstack((np.zeros(len(s.counts)), sums)) + np.log(self.shares)[:, None])

    @property
    def edge(self) -> float:
        """The weight from which a document may be of the target: with a chance of at least LEAST."""
        return float(np.log(LEAST / self.shares[0])) if self.shares[0] > 0 else float("-inf")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest hashes of each text's five-word shingles: near copies mostly have the same."""
    hasher = WordHasher()
    for batch in batches:
        for s in hasher.stretches(batch.column(1)):
            hashes, row = shingles(s)
            part = slice(s.first, s.first + len(s.counts))
            columns = []
            for k in range(PRINTS):
                least = np.full(len(s.counts), np.uint64(2**64 - 1))
                np.minimum.at(least, row, mix64(hashes ^ np.uint64(k * 0x51ED270B4F35A1)))
                columns.append(pa.array(least.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[part], *columns], ["id", *(f"p{k}" for k in range(PRINTS))])


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and class of all labelled documents; of near copies of one class one stays."""
    kind = F.when(F.coalesce("toxic", F.lit(0)) != 0, TOXIC).when(F.col("quality") == 1, TARGET).otherwise(POOR)
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    own_id = F.col(id_col).try_cast(texts.schema["id"].dataType)  # an id that is no value of the documents' type has no document
    usable = labels.where(own_id.isNotNull() & (F.col("quality").isNotNull() | (F.coalesce("toxic", F.lit(0)) != 0))).select(own_id.alias("id"), kind.alias("class"))
    usable = stash(usable.groupBy("id").agg(F.max("class").alias("class")), "labelled")
    some = may_hold(texts, "id", bloom_of(usable, "id", usable.count())).select("id", "text")
    kept = stash(some.mapInArrow(_prints, f"id {dict(texts.dtypes)['id']}, " + ", ".join(f"p{k} long" for k in range(PRINTS))), "prints")
    kept = kept.dropDuplicates(["id"]).join(usable, "id")
    for k in range(PRINTS):
        others = [F.min_by(c, "id").alias(c) for c in kept.columns if c not in ("id", "class", f"p{k}")]
        kept = kept.groupBy("class", f"p{k}").agg(F.min("id").alias("id"), *others)
    return stash(kept.select("id", "class"), "classes")


def classed_texts(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All texts with their class, -1 without one. Texts that have none by a filter of the ids stay where they are, however many have one."""
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    texts = probe(texts, "id", *bloom_of(classes, "id", classes.count()), "_may")
    may = F.col("_may") & F.col("id").isNotNull()
    some = texts.where(may).join(classes.hint("shuffle_hash"), "id", "left").select("text", F.coalesce("class", F.lit(-1)).alias("class"))
    return some.unionByName(texts.where(~may).select("text", F.lit(-1).alias("class")))


def fit(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> Model | None:
    """The models: raw text counts all documents, a class all its labelled ones."""
    shares = np.zeros(3)
    for r in classes.groupBy("class").count().collect():
        shares[r["class"]] = r["count"]
    if not shares[TARGET] or not shares[1:].any():
        return None
    width = min(KINDS * RANGES, shuffle_width(docs.sparkSession))
    sums = classed_texts(docs, classes, id_col, text_col).mapInArrow(_count, COUNTS).repartition(width, "chunk").mapInArrow(_add, "chunk int, counts binary, " + ", ".join(f"{t} long" for t in TOTALS))
    sums = stash(sums, "counts")
    totals = np.zeros((KINDS, 7))
    for r in sums.groupBy(F.floor(F.col("chunk") / RANGES).alias("kind")).agg(*[F.sum(t).alias(t) for t in TOTALS]).collect():
        totals[r["kind"]] = [r[t] for t in TOTALS]
    found = np.zeros((2, KINDS, BUCKETS), np.float32)
    for r in sums.select("chunk", "counts").mapInArrow(_ratios(totals), "chunk int, ratios binary").collect():  # 2 * KINDS * BUCKETS numbers
        kind, part = divmod(r["chunk"], RANGES)
        found[:, kind, part * CHUNK : (part + 1) * CHUNK] = np.frombuffer(r["ratios"], np.float32).reshape(2, CHUNK)
    return Model(shares / shares.sum(), found)


def weigh(docs: DataFrame, model: Callable[[], Model], id_col: str, text_col: str, seed: int) -> tuple[DataFrame, str, str]:
    """The rows of docs with their weight and draw, a whole number in the order of the weight plus Gumbel noise.

    The noise is keyed by id and text, so reruns and retries agree. Returns
    the names of the two columns too: they are none of docs' own.
    """
    names, text_at = docs.columns, len(docs.columns)
    weight_col, draw_col, text, noise_col = unused(docs, "log_weight", "draw", "_text", "_noise")
    own_text = docs[f"`{text_col}`"]
    keyed = docs.select("*", own_text.alias(text), F.xxhash64(docs[f"`{id_col}`"], own_text, F.lit(seed)).alias(noise_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, fitted = WordHasher(HEAD, tail=TAIL), model()
        for batch in batches:
            weight = np.zeros(batch.num_rows)
            for s in hasher.stretches(batch.column(text_at)):
                weight[s.first : s.first + len(s.counts)] = fitted.weights(s)
            noise = mix64(batch.column(text_at + 1).to_numpy().view(np.uint64))
            uniform = ((noise >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            bits = (weight - np.log(-np.log(uniform))).view(np.int64)
            draw = bits ^ ((bits >> 63) & np.int64(2**63 - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], pa.array(weight), pa.array(draw)], [*names, weight_col, draw_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return keyed.mapInArrow(run, f"{schema}, `{weight_col}` double, `{draw_col}` long"), weight_col, draw_col


def kth_largest(draws: DataFrame, k: int) -> int:
    """The k-th largest draw, found 16 bits at a time from counts of at most 65,536 values."""
    left, known = k, 0
    for shift in (48, 32, 16, 0):
        high = F.shiftright("draw", shift)
        pool = draws if shift == 48 else draws.where(F.shiftright("draw", shift + 16) == known)
        for r in sorted(pool.groupBy(high.alias("h")).count().collect(), key=lambda r: -r["h"]):
            if left <= r["count"]:
                known = r["h"]
                break
            left -= r["count"]
    return known


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 6) -> tuple[DataFrame, int | None, Callable[[], Model]]:
    """Weigh all rows and find where Gumbel top-k ends.

    The weight of a text is log(target / raw): the probability under the
    n-gram model of the target, over that under the raw text's. Target text is
    that of labelled rows with quality 1 and toxic 0. Raw text is a mixture of
    what the labels tell apart, in their shares: target, toxic, poor; the
    models are smoothed by one of all documents. All labelled rows are used,
    one of near copies. k is the number of rows that are of the target with a chance of LEAST or more;
    the noise is Gumbel's own, so rows below that edge come in as often as
    their weight says, and push out as many. Repeated label rows count once,
    as the worst of them; a label without a document has no effect. Without a
    labelled row of the target and one of another class all rows are kept.

    Returns the weighed ids (id_col, log_weight, draw), the k-th largest draw
    (None: keep all) and what gives a task the model. Rows that tie at it are all
    kept. A null or empty text has the weight of a text without evidence. Other columns are not read.
    """
    spark = docs.sparkSession
    fitted = fit(docs, labelled_rows(docs, labels, id_col, text_col), id_col, text_col)
    plain = docs.select(docs[f"`{id_col}`"].alias(id_col), docs[f"`{text_col}`"].alias(text_col))
    shares, found = (fitted.shares, fitted.log_ratios) if fitted else (np.ones(1), np.zeros((0, KINDS, BUCKETS), np.float32))
    sent = spark.sparkContext.broadcast((shares, found))  # arrays only: executors need not have this package

    def model() -> Model:
        return Model(*sent.value)

    weights = stash(weigh(plain, model, id_col, text_col, seed)[0].select(id_col, "log_weight", "draw"), "weights")
    k = weights.where(F.col("log_weight") >= fitted.edge).count() if fitted else 0
    return weights, (kth_largest(weights, k) if k else None), model


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The sample's ids with log_weight and draw; rejected documents are left out."""
    weights, least, _ = resample(docs, labels, id_col, text_col, **options)
    return weights if least is None else weights.where(F.col("draw") >= least)


def keep_sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 6, **options) -> DataFrame:
    """The sampled rows of docs, whole, with docs' own columns; each row decides for itself, so nothing of them is shuffled.

    Columns of any name are carried through. Null and empty texts, repeated
    rows and empty tables are as in resample.
    """
    _, least, model = resample(docs, labels, id_col, text_col, seed=seed, **options)
    if least is None:
        return docs
    weighed, _, draw = weigh(docs, model, id_col, text_col, seed)
    return weighed.where(F.col(f"`{draw}`") >= least).select(*[f"`{c}`" for c in docs.columns])
