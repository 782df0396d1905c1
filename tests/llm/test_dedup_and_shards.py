import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from typedlake.llm.common import join_groups, running_total
from typedlake.llm.exact_dedup import exact_dedup
from typedlake.llm.jaccard_join import fold, jaccard_components, needed, one_of_each, stray_candidates
from typedlake.llm.mixing import closing_counts, mix, mixed_texts, permuted, shard_counts, taken_of, targets_of
from typedlake.llm.sharding import cut, shard, smallest_capacity

import numpy as np
import pytest


def test_exact_dedup(odd):
    source = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = defaultdict(list)
    for i, t in source:
        groups[bare(t)].append((-len(t), i is None, i))
    wanted = Counter((i, min(groups[bare(t)])[2], len(groups[bare(t)]), hashlib.sha256(bare(t).encode()).hexdigest()) for i, t in source)
    got = exact_dedup(odd).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == wanted
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_with_a_full_filter(odd):
    few = {tuple(r) for r in exact_dedup(odd, max_bits=32_768, bits_per_row=1).drop("kept").collect()}
    assert few == {tuple(r) for r in exact_dedup(odd).drop("kept").collect()}


def test_empty_tables(nothing):
    assert exact_dedup(nothing).count() == 0 and shard(nothing).count() == 0 and jaccard_components(nothing).count() == 0
    assert taken_of(*mix(nothing)).count() == 0 and mixed_texts(nothing).count() == 0 and one_of_each(nothing).count() == 0


def test_carried_columns(odd):
    got = exact_dedup(odd, carry=("text", "kept", "id"))
    assert got.count() == odd.count() and got.columns[-3:] == ["text", "doc_kept", "id"]
    both = exact_dedup(odd.withColumn("doc_kept", F.lit(1)), carry=("kept", "doc_kept"))
    assert both.columns[-2:] == ["doc_kept", "doc_doc_kept"] and both.select("doc_doc_kept").distinct().count() == 1


def test_shards(odd):
    got = shard(odd, shards=7).collect()
    source = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == source
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(7))
    assert all(len(s) == 1 for s in of_text.values())
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_hot_text_has_its_own_shard(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    got = shard(rows, shards=10).groupBy("shard").agg(F.sum("size").alias("b"), F.count("slot").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert all(r["m"] == r["n"] - 1 and r["d"] == r["n"] for r in got) and len(got) == 10
    others = sorted(r["b"] for r in got)[:-1]
    assert others[-1] < 1.05 * others[1]


def test_smallest_capacity_is_the_smallest():
    rng = np.random.default_rng(1)
    for _ in range(100):
        sizes = rng.integers(1, 30, rng.integers(1, 12)).tolist()
        shards = int(rng.integers(1, 6))
        c = smallest_capacity(sizes, shards)
        assert len(cut(sizes, c, shards)) <= shards
        assert c == 0 or len(cut(sizes, c - 1, shards)) > shards


def test_jaccard(odd):
    source = [(r["doc_id"], r["text"]) for r in odd.collect()]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in source]
    parent = list(range(len(source)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(source)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(source):
        if i is not None:
            least[root(k)].append(i)
    wanted = Counter((i, len(sets[k]), min(least[root(k)], default=None) if sets[k] else i) for k, (i, _) in enumerate(source))
    assert Counter(tuple(r) for r in jaccard_components(odd).collect()) == wanted
    # lists and groups in chunks, and shingles gathered by rows, give the same components
    assert Counter(tuple(r) for r in jaccard_components(odd, together=3, hot=2).collect()) == wanted
    stay = {}  # of a component its least id, and of that id's texts one
    for k, (i, t) in enumerate(source):
        if i is not None and i == min(least[root(k)]):
            stay.setdefault((root(k) if sets[k] else (i, t)), (i, t))
    left = one_of_each(odd)
    ids = Counter(r["doc_id"] for r in left.select("doc_id").collect())
    assert left.columns == odd.columns and ids[None] == sum(i is None for i, _ in source)
    assert Counter({i: n for i, n in ids.items() if i is not None}) == Counter(i for i, _ in stay.values())


def test_rows_of_one_id_that_are_no_copies_stay(spark):
    import random

    from .conftest import words

    rng = random.Random(3)
    a, b, c = (words(rng, 40) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, a + " x"), (3, c), (4, b), (None, a)]
    left = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in left.collect()) == Counter([(1, a), (1, b), (3, c), (None, a)])


def test_count_vectors_rule_out_no_link_across_chunks():
    rng = np.random.default_rng(4)
    base = [np.bincount(rng.integers(0, 16, 100), minlength=16) for _ in range(3)]
    vectors = [np.maximum(b + rng.integers(-1, 2, 16), 0) for b in base for _ in range(6)]
    vectors += [np.repeat(v, 2) // 2 for v in vectors[:4]]  # twice the groups
    sizes = np.array([v.sum() for v in vectors])
    stray, main = rng.random(len(vectors)) < 0.5, np.zeros(len(vectors), bool)
    got = set(stray_candidates(np.arange(len(vectors)), sizes, vectors, stray, main, 80))
    plain = set()
    for q in np.flatnonzero(stray):
        for o in np.flatnonzero(~stray):
            g = min(len(vectors[q]), len(vectors[o]))
            bound = np.minimum(fold(vectors[q], g), fold(vectors[o], g)).sum()
            if bound >= needed(sizes[q], sizes[o], 80) and 80 * sizes[q] <= 100 * sizes[o] and 80 * sizes[o] <= 100 * sizes[q]:
                plain.add((q, o))
    assert got == plain and plain


def test_mix(odd):
    got = taken_of(*mix(odd, block=4), block=4).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in odd.collect())
    by_source = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_source[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(t - target) <= 0.02 * target + 8 for (_, target), t in by_source.items())
    assert sorted(map(str, got)) == sorted(map(str, taken_of(*mix(odd, block=4), block=4).collect()))
    texts = mixed_texts(odd, block=4)
    taken = {k: v for k, v in Counter(x for r in got for x in [r["doc_id"]] * r["taken"]).items()}
    mixed = Counter(x for r in texts.select("doc_id", "text").collect() for x in [r["doc_id"]] * len(r["text"].split(" ")))
    assert texts.columns == odd.columns and mixed == taken


def test_shards_are_multinomial_and_their_sums_near_the_targets():
    share = np.array([5.0, 3.0, 2.0, 0.0])
    draws = np.array([shard_counts(1000, share, 7, at) for at in range(400)])
    assert (draws.sum(1) == 1000).all() and (draws[:, 3] == 0).all()
    assert np.allclose(draws.mean(0), [500, 300, 200, 0], atol=5)
    assert np.allclose(draws.var(0)[:3], [250, 210, 160], rtol=0.3)  # n p (1 - p)
    assert (draws == [shard_counts(1000, share, 7, at) for at in range(400)]).all()
    closing = np.array(closing_counts([1000] * 64, 6400 * share, 7, 0))
    assert np.abs(closing.sum(0) - 6400 * share).max() < 100 and closing[:32, 0].std() > 8
    assert shard_counts(0, share, 7, 0).sum() == 0 and shard_counts(5, np.zeros(2), 7, 0).sum() == 0


def test_targets():
    assert targets_of([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    out = targets_of([10, 1000, 0], [3, 1, 2])
    assert out[0] == 30 and out[2] == 0 and sum(out) == 1010
    assert targets_of([], []) == [] and targets_of([0], [1]) == [0]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    assert sorted(permuted(np.arange(n), n, (1, 2))) == list(range(n))


def test_running_total_and_join_groups(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), "id", F.lit(2).alias("v"))
    got = running_total(rows, ["g"], ["id"], "v", "before", 5000, cell_rows=100).groupBy("g").agg(F.sort_array(F.collect_list("before")).alias("x")).collect()
    assert all(r["x"] == list(range(0, 5000, 2)) for r in got)
    groups = rows.groupBy("g").agg(F.count("id").alias("c"))
    assert join_groups(rows, groups, "g", "c", 5000).count() == 5000
