import random

import numpy as np
import pyarrow as pa
import pytest

from typedlake.llm import decontaminate

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, row string, kept string, shard string, id string, key string, n string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 5))) for _ in range(n))


def edited(text, rng, changes):
    out = text.split(" ")
    for _ in range(changes):
        out[rng.randrange(len(out))] = words(rng, 1)
    return " ".join(out)


def plain_cosines(texts, items, fitted, seed=4):
    """Cosines of the items' windows in a latent space fitted on every window of every text, which weigh together as fitted texts."""
    hasher = decontaminate.WordHasher(bare=True)
    terms = [decontaminate.terms_of(next(hasher.stretches(pa.array([t or ""]))).hashes) for t in texts]
    idf = np.log((len(texts) + 1) / (np.bincount(np.concatenate([np.unique(t) for t in terms]), minlength=decontaminate.TERMS) + 1))
    own = [decontaminate.terms_of(x) for item in items for x in decontaminate.item_windows(item)]
    windows = [t[a : a + 16] for t in terms for a in range(0, len(t), 16)]
    weights = np.array([[min(1, fitted / len(texts))]] * len(windows) + [[decontaminate.EMPHASIS]] * len(own))
    used = np.unique(np.concatenate(windows + own))
    rows = np.zeros((len(weights), len(used)))
    for row, t in zip(rows, windows + own, strict=True):
        np.add.at(row, np.searchsorted(used, t), idf[t])
        row /= np.sqrt((idf[t] ** 2).sum())
    y = rows @ np.random.default_rng(seed).standard_normal((decontaminate.TERMS, decontaminate.RANK)).astype(np.float32)[used].astype(float)
    values, vectors = np.linalg.eigh(y.T @ (weights * y))
    right, strength, _ = np.linalg.svd(rows.T @ (weights * y) @ (vectors / np.sqrt(values)), full_matrices=False)
    out = np.array([(idf[t][:, None] * right[np.searchsorted(used, t)] / strength).sum(0) for t in own])
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    return out @ out.T


def build():
    """Rows with every oddity: nulls, empty and blank texts, a very long one, copies, near copies, repeated rows and ids."""
    rng = random.Random(11)
    plain = [words(rng, rng.randint(3, 120)) for _ in range(60)]
    base = words(rng, 200)
    texts = [*plain, None, "", " \t\n", "one", "one two three four", words(rng, 30_000), "a\x85b c\xa0d é"]
    texts += [base, base.upper(), base.replace(" ", "\n"), "  " + base] + [edited(base, rng, k) for k in (1, 1, 2, 3, 3, 30)] + ["x" * 50_000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, plain[4], "en", "s1", 9), (None, plain[5], None, "s0", None), (None, None, None, None, None)]
    return [(*r, "x", "x", "x", "x", "x", "x", "x") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(build(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
