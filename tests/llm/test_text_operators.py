import hashlib
import html
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from typedlake.llm import chat, decontaminate, pii, quality
from typedlake.llm.elias_fano import Level, pack, unpack
from typedlake.llm.html_text import FEATURES, LABELLED, decide, extract, labelled_table, main_text, train_tree
from typedlake.llm.lm_score import lm_scores
from typedlake.llm.quality import ERRORS, FACTORS, RAW, classed_texts, keep_sampled, kth_largest, ratios, sampled, weigh
from typedlake.llm.words import WordHasher, ngrams, shingles

from ..conftest import DATA
from .conftest import edited, plain_cosines, words

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_word_hashes():
    texts = [None, "", "A b a", " é  É\n", "x", "a b", "longer words here\tand é", "a\x85b"]
    seen = {}
    for s in WordHasher().stretches(pa.array(texts).slice(0), rows=3):
        for r, n in enumerate(s.counts):
            own = tokens(texts[s.first + r])
            assert len(own) == n
            for w, h in zip(own, s.hashes[s.starts[r] : s.starts[r + 1]]):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    sliced = [s.counts.tolist() for s in WordHasher().stretches(pa.array(texts).slice(2, 3))]
    assert sliced == [[3, 2, 1]]


def test_ngrams_and_shingles():
    (s,) = WordHasher().stretches(pa.array(["a b c d e f", "a b c d e", "a b", ""]))
    h, r = shingles(s)
    assert r.tolist() == [2, 0, 0, 1] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert ngrams(s, 7)[0].size == 0


# HTML extraction

PAGES = {
    '<html><body><nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>One<b> two</b><br>three\n four<p>Five</article><footer>&copy; us</footer>': "A & B One two three four Five",
    '<div class="cookie-notice">We use cookies.</div><main><p>Text here &lt;kept&gt;.</p><form><p>Sign up</p><input></form><aside>Side bar</aside></main>': "Text here <kept>.",
    '<article><p>Body<script>var a="<p>no</p>";</script><style>p{}</style> text.</p><!-- <p>no</p> --></article><div id="comments"><p>Nice post, thank you all so much for writing it down for us here.</p></div>': "Body text.",
    "": "",
    "<article>": "",
    "<p": "",
}


TREE = train_tree(labelled_table(LABELLED))


def test_html_pages():
    for page, text in PAGES.items():
        assert main_text(page, TREE) == text
    assert main_text(None, TREE) == ""
    long = " ".join(["word"] * 80)
    assert main_text(f'<body><a href="/">a</a><div><p>{long}</p><p>{long}</p></div><div class="ad">buy</div></body>', TREE) == f"{long} {long}"


def test_html_as_pages_have_it():
    many = lambda n, mark: " ".join(["word"] * n + [mark])
    cases = {
        "<article><p><a href=/it's>link</a> and the rest</p><p>Second.</p></article>": "link and the rest Second.",
        "<article><!--><p>Kept.</p><!---><p>Too.</p><!-- no --!><p>End.</p></article>": "Kept. Too. End.",
        f'<article><p>{many(20, "A")}</p><div class="legal"><p>{many(20, "B")}</p></div><div class="discussion"><p>{many(20, "C")}</p></div></article>': f"{many(20, 'A')} {many(20, 'B')} {many(20, 'C')}",
        f"<p>Short line.</p><p>{many(9, 'end')}</p>": f"Short line. {many(9, 'end')}",
        f"<article><p>{many(8, 'x')}</p><p>{many(4, 'y')} <a href=z>{many(3, 'z')}</a></p></article>": f"{many(8, 'x')} {many(4, 'y')} {many(3, 'z')}",
        f"<ul><li><a href=1>{many(6, 'menu')}</a></ul><p>{many(30, 'text')}</p>": many(30, "text"),
        f"<main><p>{many(30, 'text')}<form><p>Sign up now</form><p>Last.</main>": f"{many(30, 'text')} Last.",
        "<article><p title='a > b'>Quoted.</p><p data-x=\"<p>no</p>\">Text.</p></article>": "Quoted. Text.",
    }
    for page, text in cases.items():
        assert main_text(page, TREE) == text, page


def test_html_takes_linear_time():
    import time

    n = 60_000
    for page in ("<b>" * n + "</i>" * n, "<p><div>" + "<b>" * n + "<p></p>" * n, "<div>" * n + "</div>" * n, '<a href="' * n, "<a x='" * n, "<!--" * n, "<a " + "x=" * n, "<li><ul>" * n + "<li>" * n, "</" * n, "<" * n):
        began = time.time()
        main_text(page, TREE)
        assert time.time() - began < 10


def test_tree_learns_its_pages():
    table = labelled_table(LABELLED)
    assert all(decide(TREE, row[:-1]) == bool(row[-1]) for row in table)
    used = lambda t: set() if isinstance(t, int) else {FEATURES[t[0]]} | used(t[2]) | used(t[3])
    assert used(TREE) >= {"words", "link_density", "words_before", "words_after", "aside", "main"}


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test tables")
def test_html_against_a_plain_parser():
    """Every page of the small table: what stands in its article, by the standard library's parser."""
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.skip, self.parts = 0, 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.skip += tag in ("script", "style")
            if tag not in ("a", "b", "i", "em", "strong", "span"):
                self.parts.append(" ")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.parts.append(data)

    for r in pq.read_table(f"{DATA}/sf0.001/pages.parquet").to_pylist():
        plain = Plain()
        plain.feed(r["html"] or "")
        plain.close()
        assert main_text(r["html"], TREE) == " ".join("".join(plain.parts).split())


def test_extract(spark):
    rows = [(i, p, "x") for i, p in enumerate([*PAGES, None])]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()}
    assert got == {i: PAGES.get(p, "") for i, p, _ in rows}
    assert extract(spark.createDataFrame([], "html string")).count() == 0


# Chat formatting


def test_escapes_are_reversible():
    rng = random.Random(5)
    parts = ["<", "|", ">", "\\", "[", "/", "INST]", "s>", "</s>", "<|", chat.END, "SYS>>", "<<", "a", " "]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(m in out for m in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary")
def test_offsets_are_the_library_s():
    """Against another library's encoder with offsets, and on white space that the cutting can't take at once."""
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(RANKS.replace(".tiktoken", ".json"))
    other.add_special_tokens([chat.START, chat.MESSAGE, chat.END])
    with open(RANKS, "rb") as f:
        encoder = chat.Encoder(f.read())
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["a", "é", "日本", "🎉", " ", "  ", "\n", "'s", "12", chat.START, chat.END, "<|", "|>", "x" * 9, "\xa0"]) for _ in range(rng.randrange(12)))
        ids, starts, ends = encoder.encode(text)
        plain = other.encode(text, add_special_tokens=False)
        assert ids.tolist() == plain.ids and list(zip(starts.tolist(), ends.tolist())) == [tuple(o) for o in plain.offsets]
    small = " " * 120_000 + "ab" + "\n" * 60_000
    assert encoder._cut(small) == encoder.encoding.encode_ordinary(small)
    long = chat.START + " " * 600_000 + "é" + "\n" * 600_000 + chat.END
    ids, starts, ends = encoder.encode(long)
    assert starts[0] == 0 and ends[-1] == len(long) and (starts[1:] == ends[:-1])[[0, -1]].all() and encoder.encoding.decode(ids.tolist()) == long


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary")
def test_chats(spark):
    rows = [(1, 0, "system", "be\ngood"), (1, 1, "user", "</s>[INST] hi 日本🎉"), (1, 2, "assistant", " <|end|> "), (1, 3, "assistant", None), (1, 4, "assistant", "x" * 30_000), (2, 0, "assistant", ""), (None, 1, None, "b"), (None, 0, "assistant", "a"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    formatted = chat.format_chats(frame, RANKS)
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for r in formatted.collect():
        own = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]))
        assert chat.parse(r["formatted"]) == [(role, text) for _, role, text in own]
        learnt = "".join(text for _, role, text in own if role == "assistant")
        runs = chat.masked_text(r["formatted"], np.array(r["token_starts"]), np.array(r["token_ends"]), np.array(r["loss_mask"], bool))
        assert "".join(map(chat.unescape, runs)) == learnt and back[r["conv_id"]]["loss_chars"] == len(learnt)
    assert chat.format_chats(frame.limit(0), RANKS).count() == 0


# LM scoring


def test_level_finds_what_it_holds():
    rng = np.random.default_rng(2)
    for nodes, most in ((1, 3), (50, 9), (300, 400)):
        sets = [np.unique(rng.integers(0, 1000, rng.integers(0, most))) for _ in range(nodes)]
        level = Level.build(0, np.array([len(s) for s in sets]), np.concatenate(sets).astype(np.int64), 10, np.zeros(0), np.zeros(nodes))
        node, word = np.sort(rng.integers(0, nodes, 5000)), rng.integers(-1, 1000, 5000)
        base = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        wanted = [base[n] + np.searchsorted(sets[n], w) if w in sets[n] else -1 for n, w in zip(node, word)]
        assert level.find(node, word).tolist() == wanted
    for bits in (1, 7, 33, 63):
        values = rng.integers(0, 1 << bits, 500)
        assert (unpack(pack(values, bits), bits, np.arange(500)) == values).all()


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores(odd, order):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    grams = [Counter() for _ in range(4)]
    for i, t in docs:
        w = [*tokens(t), None]
        if not held(i):
            for n in (1, 2, 3):
                grams[n].update(zip(*(w[k:] for k in range(n))))
    total, kinds = sum(grams[1].values()), len(grams[1])
    contexts = [None, None, *({"n": Counter(), "d": Counter()} for _ in range(2))]
    for n in (2, 3):
        for g, c in grams[n].items():
            contexts[n]["n"][g[:-1]] += c
            contexts[n]["d"][g[:-1]] += 1

    def p(gram):
        if len(gram) == 1:
            return (grams[1][gram] + 1) / (total + kinds + 1)
        n, d = (contexts[len(gram)][k][gram[:-1]] for k in "nd")
        return (grams[len(gram)][gram] + d * p(gram[1:])) / (n + d) if d else p(gram[1:])

    got = Counter()
    for r in lm_scores(odd, order=order).collect():
        got[r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"] / r["n_tokens"], 2)] += 1
    wanted = Counter()
    for i, t in docs:
        w = [*tokens(t), None]
        score = sum(math.log10(p(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w)))
        wanted[i, held(i), len(w), sum((x,) in grams[1] for x in w), total, round(sum(math.log10(p((x,))) for x in w), 4), round(score / len(w), 2)] += 1
    assert sum((wanted - got).values()) <= 2  # quantised scores may round the other way


def test_lm_empty(nothing, spark):
    assert lm_scores(nothing).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {r["score"] for r in lm_scores(only).collect()} == {0.0}


# Decontamination


def test_leaks(spark):
    rng = random.Random(8)
    items = [words(rng, rng.randint(15, 50)) for _ in range(12)]
    texts = [words(rng, 300) for _ in range(40)]
    planted = {k: items[k] for k in range(6)} | {6: items[6].upper().replace(" ", " *** "), 7: edited(items[7], rng, len(items[7].split()) // 8)}
    rows = [(i, (t + " " + planted[i] + " " + t[:100]) if i in planted else t) for i, t in enumerate(texts)]
    rows += [(100, None), (101, ""), (102, " "), (None, items[0]), (0, rows[0][1]), (103, items[1]), (104, "x" * 40_000), (105, words(rng, 30_000) + " " + items[2])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item string")
    benchmark = spark.createDataFrame([*enumerate(items), (50, None), (51, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found == {(k, k) for k in planted} | {(None, 0), (103, 1), (105, 2)}
    clean = decontaminate.without_leaks(docs, benchmark)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in found}
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0 and decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_leaks_in_capitals(spark):
    rng = random.Random(18)
    accented = str.maketrans("aeiou", "áéíóú")
    items = [words(rng, 20).translate(accented), words(rng, 25).translate(str.maketrans("abcdefgh", "абвгдежз"))]
    docs = spark.createDataFrame([(k, words(rng, 100) + " " + x.upper() + " " + words(rng, 100)) for k, x in enumerate(items)] + [(2, words(rng, 300))], "doc_id long, text string")
    for texts, known in ((docs, items), (docs.withColumn("text", F.lower("text")), [x.upper() for x in items])):
        benchmark = spark.createDataFrame([*enumerate(known)], "item_id long, text string")
        assert {(r["doc_id"], r["item_id"], r["overlap"]) for r in decontaminate.leaks(texts, benchmark).collect()} == {(0, 0, 1.0), (1, 1, 1.0)}
        assert decontaminate.without_leaks(texts, benchmark).collect() == texts.where("doc_id = 2").collect()


def test_short_leaks_among_rarer_words(spark):
    rng = random.Random(28)
    items = [words(rng, n) for n in range(4, 13) for _ in range(4)]
    numbers = lambda n: " ".join(str(rng.randrange(10**9)) for _ in range(n))
    texts = [numbers(50 + k) + " " + x + " " + numbers(50) for k, x in enumerate(items)]
    plain = [" ".join(items) for _ in range(20)]  # makes the items' words common
    docs = spark.createDataFrame([*enumerate(texts), *((1000 + i, t) for i, t in enumerate(plain))], "doc_id long, text string")
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).where("overlap = 1 and cosine is not null").collect()}
    assert found >= {(k, k) for k in range(len(items))}
    assert {r["doc_id"] for r in decontaminate.without_leaks(docs, benchmark).collect()} == set()


def _plain_overlap(words_, item):
    """Longest common subsequence by the table, and how much of the answer is in it."""
    n, answer = len(item), len(item) - -(-len(item) // 4)
    row = [(0, 0)] * (n + 1)
    for w in words_:
        new = [(0, 0)]
        for k, x in enumerate(item):
            new.append((row[k][0] + 1, row[k][1] + (k >= answer)) if w == x else max(row[k + 1], new[k]))
        row = new
    return row[n]


def test_recall_of_paraphrases(spark):
    """Every document and item by brute force, under the rule: three quarters in order, or half and four fifths of the answer."""
    rng = random.Random(38)
    items = [words(rng, rng.randint(24, 50)).split() for _ in range(40)]
    docs = []
    for k, item in enumerate(items):
        answer = len(item) - -(-len(item) // 4)
        way = k % 4
        kept = [w for p, w in enumerate(item) if way == 0 or (way == 1 and rng.random() < 0.85) or (way == 2 and (p >= answer or rng.random() < 0.6)) or (way == 3 and rng.random() < 0.8)]
        if way == 3:
            kept = [x for w in kept for x in ([w, words(rng, 1)] if rng.random() < 0.2 else [w])]
        docs.append(words(rng, 60).split() + kept + words(rng, 60).split())
    docs += [words(rng, 150).split() for _ in range(40)]
    truth = set()
    for d, text in enumerate(docs):
        for k, item in enumerate(items):
            n = len(item)
            for at in range(0, len(text), 8):
                length, answered = _plain_overlap(text[max(0, at - n) : at + 16 + n], item)
                if length >= 0.75 * n or (length >= 0.5 * n and answered >= 0.8 * -(-n // 4)):
                    truth.add((d, k))
                    break
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, benchmark).collect()}
    assert len(truth) >= 30 and len(found & truth) >= 0.9 * len(truth) and len(found - truth) <= 0.05 * len(found)


def test_fit_on_all_documents(spark):
    """The fit against a plain one on every window of every document, where documents outnumber the fit's weight."""
    rng = random.Random(48)
    texts = [*(words(rng, rng.randint(1, 90)) for _ in range(300)), words(rng, 3000), None, "", " - "]
    items = [words(rng, n) for n in (5, 16, 24, 40)]
    texts += [items[3]] * 40
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    for fitted, width in ((8, 7), (1000, 1)):
        spaces = list(decontaminate.spaces(docs.repartition(width), benchmark, "text", "item_id", "text", None, fitted, 4))
        assert len(spaces) == 1 and np.abs(spaces[0].windows @ spaces[0].windows.T - plain_cosines(texts, spaces[0].items, fitted)).max() < 1e-3


def test_common_length():
    item = decontaminate.Item(0, np.array([1, 2, 3, 4, 5], np.uint64), 3, {1: 1, 2: 2, 3: 4, 4: 8, 5: 16})
    assert decontaminate.common_length(np.array([9, 1, 3, 9, 5, 2], np.uint64), item)[0] == 3


# Quality


def test_quality(spark):
    rng = random.Random(9)
    good = [words(rng, rng.randint(20, 60)) for _ in range(300)]
    junk = [" ".join(w + "###" for w in words(rng, 40).split()) for _ in range(60)]
    toxic = [edited(g, rng, 2) + " zzscum" + rng.choice("abc") + " vvfool" for g in good[:60]]
    texts = good + junk + toxic + [None, "", " "]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, good[0], "x", "y", "z")], "doc_id long, text string, draw string, log_weight string, _text string")
    labels = spark.createDataFrame([(i, int(i < 300 or i >= 360), int(i >= 360)) for i in range(0, 420, 2)] + [(0, 1, 0), (9999, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in sampled(docs, labels).collect()}
    assert len(kept & set(range(300))) >= 295 and len(kept & set(range(300, 420))) <= 3
    left = keep_sampled(docs, labels)
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == kept and left.columns == docs.columns and left.first()["draw"] == "x"
    assert sampled(docs, labels.limit(0)).count() == docs.count() and sampled(docs.limit(0), labels).count() == 0


def test_texts_with_their_classes(spark, odd):
    """Null, repeated and unlabelled ids: every row once, with its own class."""
    classes = spark.createDataFrame([(3, 1), (60, 0), (61, 2), (9999, 0)], "id long, class int")
    own = {3: 1, 60: 0, 61: 2}
    expected = sorted((own.get(r["doc_id"], -1), r["text"] or "") for r in odd.collect())
    got = classed_texts(odd, classes, "doc_id", "text").collect()
    assert sorted((r["class"], r["text"] or "") for r in got) == expected


def test_counts_of_tasks_add_up():
    """Tables of counts that need one, two and four bytes, from two tasks, against a plain count of words."""
    texts, labels = ["one two", "one " * 300, "two " * 70_000, "three"], [0, 1, 2, -1]
    tasks = [pa.RecordBatch.from_arrays([pa.array(texts[k::2]), pa.array(labels[k::2], pa.int32())], ["text", "class"]) for k in (0, 1)]
    sent = [b for t in tasks for b in quality._count(iter([t]))]
    got = {r["chunk"]: r for b in quality._add(iter(sent)) for r in b.to_pylist()}
    assert {len(c) // quality.CHUNK for b in sent for c in b.column(2).to_pylist()} == {1, 2, 4}
    sums = np.stack([np.frombuffer(got[k]["counts"], np.int64).reshape(7, quality.CHUNK) for k in range(quality.RANGES) if k in got])
    assert sorted(sums[:, 0][sums[:, 0] > 0].tolist()) == [1, 301, 70_001]
    assert sums.sum((0, 2)).tolist() == [70_303, 2, 300, 70_000, 2, 1 + 8, 1 + 16] == [sum(got[k][t] for k in got if k < quality.RANGES) for t in quality.TOTALS]


def test_ratios_against_a_plain_count():
    rng = np.random.default_rng(3)
    raw, counts, documents = np.zeros(60), np.zeros((3, 60)), np.zeros((3, 60))
    raw[:50] = rng.integers(50, 500, 50)
    counts[:, :50] = rng.integers(0, 60, (3, 50))
    counts[1, :5] += 400
    documents[:, :50] = np.minimum(counts[:, :50], 40)
    got = ratios(raw, counts, documents, np.array([raw.sum(), *counts.sum(1), *documents.sum(1)]))
    for c in (1, 2):
        n = [counts[k].sum() for k in range(3)]
        d = [documents[k].sum() for k in range(3)]
        for b in range(50):
            p = [(1 - RAW) * counts[k, b] / n[k] + RAW * raw[b] / raw.sum() for k in (c, 0)]
            here, there = documents[c, b], documents[0, b]
            e = (here + there) * d[c] / (d[c] + d[0])
            g = 2 * sum(x * math.log(x / y) for x, y in ((here, e), (there, here + there - e)) if x)
            log = math.log(p[0] / p[1])
            assert math.isclose(got[c - 1, b], log if g >= ERRORS**2 and abs(log) >= FACTORS[c] else 0.0, abs_tol=1e-3)
    assert (got[:, 50:] == 0).all() and (got != 0).any()


class _Fixed:
    """A model whose weight is 0 for long texts and -1 for the others."""

    weights = staticmethod(lambda s: np.where(s.counts > 1, 0.0, -1.0))


def test_noise_is_gumbel_s(spark):
    """The draw with the larger noise wins as often as the weights say: 1 / (1 + exp(-1))."""
    docs = spark.range(0, 8000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("a b")).otherwise(F.lit("a")).alias("text"))
    draws = [r["draw"] for r in weigh(docs, _Fixed, "doc_id", "text", 6)[0].orderBy("doc_id").collect()]
    share = np.mean([a > b for a, b in zip(draws[::2], draws[1::2])])
    assert abs(share - 1 / (1 + math.exp(-1))) < 0.03


def test_kth(spark):
    draws = [random.Random(1).randrange(-(1 << 62), 1 << 62) for _ in range(200)] + [7, 7, 7, -7]
    frame = spark.createDataFrame([(d,) for d in draws], "draw long")
    for k in (1, 2, 50, 204):
        assert kth_largest(frame, k) == sorted(draws, reverse=True)[k - 1]


# Personal data

LUHN = lambda s: sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(re.sub(r"\D", "", s))))) % 10 == 0
VALUES = ["joe.Doe9@mail7.example.com", "97.51.17.173", "4111111111111111", "4111 1111 1111 1112", "+1 (017) 555-7713", "(212) 555-0199", "1984-02-29", "31.12.1999", "12/31/1999", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "123-45-6789", "9807915762804490"]


INVALID = ["4111 1111 1111 1112", "9807915762804490", "order no 1234567890123", "000-00-0000", "666-12-3456", "DE88370400440532013000", "31.02.2020"]
VALUES = [v for v in VALUES if v not in INVALID]


def test_pseudonyms(spark):
    texts = [f"see {v}, then {v}%%% end" for v in VALUES] + ["", None, "Version 2.0 of 2024, no. 12345", "x" * 40_000 + " " + VALUES[0], "a\x01b\x02 \x03\x01\x02 c 12", *INVALID]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, found string, _parts string")
    got = [r["text"] for r in pii.pseudonymise(frame, "k").orderBy("doc_id").collect()]
    for value, out in zip(VALUES, got):
        first, second = re.fullmatch(r"see (.*), then (.*)%%% end", out).groups()
        shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))
        assert first == second != value
        if value != VALUES[1] and len(value) != 40:
            assert shape(first) == shape(value) or value[0] in "DG"
        if re.sub(r"\D", "", value)[:3] == "411":
            assert LUHN(first)
        if value[:2] in ("DE", "GB"):
            s = first.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    assert all(0 <= int(x) < 256 for x in re.search(r"see ([\d.]+),", got[1])[1].split("."))
    n = len(VALUES)
    assert got[n : n + 3] == texts[n : n + 3] and got[n + 4 :] == texts[n + 4 :]
    assert got[n + 3] == "x" * 40_000 + " " + re.match(r"see (.*?),", got[0])[1]
    assert pii.pseudonymise(frame.limit(0), "k", count_col="n").count() == 0
    with pytest.raises(TypeError):
        pii.pseudonymise(frame)


def test_values_are_linked_across_notations(spark):
    same = [["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"], ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"], ["1984-02-29", "29.02.1984", "1984/02/29"], ["+1 (826) 555-4081", "+18265554081", "826-555-4081", "(826) 555-4081"], ["Joe.Doe@Mail.com", "joe.doe@mail.com"]]
    texts = [v for group in same for v in group]
    got = dict(zip(texts, (r["text"] for r in pii.pseudonymise(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), "k").orderBy("doc_id").collect())))
    plain = lambda s: re.sub(r"[^0-9a-z@]", "", s.lower())
    for group in same[:2] + same[4:]:
        assert len({plain(got[v]) for v in group}) == 1
    assert len({plain(got[v])[-10:] for v in same[3]}) == 1
    assert got["29.02.1984"].split(".")[::-1] == got["1984-02-29"].split("-") == got["1984/02/29"].split("/")


def test_long_texts_neither_crash_nor_stall(spark):
    n = 1 << 20
    hostile = ["x@" + "a." * (n // 2) + "9 ", "a" * n, "1" * n, "1-" * (n // 2), "+1" * (n // 2), "+" + "1" * n, "a." * (n // 2), "a@" * (n // 2), "sk-" + "a_" * (n // 2), "DE89" + "ABCD" * (n // 4), "(123) " * (n // 6), "1." * (n // 2), "2020-01-01-" * (n // 11), "+12 a.a.a." * (n // 10)]
    frame = spark.createDataFrame([*enumerate(hostile)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n"], r["size"]) for r in pii.pseudonymise(frame, "k", count_col="n").select("doc_id", "n", F.length("text").alias("size")).collect()}
    assert all(got[k][1] == len(t) for k, t in enumerate(hostile))


def _plain_pseudonyms(text, key):
    """The contract in plain Python, but for the patterns: what is found, validated, permuted and written back."""
    import datetime as dt

    import regex

    def feistel(kind, value, alphabets):
        l, r = value[: len(value) // 2], value[len(value) // 2 :]
        for turn in range(pii.ROUNDS):
            own, other = (l, r) if turn % 2 == 0 else (r, l)
            digest = hashlib.sha512(f"{key}/{kind}/{turn}/{len(own)}/{other.lower()}".encode()).hexdigest()
            new = ""
            for i, c in enumerate(own):
                by = int(digest[i % 64 * 2 : i % 64 * 2 + 2], 16)
                a = next((a for a in alphabets if c in a), None)
                new += a[(a.index(c) + by) % len(a)] if a else c
            l, r = (new, r) if turn % 2 == 0 else (l, new)
        return l + r

    def numbers(kind, l, r, radix):
        for turn in range(pii.ROUNDS):
            add = int(hashlib.sha256(f"{key}/{kind}/{turn}/{r if turn % 2 == 0 else l}".encode()).hexdigest()[:12], 16)
            l, r = ((l + add) % radix[0], r) if turn % 2 == 0 else (l, (r + add) % radix[1])
        return l, r

    def back(value, plain):
        it = iter(plain)
        return "".join(next(it) if c.isascii() and c.isalnum() else c for c in value)

    def one(m):
        v, kind = m[0], m.lastgroup
        bare = re.sub(r"[^0-9A-Za-z]", "", v)
        if kind == "email":
            tail = re.search(r"\.[A-Za-z]{2,63}$", v)[0]
            return feistel(kind, v.removesuffix(tail), [pii.DIGITS, pii.LOWER, pii.UPPER]) + tail
        if kind == "secret":
            if re.fullmatch("[0-9a-f]{32,64}", v):
                return feistel(kind, v, [pii.DIGITS + pii.LOWER[:6]])
            if re.fullmatch("[0-9A-F]{32,64}", v):
                return feistel(kind, v, [pii.DIGITS + pii.UPPER[:6]])
            return v[:4] + feistel(kind, v[4:], [pii.DIGITS, pii.LOWER, pii.UPPER])
        if kind == "ip":
            a, b, c, d = map(int, v.split("."))
            x, y = numbers(kind, a * 256 + b, c * 256 + d, (65_536, 65_536))
            return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
        if kind == "card":
            if not LUHN(v):
                return v
            new = feistel(kind, bare[:-1], [pii.DIGITS])
            return back(v, new + next(d for d in pii.DIGITS if LUHN(new + d)))
        if kind == "phone":
            code = re.match(pii.CALLING, v)
            code = code[0] if code else ""
            rest = v[len(code) :]
            return code + back(rest, feistel(kind, re.sub(r"\D", "", rest), [pii.DIGITS])) if 7 <= len(bare) <= 15 else v
        if kind == "ssn":
            a, g, s = map(int, v.split("-"))
            if not (0 < a < 900 and a != 666 and g and s):
                return v
            x, y = numbers(kind, (a - 1 - (a > 666)) * 99 + g - 1, s - 1, pii.SSN_RADIX)
            return f"{x // 99 + 1 + (x // 99 + 1 >= 666):03d}-{x % 99 + 1:02d}-{y + 1:04d}"
        if kind == "date":
            p = re.split("[-/.]", v)
            iso = p if len(p[0]) == 4 else [p[2], p[0], p[1]] if int(p[1]) > 12 else p[::-1]
            try:
                day = (dt.date(*map(int, iso)) - dt.date(1970, 1, 1)).days
            except ValueError:
                return v
            inside = (day + pii.SINCE_1800) % (pii.DAY_RADIX[0] * pii.DAY_RADIX[1])
            x, y = numbers(kind, inside // pii.DAY_RADIX[1], inside % pii.DAY_RADIX[1], pii.DAY_RADIX)
            new = dt.date(1970, 1, 1) + dt.timedelta(day - inside + x * pii.DAY_RADIX[1] + y)
            parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            return re.search("[-/.]", v)[0].join(parts[c] for c in ("ymd" if len(p[0]) == 4 else "mdy" if int(p[1]) > 12 else "dmy"))
        account, digits = bare[4:], lambda s: int("".join(str(int(c, 36)) for c in s))
        check = lambda a: f"{98 - digits(a + bare[:2] + '00') % 97:02d}"
        if check(account) != bare[2:4]:
            return v
        new = feistel(kind, account, [pii.DIGITS, pii.UPPER])
        return back(v, bare[:2] + check(new) + new)

    return regex.sub("|".join(f"(?P<{k}>{p})" for k, p in pii.KINDS), one, text)


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="no test tables")
def test_pseudonyms_against_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(12)
    number = lambda n: "".join(rng.choice(pii.DIGITS) for _ in range(n))
    made = [f"{number(3)}-{number(2)}-{number(4)} and {rng.randrange(1700, 2300)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 32):02d}, {rng.randrange(1, 32):02d}/{rng.randrange(1, 32):02d}/2001, {number(16)}; +{number(2)} {number(3)} {number(4)} {number(3)}; DE{number(20)} ghp_{'aB3' * 8}" for _ in range(300)] + VALUES + INVALID
    docs = docs.unionByName(spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(made)], "doc_id long, text string"))
    source = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.pseudonymise(docs, "a key").collect():
        t = source[r["doc_id"]]
        assert r["text"] == (None if t is None else _plain_pseudonyms(t, "a key"))


def test_values_beside_a_phone_number_and_keys_of_letters(spark):
    phone, others = "+1 (826) 555-4081", ["190.137.223.204", "2024-03-17", "17.03.2024", "123-45-6789", "4111 1111 1111 1111", "12.34@mail.org"]
    keys = ["ghp_" + "abcdEFGH" * 4, "sk-" + "abcdEFGH" * 3, "xoxb-" + "abcdEFGH" * 3, "AKIA" + "ABCDEFGH" * 2]
    texts = [phone, *others, *keys, *(f"{phone} {v}" for v in others)]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), "k", count_col="n").orderBy("doc_id").collect()]
    alone = dict(zip(texts, got))
    assert all(alone[k] != k and alone[k][:4] == k[:4] for k in keys)
    assert got[-len(others) :] == [f"{alone[phone]} {alone[v]}" for v in others]


def test_different_values_stay_different(spark):
    rows = [(f"{k:04d}",) for k in range(2000)]
    out = spark.createDataFrame(rows, "v string").select(pii._permuted("k", F.col("v"), [pii.DIGITS]).alias("p")).collect()
    assert len({r["p"] for r in out}) == 2000
    days = spark.range(0, 3000).select(pii._date("k", F.date_format(F.date_from_unix_date(F.col("id").cast("int")), "yyyy-MM-dd")).alias("p"))
    assert days.distinct().count() == 3000


def test_html_entities_as_python_reads_them():
    assert main_text("<article>&eacute;&#233;&#xe9; &nbsp; &am &amp</article>", TREE) == re.sub(r"\s+", " ", html.unescape("&eacute;&#233;&#xe9; &nbsp; &am &amp"))
