"""Ranked search against a plain version that scores every document for every item."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridsight.llm import lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id string, item string, score string, rank string, term string"


def terms(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    merged = {}
    for i, t in dict.fromkeys(items):
        merged.setdefault(i, []).extend(terms(t))
    out = []
    for item, words in merged.items():
        scores = []
        for place, (i, c) in enumerate(counted):
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, *["own"] * 5) for i, t in docs], SCHEMA), spark.createDataFrame([(i, t, *["own"] * 5) for i, t in items], SCHEMA.replace("doc_id", "item_id"))


def found(spark, docs, items, **options):
    return sorted([tuple(r) for r in lexical.search(*frames(spark, docs, items), **options).collect()], key=str)


def test_terms_of_bytes():
    text = "Don't ÀB_c-9\x00x\x7fÉ y٣ z퟿  "
    assert [t.decode() for t in lexical.counts_of(text.encode())] == list(dict.fromkeys(terms(text)))
    assert lexical.counts_of(b"") == {} and lexical.counts_of(b" .,- ") == {}


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    odds = [1 / (i + 1) for i in range(400)]
    return [(i, " ".join(rng.choices(words, odds, k=rng.choice([3, 20, 80])))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"block_docs": 40, "batch_items": 3}, {"most_terms": 0, "block_docs": 100}, {"k": 3}])
def test_search_equals_the_plain_version(spark, options):
    docs = corpus(900, 1)
    rng = random.Random(2)
    items = [(j, docs[rng.randrange(900)][1] + " W0 the w399!") for j in range(25)]
    assert found(spark, docs, items, **options) == plain(docs, items, options.get("k", 10))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "word " * 60_000 + "rare"), (5, "Rare word"), (5, "Rare word"), (None, "rare word"), (6, "RARE É"), (7, "rare é"), (8, "other")]
    items = [(1, None), (2, ""), (3, "rare"), (3, "rare"), (3, "É É"), (None, "word"), (4, "nowhere"), (5, "rare rare word")]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_accumulators_stop_and_lose_nothing():
    docs = corpus(3000, 5)
    postings, sizes = {}, []
    for at, (_, text) in enumerate(docs):
        counted = lexical.counts_of(text.encode())
        sizes.append(sum(counted.values()))
        for t, n in counted.items():
            for held, x in zip(postings.setdefault(t, (lexical.array("i"), lexical.array("i"))), (at, n)):
                held.append(x)
    block = lexical.Block.from_bytes(lexical.Block.build([i for i, _ in docs], sizes, postings).to_bytes(lexical.pa.int64()))
    block.weigh(len(docs), sum(sizes))
    tally = lexical.Tally()
    # One rare word, then words that nearly every document has.
    words = [b"w390", b"w5", b"w2", b"w1", b"w0"]
    asked = [(w, math.floor(1000 * math.log((2 * 3000 + 2) / (2 * len(postings[w][0]) + 1))) * (50 if i == 0 else 1)) for i, w in enumerate(words)]
    at, scores = lexical.search_block(block, asked, 3, tally=tally)
    full = np.zeros(3000, dtype=np.int64)
    for w, weight in asked:
        p = block.place[w]
        here = slice(block.starts[p], block.starts[p + 1])
        full[block.docs[here]] += weight * block.values[here]
    want = sorted(range(3000), key=lambda i: (-full[i], i))[:3]
    assert at.tolist() == want and scores.tolist() == full[want].tolist()
    assert tally.skipped > 10 * tally.open
    assert len(lexical.search_block(block, asked, 3, floor=int(full.max()) + 1)[0]) in (0, 3)
