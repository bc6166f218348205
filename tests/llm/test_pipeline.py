"""Each stage of the corpus pipeline on its predecessor's output, against a plain version of its own job."""
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridsight.llm import near_copies

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles_of(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def kept_of(rows):
    """The smallest id of each component of texts with a Jaccard similarity of 0.8 or more, comparing all pairs; (id, text) rows."""
    rows = sorted(rows)
    sets, root = [shingles_of(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [rows[i][0] for i in range(len(rows)) if root[i] == i]


def changed(base, *places):
    words = base.split()
    return " ".join(f"changed{p}" if p in places else w for p, w in enumerate(words))


BASE = " ".join(f"w{i}" for i in range(104))  # 100 shingles; one changed word inside changes 5 of them
# Jaccard to BASE: 95/105 and 90/110 are linked, 85/115 is not; the last text reaches BASE only through the second.
NEAR = [(1, BASE), (2, changed(BASE, 20)), (3, changed(BASE, 40, 60)), (4, changed(BASE, 10, 30, 50)), (5, changed(BASE, 20, 70, 90)),
        (6, BASE.upper()), (7, "a b"), (8, "A  b\n"), (9, "a b c"), (10, ""), (11, None), (12, BASE.replace("w", "v"))]


@pytest.mark.parametrize("limits", [{}, {"small_rows": 1}, {"small_rows": 2, "group_rows": 3}])
def test_near_copies_by_exact_jaccard(spark, limits):
    # Chains and a crowd whose members are partly linked, too, and blocks of three rows.
    crowd = [(100 + i, changed(BASE.replace("w", "x"), 7 + i, 30 + 2 * i, 60 + i % 5)) for i in range(20)]
    rows = NEAR + crowd
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    named = near_copies.components(frame, **limits).collect()
    assert len(named) == len(rows)
    assert sorted({r["component_id"] for r in named}) == kept_of(rows)


def test_near_dedup_stage_drops_changed_copies(spark, sf):
    frame = spark.createDataFrame(NEAR, "doc_id long, text string")
    got = corpus_pipeline.keep_one_of_near_copies(spark, frame, sf)
    assert got.columns == ["doc_id", "text"] and sorted(r["doc_id"] for r in got.collect()) == kept_of(NEAR) == [1, 4, 7, 9, 10, 12]
    assert corpus_pipeline.keep_one_of_near_copies(spark, frame.limit(0), sf).count() == 0


def toxic_scores(docs, labels):
    """Naive-Bayes-scaled logistic regression in plain Python, trained on the labelled rows outside the fold."""
    def grams(text):
        padded = "".join(" " if ord(c) < 33 else c for c in f" {text.lower()} ")
        return {padded[i:i + n] for n in (3, 4, 5, 6) for i in range(len(padded) - n + 1)} if text else set()

    label = {r.doc_id: r.toxic for r in labels.itertuples() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    sets = [grams(t or "") for t in docs["text"]]
    train = [(s, label[i]) for i, s in zip(docs["doc_id"], sets) if i in label]
    n = [sum(y == k for _, y in train) for k in (0, 1)]
    counts = [Counter(g for s, y in train if y == k for g in s) for k in (0, 1)]
    ratios = {}
    for g in counts[0].keys() | counts[1].keys():
        a, b = counts[1][g], counts[0][g]
        c, d = n[1] - a, n[0] - b
        chi2 = (n[0] + n[1]) * (a * d - b * c) ** 2 / ((a + b) * max(c + d, 1) * n[0] * n[1])
        if chi2 >= 10.83:
            ratios[g] = chi2, math.log((a + 1) / (n[1] + 2)) - math.log((b + 1) / (n[0] + 2))
    best = sorted(ratios, key=lambda g: -ratios[g][0])[:8192]
    place = {g: i for i, g in enumerate(best)}

    def table(some):
        out = np.zeros((len(some), len(best)))
        for row, s in enumerate(some):
            for g in s & place.keys():
                out[row, place[g]] = ratios[g][1]
        return out

    x, y = table([s for s, _ in train]), np.array([y for _, y in train])

    # Newton steps on one number per training row (weights are sums of training rows) and a free intercept.
    k, n, z = x @ x.T, len(y), np.zeros(len(y))
    for _ in range(60):
        p = 1 / (1 + np.exp(-z))
        s = np.maximum(p * (1 - p), 1e-10)
        system = np.block([[k + np.diag(n * 0.001 / s), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        solved = np.linalg.solve(system, np.append(z + (y - p) / s, 0))
        z = k @ solved[:-1] + solved[-1]
    return 1 / (1 + np.exp(-(table(sets) @ (x.T @ solved[:-1]) + solved[-1])))


def without_repeated_lines(docs):
    """The rows without lines that ten or more rows have; keys are stripped and lower-cased."""
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    have = Counter(k for t in docs["text"] for k in {key(line) for line in (t or "").split("\n")})
    out = docs.copy()
    out["text"] = ["\n".join(line for line in (t or "").split("\n") if not key(line) or have[key(line)] < 10) for t in docs["text"]]
    out["n_chars"] = out["text"].str.len()
    return out


def mixed(docs):
    """How many copies of each id the mix takes: sources of weights 3, 1, 2 in turn, 1.5 times all words, two copies at most."""
    docs = docs.assign(size=[len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in docs["text"]])
    copies = []
    for place, (_, rows) in enumerate(docs.groupby("source", sort=True)):
        rows = rows.assign(mark=[hashlib.md5(str(i).encode()).hexdigest() for i in rows["doc_id"]]).sort_values("mark")
        served = 0
        for copy in (0, 1):
            for r in rows.itertuples():
                served += r.size
                if r.size:
                    copies.append((served / (3.0, 1.0, 2.0)[place % 3], place, copy, served, r.size, r.doc_id))
    left, taken = 1.5 * docs["size"].sum(), Counter()
    for *_, size, doc_id in sorted(copies):
        left -= size
        if left < 0:
            break
        taken[doc_id] += 1
    return taken


def pandas_of(df):
    return df.toPandas().sort_values("doc_id", ignore_index=True)


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """The input and the result of each stage on its predecessor's output."""
    folder = SF
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs[-1], folder).write.parquet(out)
        docs.append(spark.read.parquet(out))
    return [pandas_of(d) for d in docs]


def test_toxicity_stage(spark, sf, outputs):
    docs, got = outputs[0], outputs[1]
    score = toxic_scores(docs, spark.read.parquet(f"{sf}/labels.parquet").toPandas())
    pd.testing.assert_frame_equal(got, docs[score < 0.5].reset_index(drop=True))


def test_line_dedup_stage(outputs):
    pd.testing.assert_frame_equal(outputs[2], without_repeated_lines(outputs[1]))


def test_near_dedup_stage(outputs):
    docs = outputs[2]
    kept = kept_of(list(zip(docs["doc_id"], docs["text"])))
    pd.testing.assert_frame_equal(outputs[3], docs[docs["doc_id"].isin(kept)].reset_index(drop=True))


def test_mix_stage(outputs):
    docs, taken = outputs[3], mixed(outputs[3])
    want = docs.loc[docs.index.repeat([taken[i] for i in docs["doc_id"]])].reset_index(drop=True)
    pd.testing.assert_frame_equal(outputs[4], want)


def test_encoding_stage(outputs):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, got = outputs[4], outputs[5]
    ids = [e.ids for e in library.encode_batch(docs["text"].tolist(), add_special_tokens=False)]
    want = docs.drop(columns="text").assign(
        n_tokens=[len(i) for i in ids], ids_sha256=[hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in ids],
        decoded_sha256=[hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest() for i in ids])
    assert [list(i) for i in got["ids"]] == ids
    pd.testing.assert_frame_equal(got.drop(columns="ids"), want)
