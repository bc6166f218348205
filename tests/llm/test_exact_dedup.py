"""The index of live digests: filter, insertion, deletion, resizing, and labels against plain Python."""
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridsight.llm import exact_dedup
from gridsight.llm.cuckoo import CuckooFilter, buckets_for

LONG = "word " * 60_000
SCHEMA = "doc_id long, text string, id string, n string, digest string, row string, row_id string, keep_id string, shard string"
ODD = [(1, None), (2, ""), (3, LONG), (4, "a  b\tc"), (4, "a  b\tc"), (None, "a b c"), (9, "a b c"), (5, " a b c"), (None, "x"), (None, "x"), (6, LONG + " "), (7, "É"), (8, "é")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *["own"] * 7) for i, t in rows], SCHEMA)


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append(i)
    ids = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return Counter((i, ids[plain(t)], len(groups[plain(t)])) for i, t in rows), {t: ids[t] for t in groups}


def check_labels(index, rows):
    got = exact_dedup.label(index).collect()
    want, keep = expected(rows)
    assert Counter((r["id"], r["keep_id"], r["group_size"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(keep) and Counter(r["id"] for r in kept) == Counter(keep.values())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), max_size=300, unique=True), st.randoms())
def test_filter_never_loses_a_live_key(keys, rng):
    cuckoo = CuckooFilter.of(keys, 4)
    gone = set(rng.sample(keys, len(keys) // 2))
    assert all(k in cuckoo for k in keys)
    assert all(cuckoo.delete(k) for k in gone)
    assert all(k in CuckooFilter.from_bytes(cuckoo.to_bytes()) for k in keys if k not in gone)


def test_filter_is_seldom_wrong():
    rng = random.Random(3)
    keys = [rng.getrandbits(64) for _ in range(20_000)]
    cuckoo = CuckooFilter(buckets_for(len(keys)))
    assert all(map(cuckoo.insert, keys))
    assert sum(rng.getrandbits(64) in cuckoo for _ in range(100_000)) < 60
    empty = CuckooFilter.of(keys)
    assert all(map(empty.delete, keys)) and not any(empty.slots)


def test_a_full_filter_is_made_anew_from_the_stored_keys():
    rng = random.Random(4)
    shard = exact_dedup.Shard(expected=4)
    texts = [rng.randbytes(32) for _ in range(3000)]
    for i, d in enumerate(texts):
        shard.add(d, i, 1)
    assert shard.resized >= 5 and all(shard.find(d) == i for i, d in enumerate(texts))
    shard.put(texts[7], None, 0)
    assert shard.find(texts[7]) is None and shard.table(None).num_rows == 2999


def test_a_hit_of_a_foreign_key_is_told_apart():
    shard = exact_dedup.Shard(expected=100)
    one = bytes(range(32))
    other = one[:8] + bytes(24)  # the same key and fingerprint, another text
    shard.add(one, 1, 1)
    assert shard.find(other) is None and shard.false_hits == 1
    shard.add(other, 2, 5)
    assert shard.find(one) == 0 and shard.find(other) == 1
    shard.put(one, None, 0)
    assert shard.find(one) is None and shard.find(other) == 1


def test_labels_of_odd_rows(spark):
    check_labels(exact_dedup.build(docs(spark, ODD)), ODD)
    frame = docs(spark, ODD)
    kept = exact_dedup.keep_one(frame)
    assert kept.columns == frame.columns
    got = kept.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(expected(ODD)[1].values()) and {r["digest"] for r in got} == {"own"}


def test_empty_tables(spark):
    index = exact_dedup.build(docs(spark, []))
    assert exact_dedup.label(index).count() == 0 and exact_dedup.keep_one(docs(spark, [])).count() == 0
    check_labels(exact_dedup.insert(index, docs(spark, ODD)), ODD)
    assert exact_dedup.lookup(index, docs(spark, ODD)).count() == 0


def test_ids_that_are_texts(spark):
    rows = [("b", "x"), ("a", "x"), ("c", "y")]
    got = exact_dedup.label(exact_dedup.build(spark.createDataFrame(rows, "doc_id string, text string"))).collect()
    assert sorted((r["id"], r["keep_id"]) for r in got) == [("a", "a"), ("b", "a"), ("c", "c")]


@pytest.mark.parametrize("shard_keys", [1 << 18, 5])
def test_rows_come_and_go(spark, shard_keys):
    rng = random.Random(shard_keys)
    first = [(i, f"text {rng.randrange(60)}") for i in range(150)]
    second = [(i, f"text  {rng.randrange(90)}") for i in range(100, 260)]
    index = exact_dedup.build(docs(spark, first), shard_keys=shard_keys)
    check_labels(index, first)
    index = exact_dedup.insert(index, docs(spark, second))
    rows = first + second
    check_labels(index, rows)
    gone = rng.sample(rows, 120) + [(1, "never there"), (10 ** 6, rows[0][1])]
    index = exact_dedup.delete(index, docs(spark, gone))
    leave = {(i, plain(t)) for i, t in gone}
    rows = [(i, t) for i, t in rows if (i, plain(t)) not in leave]
    check_labels(index, rows)
    asked = [(0, f"text {i}") for i in range(120)] + [(None, None)]
    live = Counter(plain(t) for _, t in rows)
    assert sorted(r["n"] for r in exact_dedup.lookup(index, docs(spark, asked)).collect()) == sorted(live[plain(t)] for _, t in asked if plain(t) in live)


def test_a_hot_text_among_many(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i % 1000}") for i in range(6000)]
    check_labels(exact_dedup.build(docs(spark, rows)), rows)
