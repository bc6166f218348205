"""Near copies and quality rules with odd rows and columns named like the operators' own."""
import random
from collections import Counter

from gridsight.llm import near_copies, quality_rules, simhash

SCHEMA = "doc_id long, text string, _n string, text_hash_ string, node string, n string, prefix string, shingle string, row string, copies string, id string, _t string, _words string, _lines string, _windows string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["own"] * 13) for i, t in rows], SCHEMA)


def jaccard_components(rows, shingle=5):
    """The smallest id of each linked group, comparing all pairs."""
    def grams(text):
        words = (text or "").lower().split()
        return frozenset(" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()

    sets = sorted({grams(t) for _, t in rows}, key=lambda s: (len(s), sorted(s)))
    root = {s: s for s in sets}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if 5 * len(a & b) >= 4 * len(a | b) and (a or not b):
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        key = find(grams(t))
        least.setdefault(key, []).append(i)
    return Counter(min((i for i in ids if i is not None), default=None) for ids in least.values())


def odd_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choices(words, k=80)) for _ in range(12)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    for i in range(60):
        copy = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((rng.choice([None, 1000 + i]), " ".join(copy)))
    long = " ".join(rng.choices(words, k=60_000))
    return rows + [(1, None), (2, ""), (None, " \n"), (3, "a b"), (3, "a b"), (4, "A  b"), (5, long), (6, long + " end"), (None, "alone by itself"), (None, "alone by itself")]


def test_near_copies_of_odd_rows_and_clashing_columns(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert Counter(r["doc_id"] for r in got) == jaccard_components(rows)
    assert all(set(r.asDict().values()) - {r["doc_id"], r["text"]} == {"own"} for r in got)
    assert near_copies.keep_one(frame(spark, [])).count() == 0


def test_a_shingle_that_very_many_nodes_share(spark):
    shared = "one two three four five six"
    rows = [(i, f"{shared} " + " ".join(f"x{i}y{j}" for j in range(i % 7))) for i in range(400)]
    named = near_copies.components(frame(spark, rows), small_rows=4, group_rows=32)
    got = {r["doc_id"]: r["component_id"] for r in named.collect()}
    assert Counter(Counter(got.values()).keys()) == jaccard_components(rows)


def test_simhash_keeps_clashing_columns(spark):
    got = simhash.keep_one(frame(spark, [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, "z")])).collect()
    assert sorted((r["doc_id"] or 0, r["text_hash_"], r["_n"]) for r in got) == [(0, "own", "own"), (1, "own", "own")]


def test_quality_rules_keep_clashing_columns(spark):
    got = quality_rules.apply_rules(frame(spark, [(1, "a b c"), (2, None)]))
    assert {(r["_t"], r["_words"], r["_lines"], r["_windows"]) for r in got.collect()} == {("own",) * 4} and set(SCHEMA.split()[::2]) <= set(got.columns)


def test_simhash_links_what_lies_within_its_radius(spark, monkeypatch):
    """The fingerprints find near copies by themselves; the prefix filter has only the others left to look at."""
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[::-1]), "a b c d e f"]
    prints = [near_copies.fingerprint_of(near_copies.shingle_set(t.encode())) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= near_copies.RADIUS < (prints[0] ^ prints[2]).bit_count()
    checked = []
    whole = near_copies.similar_of
    monkeypatch.setattr(near_copies, "similar_of", lambda docs, nodes, pairs, *rest: checked.append(pairs.count()) or whole(docs, nodes, pairs, *rest))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["component_id"] for r in near_copies.components(frame).collect()) == [0, 0, 2, 3]
    assert checked[0] == 1 and not any(checked[1:])
