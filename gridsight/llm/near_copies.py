"""Near copies by SimHash and exact Jaccard similarity of word shingles: every pair at or above the threshold is linked, no other.

A text is the set of its shingles (64-bit hashes); texts of equal sets are one node. Each node has a SimHash fingerprint of its
set. Fingerprints that differ in at most ``RADIUS`` bits are found by the pigeonhole groups and bit planes of ``simhash``, the
nodes behind them are compared as whole sets, and those that pass become components.

Two sets of the wanted similarity may differ in more bits than any such search can cover (about 10 of 64 at 0.8), so a prefix
filter then looks at all pairs of nodes that SimHash has left in different components. In any fixed order of the shingles, two
sets of similarity ``num / den`` share one of their first n - ceil(n num / den) + 1 shingles, so only nodes that share such a
prefix shingle are compared. The order puts common shingles last, as a sample of the texts shows them; the sample decides on
the work, never on the result.

Of the nodes that share a rare prefix shingle all pairs are looked at. Of those that share a frequent one each meets the
smallest first, and what is linked becomes one component; then all pairs of different components are looked at, each
under the smallest of its common prefix shingles. Pairs whose prefixes show that too few shingles can be common are left
out; all others are compared as whole sets. Nodes of a frequent shingle are dealt to blocks and each two blocks are
compared, so a task's memory is bounded; the work on many nodes that are alike but not linked grows with their square.

Texts with fewer words than a shingle are one shingle; null, empty and blank texts have none and are copies of each other.
A component is named by its smallest doc_id (null if it has none; null ids come last). Repeated rows are copies, and one of
them stays. Other columns never clash: only id and text are read by name, and rows are handed on as a whole. An empty table
gives an empty result.
"""
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ..operators.common import col
from .common import byte_texts, in_batches, stored, text_of, tidy
from .components import connected_components
from . import simhash
from .simhash import SEED, first_rows, keep_first, name_rows

#: Bits in which linked fingerprints may differ. It decides which search finds a pair, never on the result.
RADIUS = 4
SAMPLE_DOCS = 10_000
COMMON_DOCS = 3
COMMON_SHINGLES = 100_000
SMALL_ROWS = 16
GROUP_ROWS = 2048
BROADCAST_ROWS = 200_000


def shingle_set(text, shingle=5):
    """The sorted distinct shingle hashes of UTF-8 bytes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle, len(words))
    starts, ends = starts[: len(words) - span + 1], ends[span - 1:]
    parts = (joined[a:b] for a, b in zip(starts.tolist(), ends.tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=len(starts)))


def node_of(hashes):
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def fingerprint_of(hashes, chunk=1 << 16):
    """The SimHash of a set of hashes: a bit is set if it is set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), chunk):
        part = hashes[i:i + chunk].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _lists(arrays):
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, dtype=np.uint64)]).astype(np.uint64, copy=False)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _longs(values):
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def common_shingles(docs, text, shingle):
    """Shingles that a sample of the texts often has, sorted, and in how many: at most ``COMMON_SHINGLES``."""
    every = max(1, docs.count() // SAMPLE_DOCS)
    rows = docs.select(text_of(text).alias("_text")).filter(F.pmod(F.xxhash64("_text"), F.lit(every)) == 0)

    def run(batches):
        for batch in batches:
            sets = {node_of(s): s for s in (shingle_set(t, shingle) for t in byte_texts(batch.column(0)))}
            found, times = np.unique(np.concatenate([*sets.values(), np.zeros(0, dtype=np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], names=["shingle", "docs"])

    counts = in_batches(rows).mapInArrow(tidy(run), "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs"))
    top = counts.filter(F.col("docs") >= COMMON_DOCS).orderBy(F.desc("docs"), "shingle").limit(COMMON_SHINGLES).toPandas()
    known = top["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], top["docs"].to_numpy(np.int64)[order]


def prefix_of(hashes, common, times, num, den):
    """The shingles of which a set of similarity num / den or more must share one: rare ones first."""
    rank = np.zeros(len(hashes), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, times[at], 0)
    n = len(hashes)
    return hashes[np.lexsort((hashes, rank))[: n + num * n // -den + 1 if n else 0]]


def marked(docs, key, text, shingle, num, den):
    """(key, text_hash, node, fingerprint, n, prefix) of each row; n counts the shingles."""
    common, times = common_shingles(docs, text, shingle)
    rows = docs.select(col(key).alias(key), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("_text"))

    def run(batches):
        for batch in batches:
            nodes, prints, sizes, prefixes = [], [], [], []
            for t in byte_texts(batch.column(2)):
                hashes = shingle_set(t, shingle)
                nodes.append(node_of(hashes))
                prints.append(fingerprint_of(hashes))
                sizes.append(len(hashes))
                prefixes.append(prefix_of(hashes, common, times, num, den))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _longs(nodes), _longs(prints), pa.array(sizes, type=pa.int64()), _lists(prefixes)],
                names=[key, "text_hash", "node", "fingerprint", "n", "prefix"])

    return in_batches(rows).mapInArrow(tidy(run), f"{key} {dict(rows.dtypes)[key]}, text_hash long, node long, fingerprint long, n long, prefix array<long>")


def whole_sets(docs, hashes, text, shingle):
    """(node, shingles) of the texts with these hashes."""
    texts = docs.select(F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("_text")).join(hashes, "text_hash", "left_semi")

    def run(batches):
        for batch in batches:
            sets = {node_of(s): s for s in (shingle_set(t, shingle) for t in byte_texts(batch.column(0)))}
            yield pa.RecordBatch.from_arrays([_longs(list(sets)), _lists(list(sets.values()))], names=["node", "shingles"])

    return in_batches(texts.select("_text")).mapInArrow(tidy(run), "node long, shingles array<long>").distinct()


def similar(pairs, sets, num, den):
    """The pairs (a, b) of nodes whose whole sets have a similarity of num / den or more."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}")) for c in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("_a", "_b")).cast("long")
    return both.filter(shared * (num + den) >= (F.size("_a") + F.size("_b")) * num).select("a", "b")


def candidates(group, num, den):
    """Pairs (a, b) of different components that may be similar and whose smallest common prefix shingle is the group's."""
    prefixes = group["prefix"].tolist()
    starts = np.concatenate(([0], np.cumsum([len(p) for p in prefixes])))
    values, codes = np.unique(np.concatenate(prefixes), return_inverse=True)
    here = np.searchsorted(values, group["shingle"].iloc[0])
    node, n, root, block = (group[c].to_numpy(np.int64) for c in ("node", "n", "root", "block"))
    one_block = group["lo"].iloc[0] == group["hi"].iloc[0]
    rest = n - np.diff(starts)
    roots, sizes = np.unique(root, return_counts=True)
    largest = root == roots[sizes.argmax()]
    mark, rows, a, b = np.zeros(len(values), dtype=bool), np.arange(len(node)), [], []
    for x in np.nonzero(~largest)[0]:
        mine = codes[starts[x]:starts[x + 1]]
        mark[mine] = True
        hit = mark[codes]
        mark[mine] = False
        shared = np.add.reduceat(hit, starts[:-1], dtype=np.int64)
        least = np.minimum.reduceat(np.where(hit, codes, len(values)), starts[:-1])
        fits = (least == here) & (root != root[x]) & (largest | (rows > x)) & (n * den >= n[x] * num) & (n[x] * den >= n * num)
        fits &= (shared + np.maximum(rest, rest[x])) * (num + den) >= (n + n[x]) * num
        if not one_block:
            fits &= block != block[x]
        b.append(node[fits])
        a.append(np.full(len(b[-1]), node[x]))
    none = [np.zeros(0, dtype=np.int64)]
    return pd.DataFrame({"a": np.concatenate(a + none), "b": np.concatenate(b + none)})


def possible(pairs, info, num, den):
    """The pairs (a, b) whose sizes and numbers of shared prefix shingles do not rule similarity out; of different roots, if known."""
    left, right = (info.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in info.columns if x != "node"]) for c in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    apart = F.col("root_a") != F.col("root_b") if "root" in info.columns else F.lit(True)
    return both.filter(apart & _fits(num, den)).select("a", "b")


def _fits(num, den):
    n, m = F.col("n_a"), F.col("n_b")
    most = F.least("shared_a", "shared_b") + F.greatest(n - F.col("p_a"), m - F.col("p_b"))
    return (n * den >= m * num) & (m * den >= n * num) & (most * (num + den) >= (n + m) * num)


def similar_of(docs, nodes, pairs, text, shingle, num, den):
    """``similar`` with the whole sets of the nodes in ``pairs`` only."""
    named = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    hashes = stored(nodes.join(named, "node", "left_semi").select(F.col("first.hash").alias("text_hash")).distinct(), "copies-hashes")
    sets = whole_sets(docs, F.broadcast(hashes) if hashes.count() <= BROADCAST_ROWS else hashes, text, shingle)
    return stored(similar(pairs, stored(sets, "copies-sets"), num, den), "copies-similar")


def simhash_pairs(marks, radius):
    """Pairs (a, b) of nodes, linked fingerprints spanned: each with the first node of its fingerprint, and the first nodes of linked ones."""
    prints = marks.select("node", "fingerprint").distinct()
    firsts = stored(prints.groupBy("fingerprint").agg(F.min("node").alias("first")), "copies-prints")
    same = prints.join(firsts, "fingerprint").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    of = lambda c: firsts.select(F.col("fingerprint").alias(f"{c}_print"), F.col("first").alias(c))
    edges = simhash.links(firsts.select("fingerprint"), radius).withColumnsRenamed({"a": "a_print", "b": "b_print"})
    both = same.unionByName(edges.join(of("a"), "a_print").join(of("b"), "b_print").select("a", "b"))
    return both.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def links(docs, marks, nodes, text, shingle, num, den, small_rows=SMALL_ROWS, group_rows=GROUP_ROWS, radius=RADIUS):
    """Edges (a, b) that span all pairs of similar nodes."""
    rows = marks.select("node", "prefix").distinct().select("node", F.explode("prefix").alias("shingle"))
    # Summed up before it moves and joined back, so a shingle that very many nodes share is no single task.
    totals = rows.groupBy("shingle").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared = stored(rows.join(totals, "shingle"), "copies-shared")
    counted = shared.groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    info = stored(marks.select("node", "n", F.size("prefix").cast("long").alias("p")).distinct().join(counted, "node"), "copies-info")

    # SimHash first. Nodes without a common prefix shingle have no row in info and are similar to none.
    alike = stored(possible(simhash_pairs(marks, radius), info, num, den), "copies-simhash")
    alike = similar_of(docs, nodes, alike, text, shingle, num, den)
    roots = connected_components(alike, "copies-simhash")
    info = stored(info.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "copies-rooted")

    # Few nodes: all pairs. A pair meets under every common shingle and is kept once.
    few = shared.filter(F.col("rows") <= small_rows).select("shingle", "node").join(info, "node")
    left, right = (few.select("shingle", *[F.col(x).alias(y) for x, y in (("node", c), *[(x, f"{x}_{c}") for x in ("n", "p", "shared", "root")])]) for c in ("a", "b"))
    near = left.join(right, "shingle").filter((F.col("a") > F.col("b")) & (F.col("root_a") != F.col("root_b")) & _fits(num, den)).select("a", "b").distinct()

    # Many nodes: the leader of each shingle first.
    many = shared.filter(F.col("rows") > small_rows)
    led = possible(many.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), info, num, den)
    led = alike.unionByName(similar_of(docs, nodes, stored(near.union(led).distinct(), "copies-led"), text, shingle, num, den))
    if many.isEmpty():
        return led
    roots = connected_components(led, "copies-led")
    rows = many.select("shingle", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    totals = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("first"), F.max("root").alias("last")).filter("first <> last")
    rows = rows.join(totals.select("shingle", "rows"), "shingle").withColumn("blocks", F.ceil(F.col("rows") / group_rows).cast("long"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = stored(rows.select("shingle", "node", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")), "copies-many")
    prefixes = marks.select("node", "n", "prefix").join(rows.select("node").distinct(), "node", "left_semi").distinct()
    groups = rows.join(prefixes, "node").groupBy("shingle", "lo", "hi")
    pairs = stored(groups.applyInPandas(lambda group: candidates(group, num, den), "a long, b long"), "copies-pairs")
    return led.unionByName(similar_of(docs, nodes, pairs, text, shingle, num, den))


def components(docs, key="doc_id", text="text", shingle=5, similarity=(4, 5), small_rows=SMALL_ROWS, group_rows=GROUP_ROWS, radius=RADIUS):
    """(key, text_hash, node, component_id, first_hash): the smallest id that links reach, and its text's hash."""
    marks = stored(marked(docs, key, text, shingle, *similarity), "copies-marks")
    nodes = first_rows(marks, "node", key, "copies-nodes")
    roots = connected_components(links(docs, marks, nodes, text, shingle, *similarity, small_rows, group_rows, radius), "copies")
    return name_rows(marks, nodes, roots.withColumnRenamed("node", "_node"), "node", key, "copies-names")


def keep_one(docs, key="doc_id", text="text", shingle=5, similarity=(4, 5)):
    """``docs`` with one row of each component: that of the smallest id."""
    return keep_first(docs, components(docs, key, text, shingle, similarity), key, text, "copies-kept")
