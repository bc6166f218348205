"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared on vertical bit planes.

Two texts are linked if their fingerprints differ in at most ``radius`` bits. Fingerprints are first made distinct.
By the pigeonhole principle two linked fingerprints agree on at least one of ``radius + 1`` parts of their bits, so only
fingerprints that share a part are compared. A group that is too large is divided again on the bits it has not used yet,
until every group is small; with few bits left there are few distinct fingerprints, so this always ends and no pair is lost.

Inside a group the fingerprints stand as bit planes: one machine word holds one bit of 64 of them. A query adds the planes
into carry-save counters for 64 distances at once, and blocks in which all distances exceed the radius are abandoned.

Null and empty texts have fingerprint 0 and are linked like any other. A component is named by its smallest doc_id (null
if it has none). Repeated rows have equal fingerprints and share a component. An empty table gives an empty result.
Columns other than the id and the text are ignored.
"""
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ..operators.common import col
from ..operators.common import join_on
from .common import byte_texts, in_batches, stored, text_of
from .components import connected_components

GROUP_ROWS = 8192
AIM_ROWS = 512
SEED = 42
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text, shingle=3, chunk=1 << 16):
    """The fingerprint of UTF-8 bytes; a bit is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle, len(words))
    starts, ends = starts[: len(words) - span + 1], ends[span - 1:]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), chunk):
        parts = [joined[a:b] for a, b in zip(starts[i:i + chunk].tolist(), ends[i:i + chunk].tolist())]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype="<u8", count=len(parts))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs, key="doc_id", text="text", shingle=3):
    """(key, text_hash, fingerprint LONG) of each row; text_hash tells texts apart that share an id."""
    rows = docs.select(col(key).alias(key), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("_text"))

    def run(batches):
        for batch in batches:
            marks = np.fromiter((fingerprint(t, shingle) for t in byte_texts(batch.column(2))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks.view(np.int64))], names=[key, "text_hash", "fingerprint"])

    return in_batches(rows).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, text_hash long, fingerprint long")


def bit_planes(values):
    """Plane p, word b: bit i is bit p of value 64 b + i."""
    width = -(-len(values) // 64) * 64
    padded = np.zeros(width, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def close_pairs(values, radius, cells=1 << 16, every=8):
    """Yield index arrays (i, j), i < j, of all pairs of values that differ in at most ``radius`` bits."""
    planes = bit_planes(values)
    blocks = planes.shape[1]
    levels = int(radius).bit_length()
    query_bits = np.where(((values[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(bool), ALL, np.uint64(0))
    rows = np.arange(len(values))
    query, block = (x.ravel() for x in np.meshgrid(rows, np.arange(blocks), indexing="ij"))
    later = block >= query // 64
    query, block = query[later], block[later]
    # The same value everywhere needs no look: planes in which all agree are left out.
    used = [p for p in range(64) if not (query_bits[:, p] == query_bits[0, p]).all()]
    for start in range(0, len(query), cells):
        q, b = query[start:start + cells], block[start:start + cells]
        # Counters start so high that the last carry means "more than radius".
        counters = [np.full(len(q), ALL if (2 ** levels - 1 - radius) >> k & 1 else 0, dtype=np.uint64) for k in range(levels)]
        over = np.zeros(len(q), dtype=np.uint64)
        for n in range(0, len(used), 2):
            x = planes[used[n]][b] ^ query_bits[q, used[n]]
            if n + 1 < len(used):
                y = planes[used[n + 1]][b] ^ query_bits[q, used[n + 1]]
            else:
                y = np.zeros_like(x)
            for k in range(levels):
                # A full adder at the lowest level takes two planes; its carry ripples up.
                if k == 0:
                    half = counters[0] ^ x
                    carry = (counters[0] & x) | (half & y)
                    counters[0] = half ^ y
                else:
                    counters[k], carry = counters[k] ^ carry, counters[k] & carry
            if levels:
                over |= carry
            else:
                over |= x | y
            if n % every == every - 2:
                alive = over != ALL
                if alive.mean() < 0.7:
                    q, b, over = q[alive], b[alive], over[alive]
                    counters = [c[alive] for c in counters]
                    if not len(q):
                        break
        close = ~over
        hit = close != 0
        q, b, close = q[hit], b[hit], close[hit]
        cell, bit = np.nonzero(np.unpackbits(close.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = q[cell], b[cell] * 64 + bit
        real = (j > i) & (j < len(values))
        if real.any():
            yield i[real], j[real]


def merge_labels(label, a, b):
    """Let linked positions share the smallest label; labels are positions and point to roots."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def parts(mask, count, most_bits=64):
    """Divide the bits outside ``mask`` into ``count`` parts and return ``mask`` with (the first bits of) each."""
    free = [p for p in range(64) if not mask >> p & 1]
    cuts = [len(free) * i // count for i in range(count + 1)]
    return [mask | sum(1 << p for p in free[lo:hi][:most_bits]) for lo, hi in zip(cuts, cuts[1:])]


def signed(mask):
    return mask - (1 << 64) if mask >> 63 else mask


def _deal(rows, masks, count, most_bits=64):
    """Rows with a column ``mask`` dealt to all parts of the bits that their mask leaves free."""
    tables = [F.when(F.col("mask") == F.lit(signed(m)), F.array(*[F.lit(signed(x)) for x in parts(m, count, most_bits)])) for m in masks]
    dealt = rows.withColumn("mask", F.explode(F.coalesce(*tables))).withColumn("agreed", F.col("fingerprint").bitwiseAND(F.col("mask")))
    return dealt, [x for m in masks for x in parts(m, count, most_bits)]


def links(distinct, radius=2, group_rows=GROUP_ROWS, aim_rows=AIM_ROWS):
    """Edges (a, b) between distinct fingerprints that span all their links: within each group, a row for every
    member that is not the root of its local component."""

    def compare(group):
        values = group["fingerprint"].to_numpy(np.int64).view(np.uint64)
        label = np.arange(len(values))
        for i, j in close_pairs(values, radius):
            merge_labels(label, i, j)
        far = label != np.arange(len(values))
        return pd.DataFrame({"a": values[far].view(np.int64), "b": values[label[far]].view(np.int64)})

    count = distinct.count()
    bits = max(0, (count // aim_rows).bit_length())
    rows, masks = _deal(distinct.select("fingerprint").withColumn("mask", F.lit(0).cast("long")), [0], radius + 1, bits)
    found = []
    while True:
        sizes = stored(rows.groupBy("mask", "agreed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-groups")
        small = join_on(rows, sizes.filter(F.col("n") <= group_rows), ["mask", "agreed"])
        found.append(small.groupBy("mask", "agreed").applyInPandas(compare, "a long, b long"))
        large = sizes.filter(F.col("n") > group_rows)
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]
        if not masks:
            break
        held = join_on(rows, large, ["mask", "agreed"], "left_semi").select("fingerprint", "mask")
        rows, _ = _deal(stored(held, "simhash-large"), [m & (1 << 64) - 1 for m in masks], radius + 1)
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def first_rows(marks, mark, key, name):
    """(mark, first): the smallest id of the rows that share a mark, and its text's hash."""
    first = F.min(F.struct(col(key).isNull().alias("none"), col(key).alias("id"), F.col("text_hash").alias("hash"))).alias("first")
    return stored(marks.groupBy(mark).agg(first), name)


def name_rows(marks, nodes, roots, mark, key, name):
    """(key, text_hash, mark, component_id, first_hash) of the rows of ``marks``, from the roots (_node, root) of linked marks."""
    linked = nodes.join(roots.withColumnRenamed("_node", mark), mark).select(mark, "root", "first")
    tops = linked.groupBy("root").agg(F.min("first").alias("top"))
    named = linked.join(tops, "root").select(mark, "top")
    named = stored(nodes.join(named, mark, "left").select(mark, F.coalesce("top", "first").alias("top")), name)
    return marks.join(named, mark).select(
        key, "text_hash", mark, F.col("top.id").alias("component_id"), F.col("top.hash").alias("first_hash"))


def keep_first(docs, named, key, text, name):
    """``docs`` with one row of each component: that of the smallest id. Rows are handed on as they are, whatever their columns' names."""
    kept = named.filter(col(key).eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash")))
    kept = stored(kept.groupBy(col(key).alias("id"), "text_hash").agg(F.count(F.lit(1)).alias("copies")), name)
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(key).alias("row_id"), F.xxhash64(text_of(text)).alias("row_hash"))
    rows = rows.join(kept, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash"))).select("row", "row_id", "row_hash", "copies")
    if not kept.filter("copies > 1").isEmpty():
        rows = rows.filter("copies = 1").unionByName(rows.filter("copies > 1").dropDuplicates(["row_id", "row_hash"]))
    return rows.select("row.*")


def components(marks, key="doc_id", radius=2):
    """(key, text_hash, fingerprint, component_id, first_hash): the smallest id that links reach, and its text's hash.
    ``marks`` comes from ``fingerprints``."""
    marks = stored(marks, "simhash-marks")
    nodes = first_rows(marks, "fingerprint", key, "simhash-nodes")
    roots = connected_components(links(nodes, radius), "simhash").withColumnRenamed("node", "_node")
    return name_rows(marks, nodes, roots, "fingerprint", key, "simhash-names")


def keep_one(docs, key="doc_id", text="text", shingle=3, radius=2):
    """``docs`` with one row of each component: that of the smallest id."""
    return keep_first(docs, components(fingerprints(docs, key, text, shingle), key, radius), key, text, "simhash-kept")
