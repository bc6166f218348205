"""Exact duplicates by an index of live digests that documents can join and leave.

A text counts by the SHA-256 of its normal form (each run of white space made one space). Digests are dealt to shards by
their own bits. A shard has two files in the shared folder: a cuckoo filter of its live digests, and its content, the
digests in the order of their 64-bit keys, each with the number of live rows and their smallest id. An arriving digest
first probes the filter. A miss is new. A hit is verified against the digests stored under its key, and is a copy or (a
foreign fingerprint) new as well. A filter that overflows is made anew, twice as large, from the stored keys; so are
all shards when there are more digests than they are meant for. When the last row of a text leaves, its fingerprint is
deleted from the filter.

Tasks combine their own rows before anything is shuffled, and texts never are. A text that a third of all rows share
sends one row per task to its shard; groups of over a thousandth of all rows (so at most 1,000) are broadcast, others joined.

Null texts count as empty, which is a text like any other. The smallest id is that of the row that stays; null ids come last.
Of repeated rows (same id, same text) each counts in ``group_size`` and one stays. An empty table gives an empty result.
Other columns never clash: operators take id and text by name and hand on rows as a whole.
"""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import col
from .common import in_batches, join_counted, read_file, shared_folder, stored, text_of, write_file
from .cuckoo import CuckooFilter, buckets_for

SHARD_KEYS = 1 << 18
COMBINE = 1 << 16


@dataclass
class Index:
    """``rows``: (digest, id, n) of all live rows. ``files``: (shard, filter, content, digests), a row for each shard that has any."""

    rows: DataFrame
    files: DataFrame
    shards: int
    shard_keys: int = SHARD_KEYS


def normal(text):
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def digest_of(text):
    return F.unhex(F.sha2(normal(text).cast("binary"), 256))


def digests(docs, key="doc_id", text="text"):
    """(digest, id, n): how often each id has each text."""
    return docs.select(digest_of(text).alias("digest"), col(key).alias("id")).groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _combined(rows, shards):
    """(shard, digest, id, n) with at most a row per digest and task: smallest id and number of rows."""
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        held, types = {}, None

        def flush():
            out = list(held)
            places = [int.from_bytes(d[8:16], "little") % shards for d in out]
            made = [pa.array(places, pa.int64()), pa.array(out, pa.binary()), pa.array([held[d][0] for d in out], types), pa.array([held[d][1] for d in out], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(made, names=["shard", "digest", "id", "n"])

        for batch in batches:
            types = batch.schema.field("id").type
            for d, i, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "id", "n"))):
                was = held.get(d)
                held[d] = (i, n) if was is None else (_least(was[0], i), was[1] + n)
            if len(held) >= COMBINE:
                yield flush()
        if held:
            yield flush()

    return rows.select("digest", "id", "n").mapInArrow(run, f"shard long, digest binary, id {kind}, n long")


def key_of(digest):
    return int.from_bytes(digest[:8], "little")


class Shard:
    """The content of a shard under change, and its filter."""

    def __init__(self, table=None, cuckoo=None, expected=0):
        self.digests, self.ids, self.live = (table.column(c).to_pylist() for c in ("digest", "id", "n")) if table is not None else ([], [], [])
        self.by_key = {}
        for place, d in enumerate(self.digests):
            self.by_key.setdefault(key_of(d), []).append(place)
        self.filter = cuckoo or CuckooFilter(buckets_for(expected))
        self.false_hits = self.resized = 0

    def find(self, digest):
        """The place of a live digest, by the filter and then by what is stored; None if it is not live."""
        key = key_of(digest)
        if key not in self.filter:
            return None
        for place in self.by_key.get(key, ()):
            if self.digests[place] == digest:
                return place
        self.false_hits += 1
        return None

    def add(self, digest, least, n):
        place = self.find(digest)
        if place is not None:
            self.ids[place], self.live[place] = _least(self.ids[place], least), self.live[place] + n
            return
        key = key_of(digest)
        self.by_key.setdefault(key, []).append(len(self.digests))
        self.digests.append(digest)
        self.ids.append(least)
        self.live.append(n)
        if not self.filter.insert(key):
            self.resized += 1
            self.filter = CuckooFilter.of([k for k, places in self.by_key.items() for _ in places], 2 * (self.filter.mask + 1))

    def put(self, digest, least, n):
        """Give a live digest another smallest id and number of rows; none are left at 0."""
        place = self.find(digest)
        if place is None:
            return
        self.ids[place], self.live[place] = least, n
        if not n:
            key = key_of(digest)
            self.filter.delete(key)
            self.by_key[key].remove(place)

    def table(self, kind):
        kept = [i for i, n in enumerate(self.live) if n]
        kept.sort(key=lambda i: key_of(self.digests[i]))
        return pa.table({"digest": pa.array([self.digests[i] for i in kept], pa.binary()), "id": pa.array([self.ids[i] for i in kept], kind), "n": pa.array([self.live[i] for i in kept], pa.int64())})


def _save(folder, shard, kind):
    content = shard.table(kind)
    out, content_path = write_file(folder, "content")
    with out, pa.ipc.new_file(out, content.schema) as writer:
        writer.write_table(content, max_chunksize=1 << 14)
    out, filter_path = write_file(folder, "filter")
    with out:
        out.write(shard.filter.to_bytes())
    return filter_path, content_path, content.num_rows


def _load(filter_path, content_path):
    with read_file(filter_path) as source:
        cuckoo = CuckooFilter.from_bytes(source.read())
    with read_file(content_path) as source:
        return pa.ipc.open_file(source).read_all(), cuckoo


FILES = "shard long, filter string, content string, digests long, false_hits long, resized long"


def _changed(files, changes, how):
    """The files of all shards after ``changes`` (shard, digest, id, n) are added ('add') or replace what is stored ('put')."""
    folder = shared_folder(changes.sparkSession, "exact-index")

    def run(arrived, held):
        kind = arrived.schema.field("id").type
        if not arrived.num_rows:
            return held
        shard = Shard(*_load(held.column("filter")[0].as_py(), held.column("content")[0].as_py())) if held.num_rows else Shard(expected=arrived.num_rows)
        change = getattr(shard, how)
        for row in zip(*(arrived.column(c).to_pylist() for c in ("digest", "id", "n"))):
            change(*row)
        saved = _save(folder, shard, kind)
        return pa.table([pa.array([x]) for x in (arrived.column("shard")[0].as_py(), *saved, shard.false_hits, shard.resized)], names=held.schema.names)

    return stored(changes.groupBy("shard").cogroup(files.groupBy("shard")).applyInArrow(run, FILES), "exact-files")


def _shards(spark, rows, shard_keys):
    """At least one shard per shuffle partition, and so many that none is meant for more than ``shard_keys`` digests."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // shard_keys))


def build(docs, key="doc_id", text="text", shard_keys=SHARD_KEYS):
    """An index of all rows of ``docs``."""
    spark = docs.sparkSession
    rows = stored(digests(docs, key, text), "exact-rows")
    shards = _shards(spark, rows.count(), shard_keys)
    return Index(rows, _changed(spark.createDataFrame([], FILES), _combined(rows, shards), "add"), shards, shard_keys)


def entries(index):
    """(digest, id, n) of each live text: its smallest id and number of rows, read from the shards' content."""
    kind = dict(index.rows.dtypes)["id"]

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with read_file(path) as source:
                    content = pa.ipc.open_file(source)
                    for i in range(content.num_record_batches):
                        yield content.get_batch(i)

    tasks = max(1, min(index.shards, 10_000))
    return index.files.select("content").repartition(tasks).mapInArrow(run, f"digest binary, id {kind}, n long")


def insert(index, docs, key="doc_id", text="text"):
    """The index with the rows of ``docs`` added. With more digests than its shards are meant for, all are dealt anew from the stored keys."""
    new = stored(digests(docs, key, text), "exact-new")
    rows = stored(index.rows.unionByName(new).groupBy("digest", "id").agg(F.sum("n").alias("n")), "exact-rows")
    shards = _shards(docs.sparkSession, rows.count(), index.shard_keys)
    if shards > 2 * index.shards:
        files = _changed(docs.sparkSession.createDataFrame([], FILES), _combined(rows, shards), "add")
        return Index(rows, files, shards, index.shard_keys)
    return Index(rows, _changed(index.files, _combined(new, index.shards), "add"), index.shards, index.shard_keys)


def delete(index, docs, key="doc_id", text="text"):
    """The index without the live rows that have id and text of a row of ``docs``; other rows of ``docs`` change nothing."""
    gone = stored(digests(docs, key, text).select("digest", F.col("id").alias("gone_id")), "exact-gone")
    rows = index.rows.withColumnRenamed("digest", "d")
    same = (F.col("d") == F.col("digest")) & F.col("id").eqNullSafe(F.col("gone_id"))
    left = stored(rows.join(gone, same, "left_anti").withColumnRenamed("d", "digest"), "exact-rows")
    touched = gone.select("digest").distinct()
    now = left.join(touched, "digest", "left_semi").groupBy("digest").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    now = touched.join(now, "digest", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return Index(left, _changed(index.files, _combined(now, index.shards), "put"), index.shards, index.shard_keys)


def lookup(index, docs, key="doc_id", text="text"):
    """(digest, id, n) of the texts of ``docs`` that are live. A shard's content is opened only if its filter has a hit."""
    kind = dict(index.rows.dtypes)["id"]
    asked = _combined(digests(docs, key, text).withColumn("id", F.lit(None).cast(kind)), index.shards)

    def run(arrived, held):
        out = pa.schema([("digest", pa.binary()), ("id", arrived.schema.field("id").type), ("n", pa.int64())])
        if not arrived.num_rows or not held.num_rows:
            return out.empty_table()
        with read_file(held.column("filter")[0].as_py()) as source:
            cuckoo = CuckooFilter.from_bytes(source.read())
        hits = sorted({d for d in arrived.column("digest").to_pylist() if key_of(d) in cuckoo}, key=key_of)
        if not hits:
            return out.empty_table()
        content, _ = _load(held.column("filter")[0].as_py(), held.column("content")[0].as_py())
        stored_digests = content.column("digest").to_pylist()
        keys = np.array([key_of(d) for d in stored_digests], dtype=np.uint64)
        found = []
        for d in hits:
            at = int(np.searchsorted(keys, np.uint64(key_of(d))))
            while at < len(keys) and int(keys[at]) == key_of(d):
                if stored_digests[at] == d:
                    found.append(at)
                at += 1
        return content.take(pa.array(found, pa.int64())).cast(out)

    return asked.groupBy("shard").cogroup(index.files.groupBy("shard")).applyInArrow(run, f"digest binary, id {kind}, n long")


def label(index):
    """(id, keep_id, group_size, kept, digest) of every live row."""
    groups = entries(index).filter("n > 1").select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    joined = join_counted(index.rows, stored(groups, "exact-groups"), "digest", "group_size")
    keep, single = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")), F.coalesce("group_size", F.lit(1))
    each = joined.select("id", keep.alias("keep_id"), single.cast("long").alias("group_size"), "digest", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return each.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest")


def keep_one(docs, key="doc_id", text="text"):
    """``docs`` with one row of each text: that of the smallest id."""
    kept = stored(label(build(docs, key, text)).filter("kept").select("id", "digest"), "exact-kept")
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(key).alias("row_id"), digest_of(text).alias("row_digest"))
    same = (F.col("row_digest") == F.col("digest")) & F.col("row_id").eqNullSafe(F.col("id"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["row_id", "row_digest"]).select("row.*")
