"""Line dedup: lines found in many documents are dropped from all of them.

A line's key is the line without surrounding white space, A-Z in lower case. One pass counts, per key, the documents that
have it (each task sums its own first, so a line that a third of the documents share is a few rows). The keys that occur
often enough go into a sharded minimal perfect hash with arrays of fingerprints and counts, one file per shard in the
shared folder. Then the documents probe the arrays where they lie: no text and no line is shuffled or joined.

A key is named by 128 bits of hash: 64 choose shard and place, 64 are the fingerprint. A task holds a few shards at a
time, whatever the size of the index.

Null and empty texts are one empty line. Empty keys (lines of white space) are never dropped. Each row counts as a document,
repeated rows, too. A text that loses all lines becomes empty. Other columns are carried along; ``n_lines`` and
``n_dropped`` replace columns of the same name.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import col
from .common import byte_texts, in_batches, kept_by_process, read_file, shared_folder, stored, text_of, tidy, write_file
from .perfect_hash import Table

SHARD_KEYS = 1 << 18
PROBE_BYTES = 8 << 20
WHITE = b" \t\n\x0b\x0c\r"


def line_keys(text):
    """The lines of UTF-8 bytes and their keys."""
    return text.split(b"\n"), [line.strip(WHITE) for line in text.lower().split(b"\n")]


def hashes(keys):
    """(high, low) halves of each key's 128-bit hash."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=">u8").astype(np.uint64)
    return both[0::2], both[1::2]


def line_counts(docs, text="text", least_chars=1):
    """(high, low, docs): how many documents have each line."""

    def run(batches):
        for batch in batches:
            found = [k for t in byte_texts(batch.column(0)) for k in set(line_keys(t)[1]) if len(k) >= least_chars and (least_chars == 1 or len(k.decode()) >= least_chars)]
            high, low = hashes(found)
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            first = np.nonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))) if len(high) else np.zeros(0, bool))[0]
            times = np.diff(np.concatenate((first, [len(high)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(high[first].view(np.int64)), pa.array(low[first].view(np.int64)), pa.array(times.astype(np.int64))], names=["high", "low", "docs"])

    each = in_batches(docs.select(text_of(text).alias("text"))).mapInArrow(tidy(run), "high long, low long, docs long")
    return each.groupBy("high", "low").agg(F.sum("docs").alias("docs"))


def build_index(counts, shard_keys=SHARD_KEYS):
    """Write one file per shard; returns {shard: path}, a row for each ``shard_keys`` lines."""
    counts = stored(counts, "lines-frequent")
    shards = max(1, -(-counts.count() // shard_keys))
    folder = shared_folder(counts.sparkSession, "lines-index")

    def build(rows):
        table = Table.build(*[rows[c].to_numpy(np.int64).view(np.uint64) for c in ("high", "low")], rows["docs"].to_numpy(np.int64).astype(np.uint32))
        out, path = write_file(folder, "shard")
        with out:
            out.write(table.to_bytes())
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "path": [path]})

    files = counts.withColumn("shard", F.pmod("high", F.lit(shards))).groupBy("shard").applyInPandas(build, "shard long, path string")
    return shards, {r["shard"]: r["path"] for r in stored(files, "lines-shards").collect()}


def load_shard(path):
    """One shard; a worker process keeps the last eight."""
    def load():
        with read_file(path) as source:
            return Table.from_bytes(source.read())

    return kept_by_process(("line shard", path), load, most=8)


def docs_with_line(keys, shards, files):
    """In how many documents each key is found, 0 for lines that are not indexed."""
    high, low = hashes(keys)
    out = np.zeros(len(keys), dtype=np.int64)
    shard = high.view(np.int64) % shards
    for s in np.unique(shard):
        if int(s) in files:
            here = np.nonzero(shard == s)[0]
            out[here] = load_shard(files[int(s)]).count_of(high[here], low[here])
    return out


def drop_lines(docs, text="text", least_docs=10, least_chars=1, shard_keys=SHARD_KEYS):
    """``docs`` with the remaining text, n_lines and n_dropped."""
    frequent = line_counts(docs, text, least_chars).filter(F.col("docs") >= least_docs)
    shards, files = build_index(frequent, shard_keys)
    made = ["n_lines", "n_dropped"]
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(*[text_of(c).alias(c) if c == text else col(c) for c in kept])
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in made]])
    place = kept.index(text)

    def clean(texts):
        split = [line_keys(t) for t in texts]
        counts = docs_with_line([k for _, keys in split for k in keys], shards, files)
        at = 0
        for lines, keys in split:
            drop = counts[at:at + len(keys)] >= least_docs
            at += len(keys)
            yield (b"\n".join([x for x, d in zip(lines, drop.tolist()) if not d]) if drop.any() else b"\n".join(lines)), len(lines), int(drop.sum())

    def run(batches):
        for batch in batches:
            done, held, size = [], [], 0
            for t in byte_texts(batch.column(place)):
                held.append(t)
                size += len(t)
                if size >= PROBE_BYTES:
                    done += clean(held)
                    held, size = [], 0
            done += clean(held)
            columns = list(batch.columns)
            columns[place] = pa.array([d[0] for d in done], type=pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([d[i] for d in done], type=pa.int64()) for i in (1, 2)]], names=[*kept, *made])

    return in_batches(rows).mapInArrow(tidy(run, ["line shard"]), schema)
