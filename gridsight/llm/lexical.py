"""Ranked lexical search: term at a time, rarest term first, with a limit on accumulators that loses no result.

Documents are cut into blocks. The task that reads a block counts its terms and writes a file of postings (term, positions
of documents, frequencies) to the shared folder; it also reports the block's number of documents, of terms, and of
documents per term, from which Spark sums the statistics of the corpus. In a second pass each block is searched for all
items: an item's terms come rarest first, a posting adds its score to the document's accumulator. Before each term the
bounds of the terms still to come (weight times the largest value of their postings in the block) are summed. Once that
sum is below the k-th best partial score, a document without an accumulator can't reach the result: no more accumulators
are made, and the documents that have one go on to their exact scores. Scores are whole numbers, so results are exact.

The k-th best score of the blocks that a task has searched already is carried on. Each task hands on at most k rows per
item and block; Spark ranks them. A term in every document is as many short postings as there are blocks, never one list.

The terms of all items decide which postings are kept, as long as they are at most ``most_terms`` (counted first); with
more, all postings are. Items are searched in batches, so memory holds a block and a batch.

Null texts and texts without terms have no place in the result and do not count as documents. Repeated rows of documents
are documents of their own. Rows of items with the same id are one item, which has the terms of all its different texts.
Ids that are null come last among equal scores. Empty tables give an empty result. Other columns are ignored.
"""
import io
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.dataset as dataset
from pyarrow import fs
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.common import col
from .common import byte_texts, in_batches, kept_by_process, read_file, shared_folder, stored, text_of, write_file, written

BLOCK_DOCS = 1 << 16
BLOCK_POSTINGS = 1 << 22
MOST_TERMS = 200_000
BATCH_ITEMS = 4096
#: Terms are runs of ASCII letters, digits and all characters beyond ASCII; A-Z become a-z, other bytes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text):
    """The terms of UTF-8 bytes, as UTF-8 bytes."""
    return text.translate(FOLD).split(b" ") if text else []


def counts_of(text):
    counted = Counter(terms_of(text))
    counted.pop(b"", None)
    return counted


class Block:
    """Postings of some documents; documents stand in the order of their ids, so that the smaller position is the smaller id."""

    def __init__(self, ids, sizes, terms, starts, docs, times, kind=None):
        self.kind, self.ids, self.sizes, self.starts, self.docs, self.times = kind, ids, sizes, starts, docs, times
        self.place = {t: i for i, t in enumerate(terms)}

    @classmethod
    def build(cls, ids, sizes, postings):
        """``postings``: {term: (positions, frequencies)} of documents in the order of ``ids``."""
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
        rank = np.empty(len(ids), dtype=np.int32)
        rank[order] = np.arange(len(ids), dtype=np.int32)
        terms = sorted(postings)
        docs, times = [], []
        for t in terms:
            at = rank[np.frombuffer(postings[t][0], dtype=np.int32)]
            by = np.argsort(at)
            docs.append(at[by])
            times.append(np.frombuffer(postings[t][1], dtype=np.int32)[by])
        starts = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        return cls([ids[i] for i in order], np.array([sizes[i] for i in order], dtype=np.int64), terms, starts,
                   np.concatenate(docs) if docs else np.zeros(0, np.int32), np.concatenate(times) if times else np.zeros(0, np.int32))

    def weigh(self, n_docs, n_terms):
        """Each posting's value and the largest of each term."""
        m = 25 + 75 * self.sizes * n_docs // n_terms
        self.values = 1_000_000_000 * self.times.astype(np.int64) // (1000 * self.times.astype(np.int64) + 8 * m[self.docs])
        self.most = np.maximum.reduceat(self.values, self.starts[:-1]) if len(self.docs) else np.zeros(0, np.int64)

    def to_bytes(self, kind):
        rows = pa.table({"id": pa.array(self.ids, kind), "size": pa.array(self.sizes)})
        terms = pa.table({"term": pa.array(list(self.place), pa.binary()), "start": pa.array(self.starts[:-1])})
        postings = pa.table({"doc": pa.array(self.docs), "times": pa.array(self.times)})
        out = io.BytesIO()
        for part in (rows, terms, postings):
            with pa.ipc.new_stream(out, part.schema) as writer:
                writer.write_table(part)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data):
        source = pa.BufferReader(data)
        rows, terms, postings = (pa.ipc.open_stream(source).read_all() for _ in range(3))
        starts = np.append(terms.column("start").to_numpy(), postings.num_rows)
        return cls(rows.column("id").to_pylist(), rows.column("size").to_numpy(), terms.column("term").to_pylist(), starts, postings.column("doc").to_numpy(), postings.column("times").to_numpy(),
                   rows.schema.field("id").type)


class Tally:
    """How often postings were read in full or for living accumulators only."""

    def __init__(self):
        self.open = self.limited = self.skipped = 0


def search_block(block, terms, k, floor=0, tally=None):
    """(positions, scores) of the k best documents of a block for one item, best first.

    ``terms`` are (term, weight), rarest first. ``floor`` is a score that the k-th result surely has: less can't enter.
    """
    tally = tally or Tally()
    held = [(block.place[t], w) for t, w in terms if t in block.place and w]
    rest = np.cumsum([int(block.most[t]) * w for t, w in held][::-1])[::-1].tolist()
    score = np.zeros(len(block.ids), dtype=np.int64)
    alive = None
    for i, (t, w) in enumerate(held):
        docs, values = block.docs[block.starts[t]:block.starts[t + 1]], block.values[block.starts[t]:block.starts[t + 1]]
        if alive is None:
            best = floor
            if rest[i] < score.max(initial=0):
                seen = score[score > 0]
                if len(seen) >= k:
                    best = max(best, int(np.partition(seen, len(seen) - k)[len(seen) - k]))
            if rest[i] < best:
                alive = np.nonzero(score)[0]
        if alive is None:
            tally.open += len(docs)
            score[docs] += w * values
        elif not len(alive):
            break
        elif 8 * len(alive) < len(docs):
            at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
            hit = docs[at] == alive
            score[alive[hit]] += w * values[at[hit]]
            tally.limited += int(hit.sum())
            tally.skipped += len(docs) - int(hit.sum())
        else:
            hit = score[docs] > 0
            score[docs[hit]] += w * values[hit]
            tally.limited += int(hit.sum())
            tally.skipped += len(docs) - int(hit.sum())
    found = np.nonzero(score)[0] if alive is None else alive
    if len(found) > k:
        least = np.partition(score[found], len(found) - k)[len(found) - k]
        found = found[score[found] >= least]
    found = found[np.lexsort((found, -score[found]))][:k]
    return found, score[found]


def vocabulary(items, key="item_id", text="text", most_terms=MOST_TERMS):
    """(item terms, vocabulary): a stored table (item, term, times), and the set of its terms, or None if they are too many to send."""
    texts = items.select(col(key).alias("item"), text_of(text).alias("text")).distinct()
    kind = dict(texts.dtypes)["item"]

    def run(batches):
        for batch in batches:
            counted = [(i, t, n) for i, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))) for t, n in counts_of(text).items()]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in counted], batch.column(0).type), pa.array([c[1] for c in counted], pa.binary()), pa.array([c[2] for c in counted], pa.int64())], names=["item", "term", "times"])

    terms = stored(in_batches(texts).mapInArrow(run, f"item {kind}, term binary, times long").groupBy("item", "term").agg(F.sum("times").alias("times")), "lexical-items")
    distinct = stored(terms.select("term").distinct(), "lexical-terms")
    return terms, {bytes(r[0]) for r in distinct.collect()} if distinct.count() <= most_terms else None


def write_blocks(docs, terms=None, key="doc_id", text="text", block_docs=BLOCK_DOCS, block_postings=BLOCK_POSTINGS):
    """Write the postings of ``terms`` (all if None). Returns a stored table: per block a row (path, docs, terms) and
    a row (term, docs) for each of its terms."""
    rows = docs.select(col(key).alias("id"), text_of(text).alias("text"))
    folder = shared_folder(docs.sparkSession, "lexical-blocks")

    def run(batches):
        ids, sizes, postings, held, kind = [], [], {}, 0, None

        def flush():
            out, path = write_file(folder, "block")
            with out:
                out.write(Block.build(ids, sizes, postings).to_bytes(kind))
            names = sorted(postings)
            made = [pa.array([path] + [None] * len(names)), pa.array([None, *names], pa.binary()), pa.array([len(ids), *(len(postings[t][0]) for t in names)], pa.int64()), pa.array([sum(sizes)] + [None] * len(names), pa.int64())]
            for each in (ids, sizes, postings):
                each.clear()
            return pa.RecordBatch.from_arrays(made, names=["path", "term", "docs", "terms"])

        for batch in batches:
            kind = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                counted = counts_of(t)
                if not counted:
                    continue
                place = len(ids)
                ids.append(i)
                sizes.append(sum(counted.values()))
                for term in counted if terms is None else counted.keys() & terms:
                    mine = postings.get(term)
                    if mine is None:
                        mine = postings[term] = (array("i"), array("i"))
                    mine[0].append(place)
                    mine[1].append(counted[term])
                    held += 1
                if len(ids) >= block_docs or held >= block_postings:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return stored(in_batches(rows).mapInArrow(run, "path string, term binary, docs long, terms long"), "lexical-blocks")


def weights(item_terms, blocks, n_docs):
    """The folder of a table (item, term, weight): each item's terms, rarest first, and their weights times their repeats in the item."""
    df = blocks.filter("term is not null").groupBy("term").agg(F.sum("docs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("times")
    each = item_terms.join(df, "term").select("item", F.struct("df", "term", weight.alias("weight")).alias("term"))
    return written(each.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).select("item", "terms.term", "terms.weight"), "lexical-weights")


def item_batches(folder, batch_items):
    """The items in ``folder``, some at a time: [(item, [(term, weight)])]."""
    store, path = fs.FileSystem.from_uri(folder)
    for batch in dataset.dataset(path, filesystem=store, format="parquet").to_batches(batch_size=batch_items, batch_readahead=1, fragment_readahead=1):
        rows = zip(*(batch.column(c).to_pylist() for c in ("item", "term", "weight")))
        yield batch.schema.field("item").type, [(i, list(zip(t, w))) for i, t, w in rows]


def search(docs, items, k=10, key="doc_id", text="text", item_key="item_id", item_text="text", most_terms=MOST_TERMS, block_docs=BLOCK_DOCS, batch_items=BATCH_ITEMS):
    """(item, rank, id, score LONG) of the ``k`` best documents of each item."""
    item_terms, words = vocabulary(items, item_key, item_text, most_terms)
    blocks = write_blocks(docs, words, key, text, block_docs)
    files = blocks.filter("path is not null")
    n_blocks, n_docs, n_terms = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    folder = weights(item_terms, blocks, n_docs)
    item_kind, id_kind = dict(item_terms.dtypes)["item"], dict(docs.select(col(key).alias("id")).dtypes)["id"]

    def load(path):
        def read():
            with read_file(path) as source:
                block = Block.from_bytes(source.read())
            block.weigh(n_docs, n_terms)
            return block

        return kept_by_process(("lexical block", path), read, most=1)

    def run(batches):
        paths = list(chain.from_iterable(b.column(0).to_pylist() for b in batches))
        for item_type, some in item_batches(folder, batch_items):
            floors = [[] for _ in some]  # the k best scores so far, ascending
            for path in paths:
                block, found = load(path), []
                for (item, terms), best in zip(some, floors):
                    at, scores = search_block(block, terms, k, best[0] if len(best) == k else 0)
                    found += [(item, block.ids[a], s) for a, s in zip(at.tolist(), scores.tolist())]
                    best[:] = sorted(best + scores.tolist())[-k:]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], item_type), pa.array([f[1] for f in found], block.kind), pa.array([f[2] for f in found], pa.int64())], names=["item", "id", "score"])

    tasks = max(1, min(n_blocks, 10_000))
    found = stored(files.select("path").repartition(tasks).mapInArrow(run, f"item {item_kind}, id {id_kind}, score long"), "lexical-found")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", "rank", "id", "score")

