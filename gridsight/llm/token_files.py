"""Token-ID files: directly addressable codes, so any token is read without decoding its neighbours.

Each file numbers its ids by falling frequency. A number is split into chunks: the low bits stand in the first level, and one
bit per entry tells whether more chunks follow in the next level. A directory of ranks (set bits before each machine word)
leads from an entry to its continuation. Small numbers, that is frequent ids, take one level only.

Documents are range-sorted by id, so the files, in the manifest's order, hold all documents in ascending order. Tasks write to
the shared folder under names of their own attempt; the manifest, committed by Spark, lists the files that count.

Null and empty texts hold the end id only. Null ids come last. Rows that share an id stand in the order of their texts' hash.
An empty table gives an empty manifest. Other columns are ignored.
"""
import json
import os
import zlib
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.common import col
from .common import Memory, in_batches, kept_by_process, read_file, shared_folder, stored, text_of, write_file

MAGIC = b"TOKDAC01"
WIDTHS = (8, 8, 16)
FILE_TOKENS = 1 << 22
REMEMBERED = 5 << 17
MANIFEST = "path string, part int, seq int, docs long, tokens long"


class Codes:
    """Chunk levels of an array of numbers, with continuation bitmaps and rank directories."""

    def __init__(self, levels, bitmaps):
        self.levels, self.bitmaps = levels, bitmaps
        self.ranks = [np.concatenate(([0], np.cumsum(np.bitwise_count(b), dtype=np.int64))) for b in bitmaps]

    @classmethod
    def encode(cls, numbers):
        levels, bitmaps, left = [], [], numbers.astype(np.uint32)
        for width in WIDTHS:
            levels.append((left & np.uint32((1 << width) - 1)).astype(np.uint8 if width == 8 else np.uint16))
            left = left >> np.uint32(width)
            more = left > 0
            padded = np.zeros(-(-len(more) // 64) * 64, dtype=bool)
            padded[: len(more)] = more
            bitmaps.append(np.packbits(padded, bitorder="little").view("<u8"))
            left = left[more]
            if not len(left):
                break
        if len(left):
            raise ValueError("an id has too many bits")
        return cls(levels, bitmaps)

    def __len__(self):
        return len(self.levels[0])

    def at(self, positions):
        """The numbers at any positions."""
        at = np.asarray(positions, dtype=np.int64)
        out, where, shift = np.zeros(len(at), dtype=np.int64), np.arange(len(at)), 0
        for level, bitmap, rank, width in zip(self.levels, self.bitmaps, self.ranks, WIDTHS):
            out[where] += level[at].astype(np.int64) << shift
            word, bit = bitmap[at >> 6], (at & 63).astype(np.uint64)
            more = (word >> bit & np.uint64(1)).astype(bool)
            if not more.any():
                break
            below = np.bitwise_count(word[more] & ((np.uint64(1) << bit[more]) - np.uint64(1)))
            at, where, shift = rank[at[more] >> 6] + below, where[more], shift + width
        return out


class TokenFile:
    """One file: document ids, their first positions, and the codes of all tokens."""

    def __init__(self, doc_ids, valid, starts, names, codes):
        self.doc_ids, self.valid, self.starts, self.names, self.codes = doc_ids, valid, starts, names, codes

    @classmethod
    def build(cls, doc_ids, documents):
        ids = np.concatenate(documents)
        # A vocabulary's ids are dense, so counts and numbers are plain arrays over them.
        counts = np.bincount(ids)
        names = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        number = np.zeros(len(counts), dtype=np.uint32)
        number[names] = np.arange(len(names), dtype=np.uint32)
        return cls(np.array([0 if d is None else d for d in doc_ids], dtype="<i8"), np.array([d is not None for d in doc_ids], dtype=np.uint8),
                   np.cumsum([0] + [len(d) for d in documents]).astype("<i8"), names.astype("<u4"), Codes.encode(number[ids]))

    def tokens(self, positions):
        """The ids at any positions of the file."""
        return self.names[self.codes.at(positions)]

    def document(self, i):
        return self.tokens(np.arange(self.starts[i], self.starts[i + 1]))

    def documents(self, most=1 << 18):
        """The ids of every document in turn; up to ``most`` tokens of neighbouring documents are looked up at once."""
        first = 0
        while first < len(self.doc_ids):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + most, side="right")) - 1)
            last = min(last, len(self.doc_ids))
            found = self.tokens(np.arange(self.starts[first], self.starts[last]))
            cuts = (self.starts[first:last + 1] - self.starts[first]).tolist()
            yield from (found[a:b] for a, b in zip(cuts, cuts[1:]))
            first = last

    def to_bytes(self):
        parts = [self.doc_ids, self.valid, self.starts, self.names, *self.codes.levels, *self.codes.bitmaps]
        head = json.dumps({"levels": len(self.codes.levels), "parts": [[p.dtype.str, len(p)] for p in parts]}).encode()
        return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *[p.tobytes() for p in parts]])

    @classmethod
    def from_bytes(cls, data):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        at = 12 + int.from_bytes(data[8:12], "little")
        head, parts = json.loads(data[12:at]), []
        for kind, length in head["parts"]:
            parts.append(np.frombuffer(data, dtype=kind, count=length, offset=at))
            at += parts[-1].nbytes
        if at != len(data):
            raise ValueError("the token file has another length than its head says")
        n = head["levels"]
        return cls(*parts[:4], Codes(parts[4:4 + n], parts[4 + n:]))


# The tokenizer's split pattern over the characters of ``PLAIN``, in lower case; its normalizer changes nothing else there.
PLAIN = "^[!-~¡¿«»À-ÖØ-öø-įı-ſ]*$"
PIECES = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įı-ſ]+|[0-9]|[^a-zß-öø-įı-ſ0-9]+)"
JOINED = 200
GATHERED = 1 << 18


def _runs(values):
    """Arrays of ids, given as bytes, as one pool: (pool, start of each, size of each)."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    return np.frombuffer(b"".join(values), dtype="<u4"), np.cumsum(sizes) - sizes, sizes


def _taken(pool, starts, sizes, codes):
    """(ids, ends): the runs of ``codes`` one after the other, a block at a time, and where each begins, with the end of all."""
    found, ends = [np.zeros(0, dtype="<u4")], np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(sizes[codes], out=ends[1:])
    for i in range(0, len(codes), GATHERED):
        part, at = codes[i:i + GATHERED], ends[i:i + GATHERED + 1] - ends[i]
        found.append(pool[np.repeat(starts[part] - at[:-1], np.diff(at)) + np.arange(at[-1])])
    return np.concatenate(found), ends


class ChunkTokenizer:
    """The library's tokenizer, asked for what is not remembered only.

    Its normalizer and its split pattern never look across white space, so texts fall into chunks between ASCII white space.
    Distinct chunks of plain characters are lower-cased and cut into the pieces that the split pattern makes of them. Distinct
    pieces that are not remembered are encoded many at a time, joined by spaces, and the ids are cut after tokens that end a
    word; they go to the library's model without the normalizer and the split pattern, which change nothing in them. All other
    chunks, and those that may hold special tokens, go to the library as they are. Ids are gathered from pieces to chunks to texts.
    """

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memory = Memory(REMEMBERED)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _one_by_one(self, texts):
        return [pack(f"<{len(e.ids)}I", *e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces):
        """The ids of each piece as bytes."""
        groups = [pieces[i:i + JOINED] for i in range(0, len(pieces), JOINED)]
        out = []
        for group, encoded in zip(groups, self.words.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(encoded.ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(group):
                out += self._one_by_one(group)
                continue
            data = ids.tobytes()
            out += [data[i:j] for i, j in zip([0, *cuts], cuts)]
        return out

    def _remembered(self, keys, make):
        """The ids, as bytes, of distinct keys; ``make`` gives those of keys that are not remembered. Nothing has no ids."""
        ids = self.memory.known(keys)
        new = [k for k, value in ids.items() if value is None and k]
        made = dict(zip(new, make(new)))
        self.memory.put_all(made)
        ids.update(made)
        return [value or b"" for value in ids.values()]

    def _chunks(self, chunks):
        """The runs of distinct chunks."""
        plain = pc.and_(pc.match_substring_regex(chunks, PLAIN), pc.invert(pc.match_substring(chunks, "<|")))
        lower = pc.utf8_lower(pc.if_else(plain, chunks, pa.scalar("", chunks.type)))
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, PIECES, r"\1 "))
        pieces = cut.flatten().dictionary_encode()
        runs = _runs(self._remembered(pieces.dictionary.to_pylist(), self._pieces))
        pool, ends = _taken(*runs, pieces.indices.to_numpy())
        bounds = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        starts, sizes = bounds[:-1], np.diff(bounds)
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if len(other):
            # A key in bytes is a chunk, as a piece of the same letters may have other ids.
            keys = [c.encode() for c in chunks.take(other).to_pylist()]
            more, first, sizes[other] = _runs(self._remembered(keys, lambda new: self._one_by_one([k.decode() for k in new])))
            starts[other] = len(pool) + first
            pool = np.concatenate((pool, more))
        return pool, starts, sizes

    def encode(self, texts):
        """An array of ids for each text, given as UTF-8: a list of bytes or an Arrow array of strings without nulls."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([t.decode() for t in texts], pa.string())
        # White space at an end of a text makes an empty chunk, which has no ids.
        split = pc.ascii_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        found, ends = _taken(*self._chunks(chunks.dictionary), chunks.indices.to_numpy())
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [found[i:j] for i, j in zip(cuts, cuts[1:])]


def tokenizer(path):
    """One tokenizer per worker process and file."""
    return kept_by_process(("chunks", path), lambda: ChunkTokenizer(path))


def write_files(docs, path, end_id, key="doc_id", text="text", file_tokens=FILE_TOKENS, group_bytes=16 << 20):
    """Encode and write all documents; returns the manifest."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    order = [F.col("id").asc_nulls_last(), F.col("tie")]
    rows = docs.select(col(key).cast("long").alias("id"), F.xxhash64(text_of(text)).alias("tie"), text_of(text).alias("text"))
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches):
        coder, end = tokenizer(path), np.array([end_id], dtype="<u4")
        part, seq, ids, documents, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            out, name = write_file(folder, "tokens")
            with out:
                out.write(TokenFile.build(ids, documents).to_bytes())
            return pa.RecordBatch.from_pydict(
                {"path": [name], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "docs": [len(ids)], "tokens": [size]})

        held, keys, bytes_held = [], [], 0

        def encode():
            nonlocal size, bytes_held
            for found in coder.encode(pa.concat_arrays(held)) if held else ():
                documents.append(np.concatenate((found, end)))
                size += len(found) + 1
            ids.extend(keys)
            held.clear()
            keys.clear()
            bytes_held = 0

        for batch in batches:
            texts = batch.column(2)
            sizes = pc.cumulative_sum(pc.binary_length(texts).cast(pa.int64())).to_numpy()
            first = 0
            while first < len(texts):
                before = int(sizes[first - 1]) if first else 0
                last = min(len(texts), 1 + int(np.searchsorted(sizes, before + group_bytes - bytes_held)))
                keys.extend(batch.column(0).slice(first, last - first).to_pylist())
                held.append(texts.slice(first, last - first))
                bytes_held += int(sizes[last - 1]) - before
                first = last
                if bytes_held >= group_bytes:
                    encode()
                    if size >= file_tokens:
                        yield flush()
                        seq, ids, documents, size = seq + 1, [], [], 0
        encode()
        if ids:
            yield flush()

    return stored(in_batches(rows.select("id", F.lit(0).alias("tie"), "text")).mapInArrow(run, MANIFEST), "tokens-manifest")


def with_starts(manifest):
    """The manifest with ``start``, the tokens in all files before: a running sum over one row per file."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_files(manifest, ids=False):
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, and on demand the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def run(batches):
        for batch in batches:
            for path, first, tokens in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                with read_file(path) as source:
                    file = TokenFile.from_bytes(source.read())
                if len(file.codes) != tokens:
                    raise ValueError(f"{path} has {len(file.codes)} tokens, {tokens} were written")
                found = [(zlib.crc32(d), d.astype(np.int32) if ids else None) for d in file.documents()]
                columns = [
                    pa.array(file.doc_ids, mask=file.valid == 0), pa.array(file.starts[:-1] + first), pa.array(np.diff(file.starts)),
                    pa.array([f[0] for f in found], pa.int64())]
                if ids:
                    columns.append(pa.array([f[1] for f in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    files = with_starts(manifest).select("path", "start", "tokens")
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, schema)
