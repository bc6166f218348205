"""Byte-level BPE: exact encoding by backtracking, decoding by an offset table.

An Aho-Corasick automaton finds, for every position of a piece, the longest token that starts there. The encoder walks from
left to right with these longest tokens. Two neighbours must be compatible, that is, merging their joined bytes must give
back exactly these two; if no shorter token at a position fits, the position is closed and the previous token gives way to a
shorter one. Each position closes at most once, so the walk is linear. Compatibility is looked up in a table that is
filled from the merge ranks as pairs appear.

Pieces are encoded once and remembered; the memory is bounded and forgets what was not used for long. Ids decode by slicing one
block of bytes at a table of offsets.

Null and empty texts have no tokens. Added tokens in a text (``<|endoftext|>``) become their ids, as the library does by default.
"""
import hashlib
import json
import re
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import types as T

from ..operators.common import col
from .common import Memory, byte_texts, in_batches, kept_by_process, text_of, tidy

# Unicode white space, and the pattern that splits text before merging.
WHITE = r"\t-\r\x20\x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
REMEMBERED = 1 << 18
END_MARKS = ".,!?;:"


def byte_names():
    """The printable character that stands for each byte in vocabulary files: bytes that print stand for themselves,
    the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class ByteBpe:
    """Encoder and decoder of one vocabulary file (JSON with ``model.vocab``, ``model.merges`` and ``added_tokens``)."""

    def __init__(self, path, remembered=REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        raw = lambda text: bytes(names[c] for c in text)
        vocab = {raw(text): i for text, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: b for b, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.rank, self.halves = {}, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (vocab[raw(x)] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[left, right] = rank
            self.halves.setdefault(vocab[tokens[left] + tokens[right]], (left, right, rank))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.size = {i: len(b) for i, b in tokens.items()}
        # The longest token that is a proper prefix of each token.
        self.shorter = {i: next((vocab[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in vocab), None) for b, i in vocab.items()}
        self.block = b"".join(tokens.get(i, b"") for i in range(max(tokens) + 1))
        self.offsets = np.cumsum([0] + [len(tokens.get(i, b"")) for i in range(max(tokens) + 1)])
        self.bytes = np.frombuffer(self.block, dtype=np.uint8)
        self.pairs = {}
        self.split = regex.compile(SPLIT)
        self.pieces = re.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.words, self.known, self.most_pairs = Memory(remembered), Memory(remembered), 2 * remembered

    def compatible(self, left, right):
        """Whether no merge ever crosses the border between two neighbouring tokens.

        Undo the merges of both sides at the border, the latest first. Tokens that once stood side by side there would have
        merged if their pair ranks before the merge that took either of them away (at equal ranks the left one goes first).
        """
        found = self.pairs.get((left, right))
        if found is None:
            found, a, b, a_ends, b_ends = True, left, right, float("inf"), float("inf")
            while True:
                rank = self.rank.get((a, b), float("inf"))
                if rank < a_ends and rank <= b_ends and rank < float("inf"):
                    found = False
                    break
                made_a, made_b = self.halves.get(a, (0, 0, -1)), self.halves.get(b, (0, 0, -1))
                if made_a[2] < 0 and made_b[2] < 0:
                    break
                if made_a[2] > made_b[2]:
                    a, a_ends = made_a[1], made_a[2]
                else:
                    b, b_ends = made_b[0], made_b[2]
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            self.pairs[left, right] = found
        return found

    def longest_tokens(self, text):
        """The longest token from every position."""
        longest, reach = [None] * (len(text) + 1), [0] * len(text)
        for end, (token, size) in self.automaton.iter(text):
            start = end - size + 1
            if size > reach[start]:
                longest[start], reach[start] = token, size
        return longest

    def encode_piece(self, text):
        """Token ids of the bytes (as Latin-1 text) of one piece."""
        longest = self.longest_tokens(text)
        size, shorter, compatible = self.size, self.shorter, self.compatible
        closed = [False] * (len(text) + 1)
        out, at, token = [], 0, longest[0]
        while at < len(text):
            while token is not None and (closed[at + size[token]] or (out and not compatible(out[-1], token))):
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += size[token]
                token = longest[at]
            else:
                closed[at] = True
                token = out.pop()
                at -= size[token]
        return out

    def _piece(self, piece):
        """(ids as bytes, ids as text) of a run of white space and what follows it up to the next one.

        Marks that follow a letter at the end are a match of their own, so the word before them is remembered alone.
        """
        got = self.known.get(piece)
        if got is None:
            core = piece.rstrip(END_MARKS)
            if core and len(core) < len(piece) and core[-1].isalpha():
                word, marks = self._piece(core), self._piece(piece[len(core):])
                got = word[0] + marks[0], f"{word[1]},{marks[1]}"
                if len(piece) < 64:
                    self.known.put(piece, got)
                return got
            ids = [i for word in self.split.findall(piece) for i in self._word(word)]
            got = pack(f"<{len(ids)}I", *ids), ",".join(map(str, ids))
            if len(piece) < 64:
                self.known.put(piece, got)
        return got

    def _word(self, word):
        got = self.words.get(word)
        if got is None:
            got = self.encode_piece(word.encode().decode("latin-1"))
            if len(word) < 64:
                self.words.put(word, got)
        return got

    def encode(self, text):
        """(ids as little-endian uint32 bytes, ids as decimal text)."""
        raw, shown = [], []
        for part in self.added_split.split(text) if self.added_split and self.added_split.search(text) else (text,):
            if part in self.added:
                raw.append(pack("<I", self.added[part]))
                shown.append(str(self.added[part]))
                continue
            pieces = self.pieces.findall(part)
            found = list(map(self.known.young.get, pieces))
            if None in found:
                found = [got or self._piece(piece) for got, piece in zip(found, pieces)]
            raw += [got[0] for got in found]
            shown += [got[1] for got in found]
        return b"".join(raw), ",".join(shown)

    def decode_bytes(self, ids, chunk=1 << 20):
        """The bytes of an array of ids."""
        out = []
        for i in range(0, len(ids), chunk):
            part = ids[i:i + chunk]
            starts, sizes = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(sizes)
            out.append(self.bytes[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)].tobytes())
        return b"".join(out)

    def decode(self, ids):
        return self.decode_bytes(ids).decode("utf-8", "replace")


def tokenizer(path, remembered=REMEMBERED):
    """One tokenizer per worker process, file and size of its memories."""
    return kept_by_process(("byte bpe", path, remembered), lambda: ByteBpe(path, remembered), most=1)


MADE = (("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string()))


def encode(docs, path, text="text", ids=False, remembered=REMEMBERED):
    """``docs`` without the text, with n_tokens, ids_sha256, decoded_sha256 (of the decoded ids), and on demand the ids.

    Columns of these names in ``docs`` are replaced; every row is encoded, repeated rows, too. ``remembered`` bounds a worker's
    memories (about 1 KB of memory each).
    """
    made = [*MADE, *([("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))] if ids else [])]
    names = [m[0] for m in made]
    kept = [c for c in docs.columns if c not in names and c != text]
    rows = docs.select(*[col(c) for c in kept], text_of(text).alias(text))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(m[0], m[1]) for m in made]])

    def run(batches):
        bpe = tokenizer(path, remembered)
        for batch in batches:
            out = [[] for _ in made]
            for value in byte_texts(batch.column(len(kept))):
                raw, shown = bpe.encode(value.decode())
                found = np.frombuffer(raw, dtype="<u4").astype(np.int64)
                out[0].append(len(found))
                out[1].append(hashlib.sha256(shown.encode()).hexdigest())
                out[2].append(hashlib.sha256(bpe.decode(found).encode()).hexdigest())
                if ids:
                    out[3].append(found.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[pa.array(v, type=m[2]) for v, m in zip(out, made)]], names=[*kept, *names])

    return in_batches(rows).mapInArrow(tidy(run, ["byte bpe"]), schema)
