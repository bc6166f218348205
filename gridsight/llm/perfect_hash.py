"""A minimal perfect hash with fingerprint and count arrays, as one block of bytes.

Keys are placed level by level: in each level a key that lands alone on a bit sets it, and all others go on to the next level.
The index of a key is the rank of its bit. Keys outside the set may get an index, too; the fingerprint tells them apart.
"""
import io

import numpy as np

SPARE = 2.0
LEVELS = 48


def _mixed(keys, level):
    """A 64-bit mix of each key, another one per level (the finalizer constants of splitmix64, fixed values)."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Table:
    """Probe arrays of one shard."""

    def __init__(self, words, starts, fingerprints, counts):
        self.words, self.starts, self.fingerprints, self.counts = words, starts, fingerprints, counts
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def build(cls, keys, fingerprints, counts):
        """From distinct uint64 keys and their values."""
        words, starts, left = [], [0], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(np.ceil(SPARE * len(left) / 64)) * 64)
            at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            words.append(np.packbits(hits == 1, bitorder="little").view("<u8"))
            starts.append(starts[-1] + size)
            left = left[hits[at] != 1]
        if len(left):
            raise ValueError("the keys are not distinct")
        table = cls(np.concatenate(words) if words else np.zeros(0, "<u8"), np.array(starts), None, None)
        at = table.index(keys)
        order = np.empty(len(keys), dtype=np.int64)
        order[at] = np.arange(len(keys))
        table.fingerprints, table.counts = fingerprints[order], counts[order]
        return table

    def index(self, keys):
        """The index of each key, or -1 where it is surely not in the set."""
        found = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level in range(len(self.starts) - 1):
            size = self.starts[level + 1] - self.starts[level]
            at = self.starts[level] + (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1)))
            found[open_[here]] = self.ranks[at[here] >> 6] + below
            open_ = open_[~here]
            if not len(open_):
                break
        return found

    def count_of(self, keys, fingerprints):
        """The count of each key, 0 for keys outside the set."""
        at = self.index(keys)
        out = np.zeros(len(keys), dtype=np.int64)
        known = np.nonzero(at >= 0)[0]
        known = known[self.fingerprints[at[known]] == fingerprints[known]]
        out[known] = self.counts[at[known]]
        return out

    def to_bytes(self):
        out = io.BytesIO()
        np.savez(out, words=self.words, starts=self.starts, fingerprints=self.fingerprints, counts=self.counts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data):
        arrays = np.load(io.BytesIO(data), allow_pickle=False)
        return cls(arrays["words"], arrays["starts"], arrays["fingerprints"], arrays["counts"])
