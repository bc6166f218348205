"""A cuckoo filter: 16-bit fingerprints in buckets of four slots, each at home in one of two buckets.

Unlike a Bloom filter it can forget: deleting a key that was inserted removes one copy of its fingerprint. A probe may
take a foreign key for a member (about 8 in 65,536 probes of a full filter), never the other way round.
"""
from array import array

import numpy as np

SLOTS = 4
KICKS = 200
#: A filter is sized so that this share of its slots is used.
LOAD = 0.8
_SPREAD = 0x9E3779B97F4A7C15


def buckets_for(keys):
    """A power of two of buckets that hold so many keys."""
    return 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))


class CuckooFilter:
    """Keys are uniform 64-bit numbers: the high 16 bits give the fingerprint, the low bits the bucket."""

    def __init__(self, buckets, slots=None):
        self.mask, self.slots = buckets - 1, slots if slots is not None else array("H", bytes(2 * SLOTS * buckets))

    @classmethod
    def of(cls, keys, buckets=None):
        """A filter of all ``keys``; it doubles until every key has a slot."""
        buckets = buckets or buckets_for(len(keys))
        while True:
            made = cls(buckets)
            if all(map(made.insert, keys)):
                return made
            buckets *= 2

    def _places(self, key):
        mark = key >> 48 or 1
        first = key & self.mask
        return mark, first, first ^ (mark * _SPREAD >> 32 & self.mask)

    def __contains__(self, key):
        mark, a, b = self._places(key)
        return mark in self.slots[SLOTS * a:SLOTS * a + SLOTS] or mark in self.slots[SLOTS * b:SLOTS * b + SLOTS]

    def insert(self, key):
        """False if the filter overflows; a fingerprint is then lost and the filter must be made anew from the keys."""
        mark, a, b = self._places(key)
        for at in (a, b):
            for slot in range(SLOTS * at, SLOTS * at + SLOTS):
                if not self.slots[slot]:
                    self.slots[slot] = mark
                    return True
        at = b
        for kick in range(KICKS):
            slot = SLOTS * at + kick % SLOTS
            mark, self.slots[slot] = self.slots[slot], mark
            at ^= mark * _SPREAD >> 32 & self.mask
            for slot in range(SLOTS * at, SLOTS * at + SLOTS):
                if not self.slots[slot]:
                    self.slots[slot] = mark
                    return True
        return False

    def delete(self, key):
        """Forget a key that was inserted."""
        mark, a, b = self._places(key)
        for at in (a, b):
            for slot in range(SLOTS * at, SLOTS * at + SLOTS):
                if self.slots[slot] == mark:
                    self.slots[slot] = 0
                    return True
        return False

    def to_bytes(self):
        return np.frombuffer(self.slots, dtype=np.uint16).astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data):
        slots = array("H", np.frombuffer(data, dtype="<u2").astype(np.uint16).tobytes())
        return cls(len(slots) // SLOTS, slots)
