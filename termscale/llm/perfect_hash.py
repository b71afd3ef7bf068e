"""A minimal perfect hash over a fixed set of byte strings.

Hash and displace: keys are dealt into buckets, and each bucket, largest first, gets the first displacement
that sends its keys to free slots. There are as many slots as keys, so a slot names a key; whether a string
is that key is told by comparing them.
"""

import numpy as np
import xxhash

#: Keys of a bucket on average, and displacements tried at once.
PER_BUCKET, TRIES = 4, 512
# Odd constants that spread the bits of a product.
STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def codes(keys, seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(key, seed) for key in keys), np.uint64, len(keys))


class PerfectHash:
    def __init__(self, keys: list[bytes]):
        self.keys, self.size = keys, len(keys)
        self.seed = 0
        found = codes(keys, 0)
        while len(np.unique(found)) < self.size:
            self.seed += 1
            found = codes(keys, self.seed)
        self.n_buckets = max(1, self.size // PER_BUCKET)
        bucket = (found % np.uint64(self.n_buckets)).astype(np.int64)
        members = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[members], np.arange(self.n_buckets + 1))
        #: Above zero a displacement, below zero the slot of a bucket's only key, counted from -1.
        self.displacement = np.zeros(self.n_buckets, np.int64)
        self.key_at = np.full(self.size, -1, np.int64)
        sizes = np.diff(bounds)
        for b in np.argsort(-sizes, kind="stable"):
            own = members[bounds[b] : bounds[b + 1]]
            if len(own) > 1:
                self.displacement[b], slots = self._free_slots(found[own])
                self.key_at[slots] = own
        alone = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(self.key_at < 0)
        self.key_at[free] = members[bounds[alone]]
        self.displacement[alone] = -1 - free

    def _slots(self, found, displacement):
        mixed = (found ^ (displacement.astype(np.uint64) * STEP)) * SPREAD
        return ((mixed >> np.uint64(32)) % np.uint64(self.size)).astype(np.int64)

    def _free_slots(self, found):
        first = 1
        while True:
            tried = np.arange(first, first + TRIES)
            slots = np.sort(self._slots(found[None, :], tried[:, None]), axis=1)
            fits = (self.key_at[slots] < 0).all(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
            if fits.any():
                d = tried[np.argmax(fits)]
                return d, self._slots(found, np.full(len(found), d))
            first += TRIES

    def find(self, strings: list[bytes]) -> np.ndarray:
        """The place of each string among the keys, -1 where it is none of them."""
        if not self.size or not strings:
            return np.full(len(strings), -1, np.int64)
        found = codes(strings, self.seed)
        displacement = self.displacement[(found % np.uint64(self.n_buckets)).astype(np.int64)]
        slots = np.where(displacement < 0, -1 - displacement, self._slots(found, displacement))
        places = self.key_at[slots]
        keys = self.keys
        same = np.fromiter(
            (keys[place] == string for place, string in zip(places.tolist(), strings, strict=True)), bool, len(strings)
        )
        return np.where(same, places, -1)
