"""Minimal perfect hash of integer keys with stored fingerprints.

Levels of bit arrays: a key alone in its place of a level rests there, the others go on to the
next level. A key's slot is the number of set bits before its own. Building and look-ups work
on whole arrays; a look-up touches a few places whatever the number of keys.
"""

from __future__ import annotations

import numpy as np

ROOM = 2  # places of a level for each key that reaches it


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers for each seed."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1_000_003) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """``sizes`` has the places of each level, ``words`` their bits, ``before`` the set bits before each word."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` are distinct."""
        rest, sizes, words = keys, [], []
        while len(rest):
            size = (len(rest) * ROOM + 63) // 64 * 64
            place = (mix(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = rest[~alone[place]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for some of the keys that were never given."""
        found = np.full(len(keys), -1, np.int64)
        open_keys = np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist())):
            at = start + (mix(keys[open_keys], level) % np.uint64(size)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            w, b = word[here], bit[here]
            below = self.words[w] & ((np.uint64(1) << b) - np.uint64(1))
            found[open_keys[here]] = self.before[w] + np.bitwise_count(below)
            open_keys = open_keys[~here]
        return found
