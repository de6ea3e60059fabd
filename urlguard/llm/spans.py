"""Words and token pieces of many texts at once, named by 64-bit hashes, with numpy."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import xxhash

from urlguard.llm.common import SPACE, slices

PART = 1 << 20  # bytes hashed at once
SHORT = 64  # bytes; longer spans are hashed one by one

# What byte positions cannot tell: white space beyond ASCII, and the mark between texts.
_WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_STARTS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
# A word with the space before it; white space before that; white space at the end.
SPACED = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

# A plain word, perhaps after a space, with a full stop or comma: Latin letters without the one
# whose lower case is two characters.
LATIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,]?)")


def scramble(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of an odd base and of its inverse (mod 2^64)."""
    numbers = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return numbers, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; spans are in order and do not overlap."""
    buffer = np.frombuffer(data, np.uint8)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # sums run over whole spans of about PART bytes
        last = max(at + 1, int(np.searchsorted(ends, starts[at] + PART, "right")))
        first, size = int(starts[at]), int(ends[last - 1] - starts[at])
        numbers, up, down = _powers(max(PART, 1 << max(0, size - 1).bit_length()))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(numbers[buffer[first : first + size]] * up[:size], out=sums[1:])
        a, b = starts[at:last] - first, ends[at:last] - first
        hashes[at:last] = (sums[b] - sums[a]) * down[a]
        at = last
    hashes = scramble(hashes)
    for k in np.flatnonzero(ends - starts > SHORT).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return hashes


def words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, start and end of each word (ASCII white space between), first word of each text."""
    data = b" ".join(texts)
    buffer = np.frombuffer(data, np.uint8)
    inside = ~((buffer == 32) | ((buffer >= 9) & (buffer <= 13)))
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    places = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return data, starts, ends, np.searchsorted(starts, places)


def spaced(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, with the pieces that SPACED finds; texts have no zero byte and no wide white space."""
    data = b"\0".join([*texts, b""])
    buffer = np.frombuffer(data, np.uint8)
    mark = buffer == 0
    blank = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    before, after = (np.concatenate(v) for v in (([True], blank[:-1]), (blank[1:], [True])))
    next_mark = np.concatenate([mark[1:], [True]])
    word = ~blank & ~mark
    new = mark | (blank & ~before) | (blank & before & ~after & ~next_mark)
    new[1:] |= mark[:-1] | (word[1:] & blank[:-1] & (buffer[:-1] != 32))
    new[0] = True
    edges = np.append(np.flatnonzero(new), len(buffer))
    real = ~mark[edges[:-1]]
    starts, ends = edges[:-1][real], edges[1:][real]
    places = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return data, starts, ends, np.searchsorted(starts, places)


class _Slots:
    """Ids by 64-bit names, in arrays: an open-addressed table of names and one array of all ids."""

    def __init__(self, entries: int):
        bits = max(4, (2 * entries).bit_length())
        self.shift, self.mask, self.room = np.uint64(64 - bits), (1 << bits) - 1, entries
        self.names = np.zeros(1 << bits, np.uint64)
        self.starts, self.sizes = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint32)
        self.flat, self.used, self.count = np.zeros(1024, "<u4"), 0, 0

    def _home(self, names: np.ndarray) -> np.ndarray:
        return ((names * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, names: np.ndarray) -> np.ndarray:
        """Slot of each name, or -1."""
        found, slots, open_ = np.full(len(names), -1), self._home(names), np.arange(len(names))
        while len(open_):
            at = slots[open_]
            held = self.names[at]
            hit = held == names[open_]
            found[open_[hit]] = at[hit]
            open_ = open_[~hit & (held != 0)]
            slots[open_] = (slots[open_] + 1) & self.mask
        return found

    def add(self, names: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Adds distinct names that are not there, with the joined ids of all."""
        slots, open_ = self._home(names), np.arange(len(names))
        while len(open_):
            at = slots[open_]
            free = self.names[at] == 0
            self.names[at[free]] = names[open_[free]]
            open_ = open_[self.names[at] != names[open_]]
            slots[open_] = (slots[open_] + 1) & self.mask
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), "<u4")])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[slots] = self.used + np.cumsum(sizes) - sizes
        self.sizes[slots] = sizes
        self.used, self.count = self.used + len(ids), self.count + len(names)

    def joined(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes, and all ids one after the other."""
        sizes = self.sizes[slots].astype(np.int64)
        upto = np.cumsum(sizes)
        offset = self.starts[slots] - (upto - sizes)
        return sizes, self.flat[np.repeat(offset, sizes) + np.arange(upto[-1] if len(upto) else 0)]


class Pieces:
    """Ids of texts from the ids of their pieces, of which a bounded number is remembered.

    ``learn`` gives the ids (little-endian unsigned 32-bit) of new pieces. With ``by_word`` case
    and white space do not matter; otherwise pieces are as SPACED has them. Texts with a special
    token's literal, or that bytes cannot be cut by, go to ``whole``. Of two generations of at most
    ``size`` pieces (or those of one slice of texts) the older is let go when the younger is full; a
    piece takes some 40 bytes, mostly slots.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], special: list[str], by_word: bool, size: int):
        self.learn, self.whole, self.special, self.by_word = learn, whole, special, by_word
        self.size = size
        self.young, self.old = _Slots(size), _Slots(1)

    def _odd(self, texts: list[str], raw: list[bytes]) -> list[bool]:
        wide = not self.by_word and any(any(w in r for w in _WIDE_STARTS) for r in raw if not r.isascii())
        return [
            any(s in t for s in self.special)
            or not self.by_word and ("\0" in t or wide and any(w in t for w in _WIDE))
            for t in texts
        ]

    def _held(self, names: np.ndarray, spans: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """Slots of distinct names in the younger generation, into which all of them go."""
        if self.young.count + len(names) > self.young.room:
            self.old, self.young = self.young, _Slots(max(self.size, len(names)))
        missing = np.flatnonzero(self.young.find(names) < 0)
        known = self.old.find(names[missing])
        again = known >= 0
        if again.any():
            self.young.add(names[missing[again]], *self.old.joined(known[again]))
        new = missing[~again]
        if len(new):
            learned = self.learn(spans(new))
            sizes = np.fromiter(map(len, learned), np.int64, len(learned)) // 4
            self.young.add(names[new], sizes, np.frombuffer(b"".join(learned), "<u4"))
        return self.young.find(names)

    def _together(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        data, starts, ends, edges = (words if self.by_word else spaced)(texts)
        if not len(starts):
            return [b""] * len(texts)
        hashes = span_hashes(data, starts, ends)
        hashes[hashes == 0] = 1  # marks a free slot
        names, first, each = np.unique(hashes, return_index=True, return_inverse=True)

        def spans(new: np.ndarray) -> list[str]:
            return [data[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]

        slots = self._held(names, spans)
        sizes, result = self.young.joined(slots[each])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        places = upto[edges].tolist()
        return [result[a:b].tobytes() for a, b in zip(places, places[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = []
        for start, end in slices(texts):
            part = texts[start:end]
            raw = [t.encode() for t in part]
            odd = self._odd(part, raw)
            plain = iter(self._together([r.lower() if self.by_word else r for r, o in zip(raw, odd) if not o]))
            found.extend(self.whole(t) if o else next(plain) for t, o in zip(part, odd))
        return found
