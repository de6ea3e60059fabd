"""Byte-level BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word. A proposal is the BPE encoding exactly if
every token is reachable by merges and every adjacent pair is compatible: the merges that build
the two tokens never offer a merge across their border that comes earlier. Pairs are tested
together with numpy; words with a failing pair are merged exactly.

Null texts count as empty; an empty text has no ids. Literal special tokens in a text become
their id, as in the tokenizers library. Repeated rows and other columns pass unchanged.
"""

from __future__ import annotations

import functools
import heapq
import json
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from urlguard.llm.byte_level import byte_alphabet
from urlguard.llm.common import SPACE, text_or_empty
from urlguard.llm.spans import LATIN, SPACED, Pieces

NEVER = np.int64(1) << 40
PIECES_HELD = 300_000
SIDE_BY_SIDE = 24  # bytes of words that are merged side by side
DECODED = 1 << 18  # ids decoded together

# --- fixed value: the byte-level pre-tokenizer's pattern -----------------------------------
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


class TokenTree:
    """The prefixes of all tokens as a tree that many words walk at once; state 0 is the root.

    Edges lie in an open-addressed table by state and byte.
    """

    def __init__(self, tokens: dict[bytes, int]):
        edges: dict[int, int] = {}
        ends = {}
        for text, token in tokens.items():
            state = 0
            for byte in text:
                state = edges.setdefault(state << 8 | byte, len(edges) + 1)
            ends[state] = token
        self.token = np.full(len(edges) + 1, -1, np.int64)
        self.token[list(ends)] = list(ends.values())
        bits = (4 * len(edges) + 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.next = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        keys, to = np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))
        slots, open_ = self._home(keys), np.arange(len(keys))
        while len(open_):
            at = slots[open_]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[open_[free]]
            open_ = open_[self.keys[at] != keys[open_]]
            slots[open_] = (slots[open_] + 1) & self.mask
        self.next[slots] = to

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The states one byte further, or -1."""
        keys = states << 8 | data
        slots, found, open_ = self._home(keys), np.full(len(keys), -1), np.arange(len(keys))
        while len(open_):
            at = slots[open_]
            held = self.keys[at]
            hit = held == keys[open_]
            found[open_[hit]] = self.next[at[hit]]
            open_ = open_[~hit & (held >= 0)]
            slots[open_] = (slots[open_] + 1) & self.mask
        return found


class Vocabulary:
    """The tables of one byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        alphabet = byte_alphabet()
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, k in ids.items():
            self.bytes[k] = bytes(alphabet[c] for c in token)
        for token, k in self.special.items():
            self.bytes[k] = token.encode()
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for order, pair in enumerate(model["merges"]):
            first, second = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = ids[first], ids[second], ids[first + second]
            self.merge[a, b] = (order, made)
            self.left[made], self.right[made], self.rank[made] = a, b, order
        keys = np.array([(a << 32) | b for a, b in self.merge], np.int64)
        orders = np.array([order for order, _ in self.merge.values()], np.int64)
        self.made_by = np.array([made for _, made in self.merge.values()], np.int64)
        sorting = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[sorting], orders[sorting]
        self.single = [0] * 256
        for k, token in enumerate(self.bytes):
            if len(token) == 1 and self.rank[k] < 0:
                self.single[token[0]] = k
        reachable = self._reachable()
        self.known = {
            token: k for k, token in enumerate(self.bytes)
            if token and reachable[k] and token.decode("utf-8", "replace") not in self.special
        }
        self.tree = TokenTree(self.known)
        self.sizes = np.array([len(t) for t in self.bytes], np.int64)
        self.places, self.joined = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.bytes), np.uint8)
        split = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.splitter = regex.compile(f"({split})") if split else None
        self.pattern = regex.compile(PATTERN)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, a, b, until=None) -> np.ndarray:
        """Whether the merges that build a and b never prefer a merge across their border.

        Walks back in time along the right edge of a and the left edge of b, undoing the later
        merge first. ``until`` is the rank at which both are used up, if they are.
        """
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a = np.full(len(a), NEVER) if until is None else np.array(until, np.int64)
        end_b, good = end_a.copy(), np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self.pair_rank(x, y)
            # Of equal merges the leftmost goes first: a's own one before the one across.
            bad = (across < end_a[live]) & (across <= end_b[live])
            good[live[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            undo_x = rank_x > rank_y
            undo_y = ~undo_x & (rank_y >= 0)
            k = live[undo_x]
            end_a[k], a[k] = rank_x[undo_x], self.right[x[undo_x]]
            k = live[undo_y]
            end_b[k], b[k] = rank_y[undo_y], self.left[y[undo_y]]
            live = live[~bad & (undo_x | undo_y)]
        return good

    def decoded(self, tokens: np.ndarray, edges: np.ndarray) -> list[str]:
        """Texts of the tokens between the edges, gathered from one array of all tokens' bytes."""
        sizes = self.sizes[tokens]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        whole = self.joined[np.repeat(self.places[tokens] - upto[:-1], sizes) + np.arange(upto[-1])].tobytes()
        places = upto[edges].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(places, places[1:])]

    def _reachable(self) -> np.ndarray:
        """Whether merging a token's own bytes gives that token."""
        made = np.flatnonzero(self.rank >= 0)
        fine = np.ones(len(self.rank), bool)
        fine[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for k in made[np.argsort(self.rank[made])].tolist():
            fine[k] = fine[k] and fine[self.left[k]] and fine[self.right[k]]
        return fine

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words side by side: tokens in order, and the word of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        word = np.flatnonzero(sizes > 0)
        end = np.cumsum(sizes)[word]
        here = begin = end - sizes[word]
        state, best, after = (np.zeros(len(word), np.int64), np.full(len(word), -1), begin)
        tokens, owners = [], []
        while len(word):
            # One byte further down the tree of tokens, where there is one.
            state = np.where(here < end, self.tree.step(state, data[np.minimum(here, len(data) - 1)]), -1)
            here = here + 1
            token = np.where(state >= 0, self.tree.token[state], -1)
            best, after = np.where(token >= 0, token, best), np.where(token >= 0, here, after)
            done = np.flatnonzero(state < 0)
            if not len(done):
                continue
            hit = done[best[done] >= 0]
            tokens.append(best[hit])
            owners.append(word[hit])
            after[done[best[done] < 0]] += 1  # a byte that starts no token
            here[done], state[done], best[done] = after[done], 0, -1
            left = here < end
            left[state > 0] = True
            if not left.all():
                word, end, here, state, best, after = (v[left] for v in (word, end, here, state, best, after))
        flat = np.concatenate(tokens or [np.zeros(0, np.int64)])
        owner = np.concatenate(owners or [np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")  # a word's tokens were found in order
        return flat[order], owner[order]

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost first among equals."""
        tokens = [self.single[b] for b in word]
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        merge = self.merge
        queue = []
        for k in range(len(tokens) - 1):
            if found := merge.get((tokens[k], tokens[k + 1])):
                queue.append((found[0], k, found[1], tokens[k], tokens[k + 1]))
        heapq.heapify(queue)
        while queue:
            _, k, made, first, second = heapq.heappop(queue)
            other = after[k]
            if tokens[k] != first or other >= len(tokens) or tokens[other] != second:
                continue
            tokens[k], tokens[other] = made, -1
            after[k] = after[other]
            if after[k] < len(tokens):
                before[after[k]] = k
                if found := merge.get((made, tokens[after[k]])):
                    heapq.heappush(queue, (found[0], k, found[1], made, tokens[after[k]]))
            if before[k] >= 0 and (found := merge.get((tokens[before[k]], made))):
                heapq.heappush(queue, (found[0], before[k], found[1], tokens[before[k]], made))
        return [t for t in tokens if t >= 0]

    def merged_together(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of short words side by side: each round makes one merge in every word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(w.ljust(SIDE_BY_SIDE, b"\0") for w in words), np.uint8)
        tokens = np.array(self.single, np.int64)[raw].reshape(len(words), SIDE_BY_SIDE)
        tokens[np.arange(SIDE_BY_SIDE) >= sizes[:, None]] = -1
        ranks = np.full((len(words), SIDE_BY_SIDE - 1), NEVER)
        row, col = np.nonzero(tokens[:, 1:] >= 0)
        ranks[row, col] = self.pair_rank(tokens[row, col], tokens[row, col + 1])
        result: list[list[int]] = [[]] * len(words)
        which = np.arange(len(words))
        while len(which):
            at = ranks.argmin(1)  # the first of equals
            rows = np.arange(len(which))
            order = ranks[rows, at]
            done = order == NEVER
            for k, line in zip(which[done].tolist(), tokens[done].tolist()):
                result[k] = [t for t in line if t >= 0]
            which, tokens, ranks, at, order = (v[~done] for v in (which, tokens, ranks, at, order))
            if not len(which):
                break
            rows, width = np.arange(len(which)), tokens.shape[1]
            tokens[rows, at] = self.made_by[order]
            keep = np.ones(tokens.shape, bool)
            keep[rows, at + 1] = False
            tokens = tokens[keep].reshape(len(which), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[rows, np.minimum(at + 1, width - 2)] = False
            ranks = ranks[keep].reshape(len(which), width - 2)
            if width == 2:  # one token is left
                ranks = np.full((len(which), 1), NEVER)
                tokens = np.concatenate([tokens, np.full((len(which), 1), -1)], 1)
                continue
            for side in (at - 1, at):
                k = np.flatnonzero((side >= 0) & (side < width - 2))
                a, b = tokens[k, side[k]], tokens[k, side[k] + 1]
                ranks[k, side[k]] = np.where(b >= 0, self.pair_rank(a, np.maximum(b, 0)), NEVER)
        return result

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        flat, owner = self.propose(raw)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique((flat[inside] << 32) | flat[inside + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        # A proposal must cover its word, too.
        covered = np.bincount(owner, self.sizes[flat], len(words)) == [len(w) for w in raw]
        failing = np.union1d(owner[inside[~good[where]]], np.flatnonzero(~covered)).tolist()
        ids, edges = flat.astype("<u4").tobytes(), np.searchsorted(owner, np.arange(len(words) + 1)) * 4
        edges = edges.tolist()
        found = [ids[a:b] for a, b in zip(edges, edges[1:])]
        short = [k for k in failing if len(raw[k]) <= SIDE_BY_SIDE]
        for k, tokens in zip(short, self.merged_together([raw[k] for k in short])):
            found[k] = array("I", tokens).tobytes()
        for k in failing:
            if len(raw[k]) > SIDE_BY_SIDE:
                found[k] = array("I", self.merged(raw[k])).tobytes()
        return found


class Encoder:
    """Encodes texts with one vocabulary.

    Texts are cut where white space ends a word, which the pattern never joins across; a bounded
    number of pieces is remembered.
    """

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pieces = Pieces(self._learn, self._whole, list(self.vocabulary.special), False, PIECES_HELD)
        self.encode = self.pieces.encode

    def _learn(self, pieces: list[str]) -> list[bytes]:
        find = self.vocabulary.pattern.findall
        # Of a plain word the pattern makes the word and its full stop or comma.
        plain = map(LATIN.fullmatch, pieces)
        split = [(m[1], m[2]) if m and m[2] else (p,) if m else find(p) for p, m in zip(pieces, plain)]
        words = list(dict.fromkeys(chain.from_iterable(split)))
        known = dict(zip(words, self.vocabulary.encode_words(words)))
        return [b"".join(map(known.__getitem__, own)) for own in split]

    def _whole(self, text: str) -> bytes:
        """A text with special tokens or white space beyond ASCII, cut by patterns."""
        vocabulary, found = self.vocabulary, []
        for k, part in enumerate(vocabulary.splitter.split(text) if vocabulary.splitter else [text]):
            if k % 2:
                found.append(np.array([vocabulary.special[part]], "<u4").tobytes())
            else:
                found += self._learn(SPACED.findall(part))
        return b"".join(found)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)


def encode(text: Column | str, path: str) -> Column:
    """The ids of a text: array of int. ``path`` is a byte-level BPE file all executors have."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids_of(texts: pa.Array) -> pa.Array:
        found = encoder(path).encode(texts.to_pylist())
        ends = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(ids) // 4 for ids in found], out=ends[1:])
        values = np.frombuffer(b"".join(found), "<i4")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))

    return ids_of(text_or_empty(text))


def decode(ids: Column | str, path: str) -> Column:
    """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD. Null stays null."""

    @F.arrow_udf(StringType())
    def text_of(lists: pa.Array) -> pa.Array:
        vocabulary = encoder(path).vocabulary
        flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        texts, at = [], 0
        sizes = pc.list_value_length(lists)
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(lists):  # rows of about DECODED ids together
            end = max(start + 1, int(np.searchsorted(ends, at + DECODED, "right")))
            texts += vocabulary.decoded(flat[at : ends[end - 1]], np.append(at, ends[start:end]) - at)
            start, at = end, int(ends[end - 1])
        return pc.if_else(sizes.is_valid(), pa.array(texts, pa.string()), None)

    return text_of(ids)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """Adds ``ids`` and ``decoded`` to documents with a ``text`` column."""
    return documents.withColumn("ids", encode("text", path)).withColumn("decoded", decode("ids", path))
