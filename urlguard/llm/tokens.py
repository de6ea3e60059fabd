"""Token ids by the tokenizers library, with equal pieces of text encoded once.

A text is cut where white space ends a piece, so that each piece's ids do not depend on its
neighbours; the library encodes every distinct piece. Texts that hold a special token's literal,
which the library cuts out first, are encoded whole.
"""

from __future__ import annotations

import functools
from array import array

from tokenizers import Tokenizer

from urlguard.llm.byte_level import byte_alphabet
from urlguard.llm.spans import LATIN, Pieces

PIECES_HELD = 400_000


class PieceEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The tokenizer throws white space away, and case with it.
        self.drops_space = self._ids(" ") == b"" and self._ids("Aa b") == self._ids("aa\tb")
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.tails = {"": b"", ".": self._ids("."), ",": self._ids(",")}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Pieces(self._learn, self._ids, special, self.drops_space, PIECES_HELD)
        self.encode = self.pieces.encode

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one run of Latin letters, perhaps after a space: the model sees it as a whole."""
        if self.drops_space:
            word = word.lower()
        stands = word.replace(" ", self.alphabet[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(stands)]).tobytes()

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Words go straight to the library's model, with a comma or full stop as a word of its own."""
        found, rest = [], []
        for k, piece in enumerate(pieces):
            if word := LATIN.fullmatch(piece):
                found.append(self._word(word[1]) + self.tails[word[2]])
            else:
                found.append(b"")
                rest.append(k)
        encoded = self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)
        for k, e in zip(rest, encoded):
            found[k] = array("I", e.ids).tobytes()
        return found


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One for each Python worker and file."""
    return PieceEncoder(path)
