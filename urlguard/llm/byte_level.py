"""The printable alphabet of byte-level tokenizers."""

from __future__ import annotations


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself, or the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
