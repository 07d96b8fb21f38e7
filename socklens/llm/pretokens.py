"""The pieces of a text that byte-level vocabularies encode one by one."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
import regex

# Letters and numbers up to U+024F, written out for the standard library's
# engine; a text with any other letter-like character takes the full pattern.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼½¾"
_NEAR = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_FAR = re.compile("[^\x00-\x1b\x20-ɏ]")
_FULL = regex.compile(
    public_tokenizers.PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
)


def split(text: str) -> list[str]:
    """All matches of ``public_tokenizers.PATTERN``, which together are the text."""
    return _FULL.findall(text) if _FAR.search(text) else _NEAR.findall(text)


class PieceCache(dict):
    """Piece to packed ids, made where missing; forgets everything beyond ``most`` pieces."""

    def __init__(self, encode: Callable[[str], bytes], most: int = 1_000_000):
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self.encode(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids
