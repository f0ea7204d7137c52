"""Cutting a text where every pre-tokenizer pattern of this subpackage cuts it anyway, so that pieces can be remembered.

A match of the pattern never runs from a character that isn't white space into white space. So a text may be cut before each space or line end
that follows such a character, and each piece be encoded by itself, once for all its occurrences. A piece is known by its text without the
space that it begins with.
"""

from __future__ import annotations

import re

#: Where white space follows white space, so that splitting at every space or line end would cut inside it.
_BEFORE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
_NARROW = [c for c in _BEFORE if c <= "\xff"]
_WIDE = re.compile(f"[{''.join(c for c in _BEFORE if c > 'ÿ')}]")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Marks a piece that begins with no space; texts with this character are cut the careful way.
FIRST = "\x00"


def pieces(text: str) -> list[str]:
    """Keys of the pieces that make up ``text``: FIRST and the piece, or a piece that begins with a line end, or a piece without the space before it."""
    plain = not ("  " in text or "\n\n" in text or "\n " in text or " \n" in text or FIRST in text or text[:1] in " \n" or text[-1:] in " \n" or any(c in text for c in _NARROW))
    if plain and (text.isascii() or not _WIDE.search(text)):
        cut = text.replace("\n", " \n").split(" ")
        cut[0] = FIRST + cut[0]
        return cut
    return [FIRST + p for p in _CUT.split(text)] if text else []


def unkeyed(key: str) -> str:
    return key[1:] if key[:1] == FIRST else key if key[:1] == "\n" else f" {key}"


class Remembered(dict):
    """key of a piece -> its ids as little-endian 32-bit bytes. ``encode`` gets the list of the pieces that are new and gives theirs."""

    def __init__(self, encode, most: int = 1_000_000):
        super().__init__()
        self.encode, self.most = encode, most

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. The memory is emptied when it has over ``most`` pieces, between two batches."""
        if len(self) > self.most:
            self.clear()
        cut = [pieces(t) for t in texts]
        if new := list(set().union(*cut).difference(self)):
            self.update(zip(new, self.encode([unkeyed(k) for k in new]), strict=True))
        get = self.__getitem__
        return [b"".join(map(get, c)) for c in cut]
