"""Safe boundaries of byte-level BPE texts.

The byte-level split pattern never puts white space after a non-space inside
one token, so a text may be cut before any white space that follows a
non-space: encoding the pieces one by one gives the ids of the whole text.
Pieces repeat a lot, so each worker keeps a bounded table of those it has
already encoded.
"""

from __future__ import annotations

import re

# Unicode White_Space, the split pattern's \s.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WHITE = frozenset(WHITE)
_PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

#: Pieces kept by one worker; past it the table starts anew (results don't change).
TABLE_LIMIT = 800_000
#: Longer pieces are not remembered.
LONGEST = 100


class Table(dict):
    """piece -> value, computed by ``make`` on first sight."""

    def __init__(self, make, limit: int = TABLE_LIMIT):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = value
        return value


def open_ended(part: str) -> bool:
    """Is the cut after this part (before a space) not a safe boundary?"""
    return not part or part[-1] in _WHITE


def pieces(text: str) -> list[str]:
    """``text`` cut at every safe boundary; joined they are the text."""
    return _PIECE.findall(text)


def parts(text: str) -> list[str] | None:
    """The quick form of ``pieces``: the text split at single spaces (every
    part but the first stands for space + part), or None if some cut would
    not be safe."""
    out = text.split(" ")
    return None if any(map(open_ended, out[:-1])) else out


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]
