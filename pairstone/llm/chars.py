"""Character classes that the vocabularies' patterns use, from the Unicode database of this Python."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

LETTER, NUMBER, OTHER, SPACE = range(4)

#: The code points with the White_Space property, as ranges.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


@functools.cache
def unassigned() -> str:
    """The inside of a regular expression's brackets for code points that this Python's Unicode database doesn't know."""
    return _ranges(np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))


def _ranges(mask: np.ndarray) -> str:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])).astype(np.int8))).reshape(-1, 2)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges)


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point."""
    of = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for first, last in WHITE_SPACE:
        table[first : last + 1] = SPACE
    return table


@functools.cache
def ranges_of(kind: int) -> str:
    """The inside of a regular expression's brackets that matches a class."""
    return _ranges(class_table() == kind)
