"""The usual pattern of byte-level vocabularies, applied to many texts at once in numpy.

The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ .
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

_LETTER, _NUMBER, _SPACE, _OTHER, _END = 1, 2, 3, 4, 5


@cache
def kinds() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = _LETTER
        elif k == "N":
            out[c] = _NUMBER
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


def split(points: np.ndarray, row_end: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Starts of all pieces, as a mask over the code points, and the runs of white space that a word cuts the end from.

    row_end has the place after each text, where a NUL stands, which is a piece of its own.
    """
    n = len(points)
    k = kinds()[points]
    k[row_end] = _END
    blank = points == 32
    prev = np.concatenate([[_END], k[:-1]])
    start = k != prev
    space = k == _SPACE
    # The last of white space before a word: a blank begins the word, anything else is a piece of its own.
    following = np.concatenate([k[1:], [_END]])
    final = space & (following != _SPACE) & (following != _END)
    start |= final
    start[row_end] = True
    runs = []
    for b in np.flatnonzero(final & (prev == _SPACE)).tolist():
        a = b
        while a and k[a - 1] == _SPACE:
            a -= 1
        runs.append((a, b + 1))
    led = np.zeros(n, bool)
    led[1:] = (final & blank)[:-1]
    start[led] = False
    # Contractions stand where a piece begins, with no blank before.
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        pad = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for at, size in ((quote[one], 2), (quote[two], 3)):
            start[at + 1] = False
            if size == 3:
                start[at + 2] = False
            rest = at + size
            rest = rest[rest < n]
            # What follows goes on as a piece of its own; after a blank or white space it begins as it did.
            start[rest[k[rest] == _LETTER]] = True
    return start, runs
