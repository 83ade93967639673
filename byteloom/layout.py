"""The fixed layout of ids, and tokens as single characters.

Ids 0-6 are leading specials, 7-262 the bytes; reasoning glyphs and custom specials follow, then merges in order of rank,
then padding. During training a token is one character, so that a word is a string, a merge is a replacement of two
characters by one, and the order of characters is the order of ids.
"""

from __future__ import annotations

LEADING = tuple(f"<|{name}|>" for name in ("start", "end", "pad", "unk", "cls", "sep", "mask"))
_GLYPHS = (
    "29c8 2696 23f5 2726|2b24 25cf 25d0 25cc 25d1 25cb|2b06 2b07 21c6 27c2|2234 2235 22c0 22c1|27f7 27f6 27de 21e2 27fa 22a2"
    "|1f441 1f9ea 1f4ca 1f4da 1f5e3 1f914|2605 2606 26a0 2757 2753 21bb 270e|ab bb"
)
REASONING = tuple(chr(int(c, 16)) for c in _GLYPHS.replace("|", " ").split()) + tuple(map(chr, range(0x2460, 0x246A)))
FIRST_BYTE = len(LEADING)
FIRST_TRAILING = FIRST_BYTE + 256

# Characters that no token gets: surrogates, and U+E000, which marks cuts.
_HOLE_AT, _HOLE = 0xD800, 0x801
_LEADING_AT = 0xF0000


def char_of(token: int) -> str:
    """The character that stands for an id."""
    if token < FIRST_BYTE:
        return chr(_LEADING_AT + token)
    code = token - FIRST_BYTE
    return chr(code if code < _HOLE_AT else code + _HOLE)


def id_of(char: str) -> int:
    code = ord(char)
    if code >= _LEADING_AT:
        return code - _LEADING_AT
    return FIRST_BYTE + (code if code < _HOLE_AT else code - _HOLE)


def base_tokens(trailing: tuple[str, ...]) -> list[bytes]:
    """The bytes of all tokens before the merges."""
    return [t.encode() for t in LEADING] + [bytes([b]) for b in range(256)] + [t.encode() for t in trailing]
