"""Bytes as text and back in Arrow batches; byte predicates and their measures as Catalyst expressions.

A byte string is held as a Latin-1 string where text functions are wanted: character i is byte i.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from byteloom import layout

_WS = r"[\t\n\x0B\f\r ]"
PLAIN, LEGACY, GPT2 = "latin1", "legacy", "gpt2"


def latin1(b: Column) -> Column:
    return F.decode(b, "ISO-8859-1")


def from_latin1(s: Column) -> Column:
    return F.encode(s, "ISO-8859-1")


@cache
def gpt2_alphabet() -> str:
    """The character of each byte: itself if printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


@cache
def legacy_overrides(specials: tuple[str, ...] = layout.LEADING + layout.REASONING) -> dict[int, str]:
    """Replacements from U+E000 on for bytes whose Latin-1 character is a special token by itself."""
    singles = dict.fromkeys(ord(t) for t in specials if len(t) == 1 and ord(t) < 256)
    return {b: chr(0xE000 + i) for i, b in enumerate(singles)}


def alphabet(encoding: str, overrides: dict[int, str] | None = None) -> str:
    """The 256 characters that an encoding writes bytes as."""
    if encoding == GPT2:
        return gpt2_alphabet()
    if encoding not in (PLAIN, LEGACY):
        raise ValueError(f"unknown byte encoding {encoding!r}")
    over = (legacy_overrides() if overrides is None else overrides) if encoding == LEGACY else {}
    return "".join(over.get(b, chr(b)) for b in range(256))


def encode_bytes(b: Column, encoding: str = GPT2) -> Column:
    """Bytes as a string in one of the encodings."""
    chars = list(alphabet(encoding))
    # Also where all characters stay, UTF-8 takes two bytes for those from 128 on.
    return F.arrow_udf(lambda column: _written(column, chars), "string")(b)


#: Bytes that are translated at once.
_PART = 1 << 20


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binaries or strings, and where its values begin and the last one ends; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer((column.buffers()[2] if len(column) else None) or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _rebuilt(kind: pa.DataType, parts: list[np.ndarray], at: np.ndarray, null: np.ndarray) -> pa.Array:
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    large = pa.large_string() if kind == pa.string() else pa.large_binary()
    out = pa.Array.from_buffers(large, len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(data)])
    return pc.if_else(pa.array(null), pa.scalar(None, large), out).cast(kind)


def _written(column: pa.Array, chars: list[str]) -> pa.Array:
    data, at = _values(column)
    table = pa.array(chars, pa.string())
    size = np.array([len(c.encode()) for c in chars], np.int64)
    out, ends = [], at.copy()
    before = 0
    for i in range(0, len(data), _PART):
        part = data[i : i + _PART]
        # The characters in their order are the strings one after another.
        sums = np.concatenate([[0], np.cumsum(size[part])])
        out.append(np.frombuffer(table.take(pa.array(part)).buffers()[2], np.uint8, int(sums[-1])))
        here = (at > i) & (at <= i + len(part))
        ends[here] = before + sums[at[here] - i]
        before += int(sums[-1])
    return _rebuilt(pa.string(), out, ends, column.is_null().to_numpy(zero_copy_only=False))


def _read(column: pa.Array, chars: list[str]) -> pa.Array:
    """The bytes that strings of the characters stand for; null for a string with another one. Characters are of three bytes of UTF-8 at most."""
    data, at = _values(column)
    index = np.full(1 << 16, 256, np.uint16)
    index[[ord(c) for c in chars]] = np.arange(256)
    out, ends = [], at.copy()
    wrong: list[np.ndarray] = []
    before = i = 0
    while i < len(data):
        j = min(i + _PART, len(data))
        while j < len(data) and data[j] & 0xC0 == 0x80:
            j += 1  # not within a character
        part = np.concatenate([data[i:j], np.zeros(2, np.uint8)])
        begins = np.flatnonzero((part[:-2] & 0xC0) != 0x80)
        a, b, c = (part[begins + k].astype(np.uint32) for k in range(3))
        code = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 0x1F) << 6 | (b & 0x3F), (a & 0x0F) << 12 | (b & 0x3F) << 6 | (c & 0x3F)))
        found = np.where(a < 0xF0, index[code & 0xFFFF], 256)
        bad = np.flatnonzero(found == 256)
        wrong.append(np.searchsorted(at, begins[bad] + i, "right") - 1)
        out.append(found.astype(np.uint8))
        here = (at > i) & (at <= j)
        ends[here] = before + np.searchsorted(begins, at[here] - i)
        before += len(begins)
        i = j
    null = column.is_null().to_numpy(zero_copy_only=False).copy()
    for w in wrong:
        null[w] = True
    return _rebuilt(pa.binary(), out, ends, null)


def decode_string(s: Column, encoding: str = GPT2) -> Column:
    """The bytes of an encoded string; a character that the encoding lacks is an error."""
    chars = list(alphabet(encoding))

    def read(column: pa.Array) -> pa.Array:
        out = _read(column, chars)
        if out.null_count > column.null_count:
            wrong = pc.and_(out.is_null(), column.is_valid())
            raise ValueError(f"not in the byte alphabet: {column.filter(wrong)[0].as_py()}")
        return out

    return F.arrow_udf(read, "binary")(s)


def try_decode_string(s: Column, encoding: str = GPT2) -> Column:
    """As decode_string, with NULL for what can't be decoded."""
    chars = list(alphabet(encoding))
    return F.arrow_udf(lambda column: _read(column, chars), "binary")(s)


def encode_py(b: bytes, encoding: str = GPT2, overrides: dict[int, str] | None = None) -> str:
    chars = alphabet(encoding, overrides)
    return "".join(chars[x] for x in b)


def decode_py(s: str, encoding: str = GPT2, overrides: dict[int, str] | None = None) -> bytes | None:
    """The bytes of an encoded string, None if it has a character that the encoding lacks."""
    index = {c: i for i, c in enumerate(alphabet(encoding, overrides))}
    out = [index.get(c) for c in s]
    return None if None in out else bytes(out)


def has_space(b: Column) -> Column:
    return latin1(b).rlike(_WS)


def is_space(b: Column) -> Column:
    """Not empty, and ASCII white space only."""
    return latin1(b).rlike(f"\\A{_WS}+\\z")


def starts_with_space(b: Column) -> Column:
    return latin1(F.substring(b, 1, 1)).rlike(_WS)


def ends_with_space(b: Column) -> Column:
    return latin1(F.substring(b, -1, 1)).rlike(_WS)


def has_letter(b: Column) -> Column:
    return latin1(b).rlike("[A-Za-z]")


def length_allowed(b: Column, lengths: tuple[int, ...]) -> Column:
    return F.octet_length(b).isin(*lengths)


SPACES = frozenset(b"\t\n\x0b\f\r ")


def refused(token: bytes, require_letter: bool = False, forbid_leading: bool = False) -> bool:
    """Whether the white-space rules keep a token out of the vocabulary. Tokens of white space only pass them all."""
    blank = [b in SPACES for b in token]
    if all(blank):
        return False
    letter = any(65 <= b <= 90 or 97 <= b <= 122 for b in token)
    return blank[-1] or (forbid_leading and blank[0]) or (require_letter and any(blank) and not letter)


def mebibytes(n: Column) -> Column:
    return n / F.lit(float(1 << 20))
