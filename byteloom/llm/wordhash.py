"""Hashes of the words of many texts at once, and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(0x5EED)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, _C = 0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that end a word: ASCII white space and NUL.
SPACE = np.zeros(256, bool)
SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
#: As SPACE, and all ASCII characters but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 23:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64 bits in which each input bit moves all output bits."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Runs:
    """Hashes of any runs of a sequence of 64-bit values, by their prefix sums."""

    def __init__(self, values: np.ndarray, base: int = _C):
        up, self.down = powers(base, max(1, len(values)))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def words(data: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of the bytes; data ends in a byte that ends a word."""
    inside = ~ends_word[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    return start, end, Runs(BYTE[data], BASE)(start, end)


def by_row(start: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The place, in sorted starts of words, of the first word of each row, and their number at the end."""
    return np.concatenate([np.searchsorted(start, rows[0]), [len(start)]])
