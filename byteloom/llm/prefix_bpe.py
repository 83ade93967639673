"""Byte-pair encoding by dynamic programming over prefixes.

In a vocabulary whose every token encodes to itself, the encoding of a prefix ends in the one token t for which the
encoding of the prefix without t ends in a token u such that u and t stay two tokens when their text is encoded. So the
last token of every prefix, and with it the number of tokens of every prefix, follows from shorter prefixes.
"""

from __future__ import annotations

from collections.abc import Callable


def merged(parts: list, rank: dict) -> list:
    """The parts after all merges: the pair of the least rank first, the leftmost of equals."""
    parts = list(parts)
    while len(parts) > 1:
        ranks = [rank.get(a + b) for a, b in zip(parts, parts[1:])]
        best = min((r for r in ranks if r is not None), default=None)
        if best is None:
            break
        i = ranks.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Joins:
    """Which tokens may follow each other; remembered up to a number of pairs. encode gives the tokens of a text."""

    def __init__(self, tokens: list, encode: Callable[[object], list[int]], limit: int = 1_000_000):
        self.tokens, self.encode, self.limit, self.known = tokens, encode, limit, {}

    def __call__(self, u: int, t: int) -> bool:
        pair = u << 24 | t
        out = self.known.get(pair)
        if out is None:
            out = self.encode(self.tokens[u] + self.tokens[t]) == [u, t]
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[pair] = out
        return out


class PrefixCounter:
    """Number of tokens of every prefix of a piece of bytes, under ranks of a byte-level vocabulary."""

    def __init__(self, rank: dict[bytes, int], encode: Callable[[bytes], list[int]]):
        self.rank, self.longest = rank, max(map(len, rank))
        tokens: list[bytes] = [b""] * (max(rank.values()) + 1)
        for t, r in rank.items():
            tokens[r] = t
        self.joins = Joins(tokens, encode)

    def __call__(self, piece: bytes) -> list[int]:
        n = len(piece)
        last, count, find, joins, known = [0] * (n + 1), [0] * (n + 1), self.rank.get, self.joins, self.joins.known
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                t = find(piece[j:i])
                if t is not None:
                    if j:
                        ok = known.get(last[j] << 24 | t)
                        if ok is None:
                            ok = joins(last[j], t)
                        if not ok:
                            continue
                    last[i], count[i] = t, count[j] + 1
                    break
            else:
                raise ValueError(f"no encoding of {piece[:i]!r}: the vocabulary lacks a byte")
        return count
