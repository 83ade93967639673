"""The lattice of all tokens in many pieces at once: a suffix array finds them, relaxing by position keeps the right ones.

The pieces are written one after another, a separator after each, and indexed by a suffix array (sorted to the depth of
the longest token, by doubling). Every token is searched in it by bisection, which gives the range of suffixes that begin
with it, so all its occurrences. The occurrences are edges between positions; they are sorted by the place in the piece
where they end and relaxed in that order: an edge is kept if the token may follow the last token of the prefix before it
(``prefix_bpe``). All of it is done in numpy for all pieces together.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

from byteloom.llm import wordhash

_SLOTS = 1 << 20


class Lattice:
    """tokens: each token's units, numbers from 1 to top; may_follow(u, t) tells whether t can come after u.

    Pieces have at most longest units, up to 255.
    """

    def __init__(self, tokens: dict[int, np.ndarray], may_follow: Callable[[int, int], bool], top: int, longest: int):
        self.bits = int(top + 1).bit_length()
        self.per = 63 // self.bits
        tokens = {i: t for i, t in tokens.items() if len(t) <= longest}
        self.ids = np.array(list(tokens), np.int64)
        self.lens = np.array([len(t) for t in tokens.values()], np.int64)
        self.len_of = np.zeros(int(self.ids.max()) + 1, np.int64)
        self.len_of[self.ids] = self.lens
        self.blocks = -(-int(self.lens.max()) // self.per)
        flat = np.zeros((len(tokens), self.blocks * self.per), np.int64)
        for row, t in zip(flat, tokens.values()):
            row[: len(t)] = t
        self.low = self._pack(flat)
        full = (1 << self.bits) - 1
        flat[np.arange(flat.shape[1])[None, :] >= self.lens[:, None]] = full
        self.high = self._pack(flat)
        # Short tokens need fewer blocks compared.
        need = -(-self.lens // self.per)
        self.groups = [(int(b), np.flatnonzero(need == b)) for b in np.unique(need)]
        self.may_follow = may_follow
        self.slot_key = np.full(_SLOTS, -1, np.int64)
        self.slot_ok = np.zeros(_SLOTS, bool)

    def _pack(self, units: np.ndarray) -> np.ndarray:
        """Blocks of per units as one number each."""
        out = np.zeros((len(units), units.shape[1] // self.per), np.int64)
        for k in range(self.per):
            out = out << self.bits | units[:, k :: self.per]
        return out

    def _suffixes(self, key: np.ndarray) -> np.ndarray:
        """The suffix array to the depth of all blocks."""
        n, depth = len(key), self.per
        order = np.argsort(key)
        sorted_key = key[order]
        while True:
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
            if depth >= self.blocks * self.per or rank[order[-1]] == n:
                return order
            after = np.zeros(n, np.int64)
            after[:-depth] = rank[depth:]
            pair = rank << 31 | after
            order = np.argsort(pair)
            sorted_key = pair[order]
            depth *= 2

    def _bound(self, key: np.ndarray, suffixes: np.ndarray, goal: np.ndarray, after: bool) -> np.ndarray:
        """For each token's goal the number of suffixes below it, or with after those not above it."""
        lo = np.zeros(len(goal), np.int64)
        for blocks, group in self.groups:
            low, high, own = np.zeros(len(group), np.int64), np.full(len(group), len(suffixes), np.int64), goal[group]
            for _ in range(len(suffixes).bit_length()):
                mid = np.minimum((low + high) >> 1, len(suffixes) - 1)
                at = suffixes[mid]
                less = np.full(len(group), after)
                for b in range(blocks - 1, -1, -1):
                    k, g = key[at + b * self.per], own[:, b]
                    less = (k < g) | ((k == g) & less)
                less &= low < high
                low = np.where(less, mid + 1, low)
                high = np.where(less, high, np.minimum(high, mid))
            lo[group] = low
        return lo

    def _joined(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        pair = u << 24 | t
        slot = (wordhash.mix(pair.view(np.uint64)) >> np.uint64(64 - 20)).astype(np.int64)
        ok = self.slot_ok[slot]
        new = np.flatnonzero(self.slot_key[slot] != pair)
        if len(new):
            fresh, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
            found = np.array([self.may_follow(p >> 24, p & 0xFFFFFF) for p in fresh.tolist()], bool)
            at = slot[new[first]]
            self.slot_key[at], self.slot_ok[at] = fresh, found
            # Two pairs can share a slot: the last written one owns it.
            ok[new] = found[back]
        return ok

    def solve(self, units: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last token and number of tokens of the prefix that ends before each position.

        units has the pieces, a 0 after each; start has where they begin, the first at 0. A prefix that no tokens make up
        has the last token -2.
        """
        n = len(units)
        padded = np.zeros(n + (self.blocks + 1) * self.per, np.int64)
        padded[:n] = units
        key = np.zeros(len(padded) - self.per + 1, np.int64)
        for k in range(self.per):
            key = key << self.bits | padded[k : k + len(key)]
        suffixes = self._suffixes(key[:n])
        lo = self._bound(key, suffixes, self.low, False)
        count = self._bound(key, suffixes, self.high, True) - lo
        present = np.flatnonzero(count > 0)
        lo, count = lo[present], count[present]
        which = np.repeat(present, count)
        at = suffixes[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        end = at + self.lens[which]
        offset = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        level = offset[end].astype(np.uint8)
        order = np.argsort(level, kind="stable")
        at, end, token = at[order], end[order], self.ids[which][order]
        bounds = np.cumsum(np.bincount(level, minlength=1))
        last, number = np.full(n, -2, np.int64), np.zeros(n, np.int32)
        last[start] = -1
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b:
                continue
            x, y, t = at[a:b], end[a:b], token[a:b]
            u = last[x]
            ok = u == -1
            inner = np.flatnonzero(u >= 0)
            ok[inner] = self._joined(u[inner], t[inner])
            x, y = x[ok], y[ok]
            last[y] = t[ok]
            number[y] = number[x] + 1
        return last, number

    def tokens(self, last: np.ndarray, number: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the pieces that end before the positions, and how many each has."""
        n = number[end].astype(np.int64)
        out = np.zeros(int(n.sum()), np.int64)
        to, at = np.cumsum(n), end.copy()
        left = n.copy()
        live = np.flatnonzero(left > 0)
        while len(live):
            t = last[at[live]]
            to[live] -= 1
            out[to[live]] = t
            at[live] -= self.len_of[t]
            left[live] -= 1
            live = live[left[live] > 0]
        return out, n


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different pieces data[start[i] : end[i]], a place i of each, and for every piece which of them it is.

    Pieces come in order and don't overlap. They are told apart by all their bytes, not by a hash alone.
    """
    if not len(start):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[start] = edge[end] = True
    bounds = np.flatnonzero(edge)
    # What lies between pieces is encoded too, and not looked at.
    cut = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    which = cut.indices.to_numpy()[np.searchsorted(bounds, start)]
    place = np.full(len(cut.dictionary), -1, np.int64)
    place[which] = np.arange(len(which))
    used = place >= 0
    values = cut.dictionary if used.all() else cut.dictionary.filter(pa.array(used))
    return values.to_pylist(), place[used], (np.cumsum(used) - 1)[which]


class Remembered:
    """Values of pieces: rows of a flat array. When there are more than limit, they are forgotten."""

    def __init__(self, limit: int, kind: type):
        self.limit, self.kind = limit, kind
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.at, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.store, self.used, self.key_bytes = np.zeros(1024, self.kind), 0, 0

    @property
    def flat(self) -> np.ndarray:
        return self.store[: self.used]

    def rows(self, pieces: list[bytes], make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the values of pieces, all different.

        make(new) gives those of the pieces at the places new that have none yet: the places in some order, the values
        joined, and how many each has.
        """
        if len(self.slot) + len(pieces) > self.limit or max(self.used, self.key_bytes) > 32 * self.limit:
            self.forget()
        slot = np.fromiter(map(self.slot.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(slot < 0)
        if len(new):
            order, flat, n = make(new)
            slot[order] = np.arange(len(self.slot), len(self.slot) + len(order))
            self._add([pieces[i] for i in order.tolist()], flat, n)
        return self.at[slot], self.n[slot]

    def _add(self, pieces: list[bytes], flat: np.ndarray, n: np.ndarray) -> None:
        first, total = len(self.slot), len(self.slot) + len(pieces)
        if total > len(self.at):
            self.at, self.n = (np.concatenate([x[:first], np.zeros(total, np.int64)]) for x in (self.at, self.n))
        if self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.flat, np.zeros(self.used + len(flat), self.kind)])
        self.at[first:total], self.n[first:total] = self.used + np.cumsum(n) - n, n
        self.store[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.key_bytes += sum(map(len, pieces))
        self.slot.update(zip(pieces, range(first, total)))


def expand(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[at[0] : at[0] + n[0]], flat[at[1] : at[1] + n[1]] and so on, joined."""
    ends = np.cumsum(n)
    return flat[np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(at - (ends - n), n)]
