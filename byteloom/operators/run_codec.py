"""Encoding whole batches at once: the different runs of a batch are encoded, all together, and put in their places."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from byteloom import layout
from byteloom.model import Model
from byteloom.operators import blocks, segment

#: Bytes of values that are encoded together, and of the longest run that is encoded with others.
TOGETHER, LONG = 8 << 20, 256
#: Tokens up to whose number a table of all pairs tells ranks.
DENSE = 2048
_NONE = np.iinfo(np.int32).max


class RunEncoder:
    """Encodes as ``codec.encoder`` does, for models whose merges are in order and whose tokens don't reach over an edge of white space."""

    def __init__(self, model: Model, one: Callable[[bytes], list[int]], literals: bool = True):
        """one encodes a single value."""
        self.one = one
        self.base = model.config.base_size
        self.size = self.base + len(model.merges)
        first = {p: r for r, p in reversed(list(enumerate(model.merges)))}
        keys = np.array([a * self.size + b for a, b in first], np.int64)
        ranks = np.array(list(first.values()), np.int32)
        if self.size <= DENSE:
            self.table = np.full(self.size * self.size, _NONE, np.int32)
            self.table[keys] = ranks
        else:
            order = np.argsort(keys)
            self.table, self.keys, self.ranks = None, keys[order], ranks[order]
        self.special = {t.encode(): i for t, i in model.special_ids.items()} if literals else {}
        self.prefix = os.path.commonprefix(list(self.special))
        self.find = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))).finditer

    def __call__(self, column: pa.Array) -> pa.Array:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        column = column.cast(pa.large_binary()).fill_null(b"")
        data, at = blocks.values(column)
        flat, sizes = [pa.array([], pa.int32())], [np.zeros(0, np.int64)]
        for a, z in blocks.slices(at, TOGETHER):
            tokens, n = self._encoded(column.slice(a, z - a), data[at[a] : at[z]], at[a : z + 1] - at[a])
            flat.append(tokens)
            sizes.append(n)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(flat), mask=pa.array(~valid))

    def _encoded(self, column: pa.Array, data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        edges = segment.white_bounds(data, at)
        if self.special:
            some = [self.prefix] if self.prefix else list(self.special)
            held = np.zeros(len(column), bool)
            for t in some:
                held |= pc.match_substring(column, t).to_numpy(zero_copy_only=False)
            spans = [(at[i] + m.start(), at[i] + m.end()) for i in np.flatnonzero(held).tolist() for m in self.find(data[at[i] : at[i + 1]].tobytes())]
            if spans:
                begin, end = (np.array(x, np.int64) for x in zip(*spans))
                place = np.searchsorted(begin, edges, "right") - 1
                inside = (place >= 0) & (edges < end[np.maximum(place, 0)]) & (edges > begin[np.maximum(place, 0)])
                edges = np.unique(np.concatenate([edges[~inside], begin, end]))
        runs = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        tokens, sizes = self._runs(runs.dictionary)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(tokens, pa.int32()))
        which = runs.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        return lists.take(runs.indices).flatten(), np.diff(ends[np.searchsorted(edges, at)])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        if self.table is not None:
            return self.table[key]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], np.int32(_NONE))

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of runs, joined, and how many each has."""
        data, at = blocks.values(runs)
        n = np.diff(at)
        alone: dict[int, list[int]] = {}
        lengths = {len(t) for t in self.special}
        for i in np.flatnonzero(np.isin(n, list(lengths)) if lengths else np.zeros(len(n), bool)).tolist():
            if (token := self.special.get(data[at[i] : at[i + 1]].tobytes())) is not None:
                alone[i] = [token]
        for i in np.flatnonzero(n > LONG).tolist():
            if i not in alone:
                alone[i] = self.one(data[at[i] : at[i + 1]].tobytes())
        word = np.repeat(np.arange(len(n)), n)
        t = data.astype(np.int64) + layout.FIRST_BYTE
        done_words, done = [np.repeat(list(alone), [len(x) for x in alone.values()]).astype(np.int64)], [np.array([x for v in alone.values() for x in v], np.int64)]
        if alone:
            kept = np.ones(len(n), bool)
            kept[list(alone)] = False
            word, t = word[kept[word]], t[kept[word]]
        while len(t):
            rank = np.full(len(t), _NONE, np.int32)
            within = np.flatnonzero(word[:-1] == word[1:])
            rank[within] = self._rank(t[within], t[within + 1]) if self.size > self.base else _NONE
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.concatenate([starts, [len(t)]])))
            ready = least == _NONE
            if ready.any():
                done_words.append(word[ready])
                done.append(t[ready])
                word, t, rank, least = word[~ready], t[~ready], rank[~ready], least[~ready]
            # All places of a word's lowest rank: what they make has higher ranks only.
            at_ = np.flatnonzero(rank == least)
            if len(at_) > 1:
                # Of overlapping places every second one is taken.
                follows = np.concatenate([[False], at_[1:] == at_[:-1] + 1])
                i = np.arange(len(at_))
                at_ = at_[(i - np.maximum.accumulate(np.where(follows, 0, i))) % 2 == 0]
            t[at_] = self.base + rank[at_]
            kept = np.ones(len(t), bool)
            kept[at_ + 1] = False
            word, t = word[kept], t[kept]
        word, t = np.concatenate(done_words), np.concatenate(done)
        return t[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(n))
