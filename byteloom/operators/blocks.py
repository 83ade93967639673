"""Words packed into blocks of codes for the merge loop: each round a block is rewritten once, and tells how its pairs changed.

A code is a token's place among the tokens that occur: 0 parts the words, then come the bytes in order, then the merges.
Codes sort as ids do and are as narrow as the vocabulary lets them be, most often one byte. A table of blocks has a row a
block, and rows (pair, n) of changes of pair counts; those of a pair -1 - c tell how often the merge to code c was applied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of words in a block; a longer word is one by itself.
BLOCK = 4 << 20
#: Merges up to which each is looked for by itself.
FEW = 6
SCHEMA = "tokens binary, weights binary, pair long, n long"


def values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where its values begin and the last one ends."""
    column = column.cast(pa.large_binary()).drop_null()
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer((column.buffers()[2] if len(column) else None) or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of values that begin at these places: of so many bytes, or of one value."""
    a = 0
    while a < len(at) - 1:
        z = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, z
        a = z


def totals(rows: DataFrame) -> tuple[int, int, np.ndarray]:
    """The number of words (word binary, ...), their bytes, and which bytes occur in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, chars, seen = 0, 0, np.zeros(256, bool)
        for b in batches:
            data, at = values(b.column(0))
            n, chars = n + len(at) - 1, chars + len(data)
            for i in range(0, len(data), BLOCK):
                seen |= np.bincount(data[i : i + BLOCK], minlength=256) > 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([chars]), pa.array([seen.tobytes()], pa.binary())], ["n", "chars", "seen"])

    found = rows.select("word").mapInArrow(run, "n long, chars long, seen binary").collect()
    seen = np.zeros(256, bool)
    for r in found:
        seen |= np.frombuffer(bytes(r.seen), bool)
    return sum(r.n for r in found), sum(r.chars for r in found), np.flatnonzero(seen)


class Layout:
    """Codes of bytes that occur and of so many merges."""

    def __init__(self, alphabet: np.ndarray, merges: int):
        self.alphabet = alphabet
        self.bytes = len(alphabet) + 1
        self.size = self.bytes + merges
        self.dtype = np.uint8 if self.size <= 1 << 8 else np.uint16 if self.size <= 1 << 16 else np.uint32


def _rows(blocks: list[tuple[np.ndarray, np.ndarray | None]], pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    k = len(blocks)
    tokens = pa.array([t.tobytes() for t, _ in blocks] + [None] * len(pairs), pa.binary())
    weights = pa.array([None if w is None else w.tobytes() for _, w in blocks] + [None] * len(pairs), pa.binary())
    mask = np.arange(k + len(pairs)) < k
    pair = pa.array(np.concatenate([np.zeros(k, np.int64), pairs.astype(np.int64)]), mask=mask)
    return pa.RecordBatch.from_arrays([tokens, weights, pair, pa.array(np.concatenate([np.zeros(k, np.int64), n.astype(np.int64)]), mask=mask)], ["tokens", "weights", "pair", "n"])


def packed(rows: DataFrame, layout: Layout, weighted: bool = True) -> DataFrame:
    """Blocks of words (word binary, weight long) of two bytes or more, and the counts of their pairs. Without weights each counts once."""
    code = np.zeros(256, layout.dtype)
    code[layout.alphabet] = np.arange(1, layout.bytes)
    k, none = layout.bytes, np.zeros(0, np.int64)

    def cut(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        data, at = values(b.column(0))
        weight = b.column(1).to_numpy() if weighted else None
        lengths = np.diff(at)
        for a, z in slices(at, BLOCK):
            n, long_ = lengths[a:z], lengths[a:z] > 1
            part = data[at[a] : at[z]]
            if not long_.all():
                part, n = part[np.repeat(long_, n)], n[long_]
            if len(n):
                yield part, n, None if weight is None else weight[a:z][long_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(k * k, np.int64)

        def block(parts: list[tuple]) -> pa.RecordBatch:
            data, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            inside = np.ones(len(data) + len(n) + 1, bool)
            inside[0] = inside[np.cumsum(n + 1)] = False
            t = np.zeros(len(inside), layout.dtype)
            t[inside] = code[data]
            key = t[:-1].astype(np.int64) * k + t[1:]
            if weighted:
                w = np.concatenate([p[2] for p in parts])
                # Sums stay exact below 2 ** 53.
                counts[:] += np.bincount(key, np.repeat(w, n + 1), k * k).astype(np.int64)
            else:
                w = None
                counts[:] += np.bincount(key, minlength=k * k)
            return _rows([(t, w)], none, none)

        held: list[tuple] = []
        size = 0
        for b in batches:
            for part in cut(b):
                if held and size + len(part[0]) > BLOCK:
                    yield block(held)
                    held, size = [], 0
                held.append(part)
                size += len(part[0])
        if held:
            yield block(held)
        table = counts.reshape(k, k)
        table[0], table[:, 0] = 0, 0
        a, b = np.nonzero(table)
        if len(a):
            yield _rows([], a * layout.size + b, table[a, b])

    return rows.select("word", "weight").mapInArrow(run, SCHEMA)


def rewritten(t: np.ndarray, w: np.ndarray | None, merges: list[tuple[int, int, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of a block after merges (left, right, code) that share no place, and the changes (pairs, n) that they make."""
    merges = sorted(merges)
    if len(merges) <= FEW:
        found = [np.flatnonzero((t[:-1] == a) & (t[1:] == b)) for a, b, _ in merges]
        at = np.concatenate(found)
        code = np.repeat(np.array([c for *_, c in merges], np.int64), [len(f) for f in found])
        order = np.argsort(at, kind="stable")
        at, code = at[order], code[order]
    else:
        first, second = np.zeros(size, bool), np.zeros(size, bool)
        first[[m[0] for m in merges]] = second[[m[1] for m in merges]] = True
        at = np.flatnonzero(first[t[:-1]] & second[t[1:]])
        key, keys = t[at].astype(np.int64) * size + t[at + 1], np.array([a * size + b for a, b, _ in merges], np.int64)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[place] == key
        at, code = at[hit], np.array([c for *_, c in merges], np.int64)[place[hit]]
    if len(at) > 1:
        # Only pairs of equal tokens overlap: of a run of such places every second one is taken.
        follows = np.concatenate([[False], at[1:] == at[:-1] + 1])
        i = np.arange(len(at))
        taken = (i - np.maximum.accumulate(np.where(follows, 0, i))) % 2 == 0
        at, code = at[taken], code[taken]
    if not len(at):
        return t, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def changes(t: np.ndarray, places: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(places), bool)
        new[1:] = places[1:] != places[:-1]
        places = places[new]
        places = places[(t[places] != 0) & (t[places + 1] != 0)]
        n = np.full(len(places), sign, np.int64) if w is None else sign * w[np.searchsorted(ends(t), places, "right") - 1]
        return t[places].astype(np.int64) * size + t[places + 1], n

    def ends(t: np.ndarray) -> np.ndarray:
        return np.flatnonzero(t == 0)

    # A taken place is never the first of the block, which parts words, nor its right one the last.
    went = changes(t, np.sort(np.concatenate([at - 1, at, at + 1])), -1)
    applied = (-1 - code, np.ones(len(at), np.int64) if w is None else w[np.searchsorted(ends(t), at, "right") - 1])
    out = t.copy()
    out[at] = code
    kept = np.ones(len(t), bool)
    kept[at + 1] = False
    out = out[kept]
    at = at - np.arange(len(at))
    came = changes(out, np.sort(np.concatenate([at - 1, at])), 1)
    return out, np.concatenate([went[0], came[0], applied[0]]), np.concatenate([went[1], came[1], applied[1]])


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(pairs, return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, at, n)
    return keys, out


def merged(blocks: DataFrame, merges: list[tuple[int, int, int]], layout: Layout) -> DataFrame:
    """The blocks after a round of merges, and the changes of the pairs' counts."""
    dtype, size = layout.dtype, layout.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for tokens, weights in zip(b.column(0), b.column(1)):
                t = np.frombuffer(tokens.as_buffer(), dtype)
                w = np.frombuffer(weights.as_buffer(), np.int64) if weights.is_valid else None
                t, p, m = rewritten(t, w, merges, size)
                pairs, n = _summed(np.concatenate([pairs, p]), np.concatenate([n, m]))
                yield _rows([(t, w)], np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(pairs):
            yield _rows([], pairs, n)

    return blocks.where(F.col("tokens").isNotNull()).select("tokens", "weights").mapInArrow(run, SCHEMA)


def changes(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose counts the blocks tell, and their sums."""
    found = blocks.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return found.column(0).to_numpy(), found.column(1).to_numpy()
