"""Exact token counts of every prefix.

A text is split into pieces by the vocabulary's pattern, and within a piece the count of every prefix follows from
shorter prefixes by dynamic programming (``prefix_bpe``). ``prefix_table`` stores, for a text, the count of tokens of
each of its prefixes, that is, how many tokens the encoding of its first i characters has, for every i. Cutting a text
to a budget or asking whether it fits then takes a look-up and no encoding. Counts of prefixes aren't monotone: another
character can turn two tokens into one.

A stored table is bytes: the width w (1, 2 or 4), then the differences of successive counts as signed little-endian
numbers of w bytes.

Defined cases. A null text has a null table and null counts; an empty text has an empty table and no tokens. Strings of
special tokens are ordinary text. Merges of one rank are made from left to right. Repeated rows give repeated results, a null
id is kept, an empty table has no rows. Further columns are ignored, whatever their names. Any Unicode text can be encoded,
and is to its end, however long. Pieces are told apart by all their bytes, so no text can take another one's counts.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom.llm import common, gpt_split, lattice, prefix_bpe

#: Folder of the public vocabulary files; BYTELOOM_TOKENIZERS names another.
TOKENIZERS = os.environ.get("BYTELOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUDGETS = (512, 2048, 8192)
#: Pieces whose tables, and whose sizes, a worker remembers; bytes of text that it takes at once.
REMEMBERED, REMEMBERED_SIZES = 250_000, 250_000
TAKEN, TAKEN_SIZES = 1 << 20, 1 << 19
#: Longest piece that the lattice takes. Longer ones are rare, and long tokens would only deepen its suffix array.
LATTICE_PIECE = 28


class Pieces:
    """The pieces of a batch of texts."""

    def __init__(self, column: pa.Array):
        data, rows = common.flat(column)
        self.data = data
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each character begins
        row_end = np.searchsorted(byte, rows[1])
        start, self.runs = gpt_split.split(points, row_end)
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(points)))
        real = np.ones(len(points), bool)
        real[row_end] = False
        keep = real[at]
        self.at, self.size = at[keep], size[keep]  # in characters
        self.start, self.end = byte[self.at], byte[self.at + self.size]  # in bytes
        self.rows = np.stack([np.searchsorted(byte, rows[0]), row_end])
        self.first = np.append(np.searchsorted(self.at, self.rows[0]), len(self.at))
        self.values, self.example, self.which = lattice.distinct(data, self.start, self.end)
        self.byte = byte

    def bytes(self, piece: int) -> bytes:
        return self.data[self.start[piece] : self.end[piece]].tobytes()


class Counter:
    """Counts of a vocabulary file of ranks."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # The library is told of no special tokens; its own splitting isn't used.
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=rank, special_tokens={})._encode_single_piece
        self.prefixes = prefix_bpe.PrefixCounter(rank, self.encode)
        self.rank = rank
        self.known = lattice.Remembered(REMEMBERED, np.int32)
        self.sizes = lattice.Remembered(REMEMBERED_SIZES, np.int32)

    @cached_property
    def lattice(self) -> lattice.Lattice:
        tokens = {r: np.frombuffer(t, np.uint8).astype(np.int64) + 1 for t, r in self.rank.items()}
        return lattice.Lattice(tokens, self.prefixes.joins, 256, LATTICE_PIECE)

    def _tables(self, pieces: Pieces, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts after each character of the new pieces, joined, and the characters of each."""
        example = pieces.example[new]
        n = pieces.end[example] - pieces.start[example]
        short = np.flatnonzero(n <= LATTICE_PIECE)
        tables: list = [None] * len(new)
        if len(short):
            size = n[short] + 1
            start = np.cumsum(size) - size
            units = np.zeros(int(size.sum()), np.int64)
            inside = np.ones(len(units), bool)
            inside[start + size - 1] = False
            units[inside] = lattice.expand(pieces.data, pieces.start[example[short]], n[short]).astype(np.int64) + 1
            last, number = self.lattice.solve(units, start)
            # The count after a character stands where the next one begins.
            data = units - 1
            after = np.concatenate([inside[:-1], [False]])
            after = np.concatenate([[False], after[:-1]])
            after &= ((data & 0xC0) != 0x80) | (data < 0)
            flat = number[after]
            chars = np.diff(np.append(np.searchsorted(np.flatnonzero(after), start), len(flat)))
            if len(short) == len(new):
                return self._contractions(pieces, example, flat, chars)
            for i, t in zip(short.tolist(), np.split(flat, np.cumsum(chars)[:-1])):
                tables[i] = t
        for i in np.flatnonzero(n > LATTICE_PIECE).tolist():
            piece = pieces.bytes(example[i])
            count = np.array(self.prefixes(piece)[1:], np.int32)
            tables[i] = count[np.append((np.frombuffer(piece, np.uint8)[1:] & 0xC0) != 0x80, True)]
        return self._contractions(pieces, example, np.concatenate(tables), np.array([len(t) for t in tables]))

    def _contractions(self, pieces: Pieces, example: np.ndarray, flat: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A prefix "'r" of "'re" is split in two."""
        at = np.cumsum(chars) - chars
        for i in np.flatnonzero((chars == 3) & (pieces.data[pieces.start[example]] == 39)).tolist():
            piece = pieces.bytes(example[i])
            if piece in (b"'re", b"'ve", b"'ll"):
                flat[at[i] + 1] = flat[at[i]] + len(self.encode(piece[1:2]))
        return flat, chars

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        pieces = Pieces(column)
        at, _ = self.sizes.rows(pieces.values, lambda new: (new, np.array([len(self.encode(pieces.values[i])) for i in new.tolist()]), np.ones(len(new), np.int64)))
        total = np.concatenate([[0], np.cumsum(self.sizes.flat[at][pieces.which], dtype=np.int64)])
        return np.diff(total[pieces.first])

    def prefix_counts(self, column: pa.Array) -> list[np.ndarray]:
        """For each text the tokens of its first i characters, for i from 1 to its length."""
        pieces = Pieces(column)
        at, n = self.known.rows(pieces.values, lambda new: (new, *self._tables(pieces, new)))
        ends = self.known.flat[at + n - 1][pieces.which].astype(np.int64)
        before = np.cumsum(ends) - ends
        base = np.append(before, 0)[pieces.first[:-1]]
        before -= np.repeat(base, np.diff(pieces.first))
        out = lattice.expand(self.known.flat, at[pieces.which], n[pieces.which]) + np.repeat(before, n[pieces.which])
        # By characters with the NULs between texts taken out.
        shift = pieces.rows[0] - np.arange(len(pieces.rows[0]))
        for a, b in pieces.runs:
            row = int(np.searchsorted(pieces.rows[1], a))
            run = len(self.encode(pieces.data[pieces.byte[a] : pieces.byte[b]].tobytes()))
            out[b - 1 - row] = (out[a - 1 - row] if a > pieces.rows[0][row] else 0) + run
        return np.split(out, shift[1:])


@lru_cache(2)
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


def pack(counts: np.ndarray) -> bytes:
    """The stored form of prefix counts."""
    d = np.diff(counts, prepend=0)
    for width, kind in ((1, "i1"), (2, "<i2"), (4, "<i4")):
        if not len(d) or (np.abs(d) < 1 << (8 * width - 1)).all():
            return bytes([width]) + d.astype(kind).tobytes()
    raise ValueError("more tokens than 32 bits hold")


def unpack(table: bytes) -> np.ndarray:
    """The counts of a stored table: item i - 1 is the count of the first i characters."""
    return np.cumsum(np.frombuffer(table, f"<i{table[0]}", offset=1), dtype=np.int64)


def truncation(counts: np.ndarray, budget: int) -> int:
    """The most characters of which no more than budget tokens come."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, ...] = BUDGETS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, prefix_table, and for each budget b chars_b: the characters that fit into b tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        names = ["doc_id", "n_tokens", "prefix_table", *(f"chars_{b}" for b in budgets)]
        for batch in common.pieces(batches, 1, TAKEN):
            out: list[list] = [[] for _ in names[1:]]
            for null, counts in zip(batch.column(1).is_null().to_pylist(), c.prefix_counts(batch.column(1))):
                if null:
                    row = [None] * len(out)
                else:
                    row = [int(counts[-1]) if len(counts) else 0, pack(counts), *(truncation(counts, b) for b in budgets)]
                for o, x in zip(out, row):
                    o.append(x)
            types = [pa.int64(), pa.binary(), *(pa.int64() for _ in budgets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, t) for o, t in zip(out, types))], names)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, prefix_table binary" + "".join(f", chars_{b} long" for b in budgets)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, k (key of the row), n_tokens; null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in common.pieces(batches, 2, TAKEN_SIZES):
            n = pa.array(c.counts(b.column(2)), pa.int64(), mask=b.column(2).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "k", "n_tokens"])

    rows = docs.select(docs[id_col].alias("doc_id"), common.row_key(docs, id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, k long, n_tokens long")
