"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is cut into units that no merge crosses: before a space that follows another character, and around
characters that the vocabulary lacks. The distinct units that aren't remembered from earlier batches are joined and indexed
by a suffix array; every piece of the vocabulary is searched in it by bisection; the edges found are sorted by position and
relaxed (``lattice``). The models read here are byte-pair models, whose encoding isn't the path of the greatest sum of
scores: an edge is kept if its piece may follow the last piece of the prefix before it, which gives exactly the encoding by
merges. Units that the lattice doesn't take - longer than its limit, or with several leading spaces, for which merges of
equal score make ties - are merged one by one with a heap. Characters without a piece become byte pieces.

Defined cases. A model that isn't a byte-pair model is an error. A null text has null ids; an empty text has none; an
empty table has no rows. Pieces of equal score are merged from left to right. Units are told apart by all their bytes. Control pieces in a text are ordinary text. "▁" in a text
is encoded as a space, so it is decoded as one. Decoding a null gives null; ids outside the vocabulary are an error; bytes
that are no UTF-8 decode to U+FFFD. Repeated rows give repeated results. Null ids of rows are kept. Further columns are
ignored, whatever their names. Texts are encoded to
their ends, however long.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom.llm import common, lattice, prefix_bpe
from byteloom.llm.token_counts import TOKENIZERS

MODEL = os.path.join(TOKENIZERS, "piece_bpe_32k.model")
SPACE = "▁"
#: Longest unit that the lattice takes.
LATTICE_PIECE = 120
#: Units that a worker remembers.
REMEMBERED = 250_000


def merged(text: str, score: dict[str, float]) -> list[str]:
    """Pieces of a unit after all merges, the best score first, the leftmost of equals."""
    part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(part):
            s = score.get(part[i] + part[j])
            if s is not None:
                heapq.heappush(heap, (-s, i, part[i] + part[j]))

    for i in range(len(part) - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if part[i] else len(part)
        if j >= len(part) or part[i] + part[j] != both:
            continue
        part[i], part[j], after[i] = both, "", after[j]
        if after[j] < len(part):
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in part if p]


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of the fields of a protocol buffer's message."""

    def number() -> int:
        nonlocal at
        out, shift = 0, 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    at = 0
    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}[tag & 7] if tag & 7 != 2 else number()
            yield tag >> 3, data[at : at + size]
            at += size


def is_bpe(model: bytes) -> bool:
    """Whether a serialized model says that it is a byte-pair model: field 3 of its trainer's settings, field 2, is 2."""
    return any(2 == kind for n, spec in _fields(model) if n == 2 for field, kind in _fields(spec) if field == 3)


class Codec:
    """A byte-pair model with byte fallback and no normalisation but that of spaces."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if not is_bpe(sp.serialized_model_proto()):
            raise ValueError("the model isn't a byte-pair model")
        n = sp.get_piece_size()
        if sp.normalize("  a ﬁ") != f"{SPACE}{SPACE}{SPACE}a{SPACE}ﬁ":
            raise ValueError("the model's normalisation isn't supported")
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("the model has pieces that reach over a space")
        self.id = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte = np.array([i for i in range(n) if sp.is_byte(i)], np.int64)
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces")
        self.joins = prefix_bpe.Joins(self.pieces, lambda s: [self.id[p] for p in merged(s, self.score)])
        # Characters that have a piece, numbered from 1; they are the units of the lattice.
        chars = sorted({c for p in self.id for c in p} & set(self.id))
        self.number = np.zeros(0x110000, np.int16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.known = lattice.Remembered(REMEMBERED, np.int32)
        # What a piece decodes to.
        decoded = [b""] * n
        for i in plain:
            decoded[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            decoded[i] = bytes([b])
        for i in range(n):
            if sp.is_unknown(i):
                decoded[i] = " ⁇ ".encode()
        self.decoded_n = np.array([len(d) for d in decoded], np.int64)
        self.decoded_at = np.cumsum(self.decoded_n) - self.decoded_n
        self.decoded = np.frombuffer(b"".join(decoded), np.uint8)

    @cached_property
    def lattice(self) -> lattice.Lattice:
        # Runs of spaces have equal scores and stay out: units with several leading spaces are merged one by one.
        tokens = {i: self.number[[ord(c) for c in p]].astype(np.int64) for p, i in self.id.items() if not p.startswith(SPACE * 2)}
        return lattice.Lattice({i: t for i, t in tokens.items() if t.all()}, self.joins, int(self.number.max()), LATTICE_PIECE)

    def _scalar(self, unit: str) -> list[int]:
        out: list[int] = []
        for p in merged(unit, self.score):
            i = self.id.get(p)
            out += [i] if i is not None else self.byte[list(p.encode())].tolist()
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and how many each has."""
        text = column.cast(pa.large_string()).fill_null("")
        space, empty = pa.scalar(SPACE, pa.large_string()), pa.scalar("", pa.large_string())
        text = pc.if_else(pc.equal(text, empty), text, pc.binary_join_element_wise(space, pc.replace_substring(text, " ", SPACE), empty))
        data, rows = common.flat(text)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        row_start, row_end = np.searchsorted(byte, rows[0]), np.searchsorted(byte, rows[1])
        number = self.number[points]
        lacking = number == 0
        blank = points == ord(SPACE)
        start = lacking.copy()
        start[1:] |= lacking[:-1] | (blank[1:] & ~blank[:-1])
        start[row_start] = True
        start[row_end] = True
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(points)))
        real = np.ones(len(points), bool)
        real[row_end] = False
        at, size = at[real[at]], size[real[at]]
        first = np.append(np.searchsorted(at, row_start), len(at))
        a, b = byte[at], byte[at + size]
        found, example, which = lattice.distinct(data, a, b)

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            one = example[new]
            many = blank[np.minimum(at[one] + 1, len(points) - 1)] & (size[one] > 1)
            easy = (size[one] <= LATTICE_PIECE) & ~many & ~lacking[at[one]]
            units = one[easy]
            values, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if len(units):
                n = size[units] + 1
                begin = np.cumsum(n) - n
                codes = np.zeros(int(n.sum()), np.int64)
                inside = np.ones(len(codes), bool)
                inside[begin + n - 1] = False
                codes[inside] = lattice.expand(number, at[units], size[units])
                last, count = self.lattice.solve(codes, begin)
                ids, k = self.lattice.tokens(last, count, begin + n - 1)
                values.append(ids)
                counts.append(k)
            for i in one[~easy].tolist():
                ids = self._scalar(data[a[i] : b[i]].tobytes().decode())
                values.append(np.array(ids, np.int64))
                counts.append(np.array([len(ids)]))
            return np.concatenate([new[easy], new[~easy]]), np.concatenate(values), np.concatenate(counts).astype(np.int64)

        where, n = self.known.rows(found, make)
        ids = lattice.expand(self.known.flat, where[which], n[which])
        total = np.concatenate([[0], np.cumsum(n[which])])
        return ids, np.diff(total[first])

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, joined, and how many each has, for joined ids and how many each text has."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id is outside the vocabulary")
        out = lattice.expand(self.decoded, self.decoded_at[ids], self.decoded_n[ids])
        total = np.concatenate([[0], np.cumsum(self.decoded_n[ids])])
        ends = total[np.cumsum(n)] if len(n) else np.zeros(0, np.int64)
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        # The space that encoding puts before a text is taken away.
        drop = begin[(ends > begin)]
        drop = drop[out[drop] == 32]
        keep = np.ones(len(out), bool)
        keep[drop] = False
        size = ends - begin
        size[(size > 0)] -= (out[begin[size > 0]] == 32)
        return out[keep], size


@lru_cache(2)
def codec(model: str) -> Codec:
    return Codec(model)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, exact: the ids of each text, and whether decoding them gives the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in common.pieces(batches, 1, 1 << 20):
            ids, n = c.encode(b.column(1))
            data, size = c.decode(ids, n)
            source, rows = common.flat(b.column(1))
            ends = np.cumsum(size)
            exact = (size == rows[1] - rows[0]).tolist()
            for i, ok in enumerate(exact):
                exact[i] = ok and bool((data[ends[i] - size[i] : ends[i]] == source[rows[0][i] : rows[1][i]]).all())
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32(), mask=np.append(null, False))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(n, pa.int64(), mask=null), pa.array(exact, pa.bool_(), mask=null)], ["doc_id", "ids", "n_tokens", "exact"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, n_tokens long, exact boolean"
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """doc_id, text for rows of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            column = b.column(1)
            data, size = c.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            ends, raw = np.cumsum(size).tolist(), data.tobytes()
            texts = [None if null else raw[e - s : e].decode(errors="replace") for e, s, null in zip(ends, size.tolist(), column.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[id_col].alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string")
