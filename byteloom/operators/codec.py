"""Encoding bytes to ids and back.

Where no token reaches over the edge of a run of white space and merges' parts come from earlier ranks, texts are cut there,
and the different runs of an Arrow batch are encoded all at once (``operators.run_codec``). Else merges in order can be applied
to a whole text rank by rank, as replacements in Catalyst; that is done up to ``FOLD`` merges. Beyond, or with merges out of
order, texts are encoded by a heap in Arrow batches.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byteloom import layout
from byteloom.functions.bytes import latin1
from byteloom.model import Model
from byteloom.operators.blocks import slices, values
from byteloom.operators.run_codec import RunEncoder

#: Most merges that are folded into one expression.
FOLD = 64
#: Tokens that are decoded together.
DECODED = 1 << 20
#: Runs that a worker remembers.
REMEMBERED = 200_000
_RUNS = re.compile(rb"[\t-\r ]+|[^\t-\r ]+").findall


def in_order(model: Model) -> bool:
    """Whether every merge's parts exist before it and its result gets the next id."""
    base = model.config.base_size
    return all(max(p) < base + r and model.result(r) == base + r for r, p in enumerate(model.merges)) and model.tokens[layout.FIRST_BYTE : layout.FIRST_TRAILING] == [bytes([b]) for b in range(256)]


def _apart(model: Model) -> bool:
    """Whether no merge reaches over the edge of a run of white space."""
    return all(len(_RUNS(model.tokens[model.result(r)])) == 1 for r in range(len(model.merges)))


def encoder(model: Model, literals: bool = True) -> Callable[[bytes], list[int]]:
    """Encodes one value: special literals first, then the pair of the lowest rank, the leftmost of equals."""
    rank = {p: r for r, p in reversed(list(enumerate(model.merges)))}
    result = [model.result(r) for r in range(len(model.merges))]
    byte: dict[int, int] = {}
    for i, t in enumerate(model.tokens):
        if len(t) == 1 and i not in model.special_ids.values():
            byte.setdefault(t[0], i)
    special = {t.encode(): i for t, i in model.special_ids.items()} if literals else {}
    split = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + b")").split if special else None

    def merge(part: list[int]) -> list[int]:
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if part[i] >= 0 else n
            if j >= n or rank.get((part[i], part[j])) != r:
                continue
            part[i], part[j], after[i] = result[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank.get((part[i], part[after[j]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank.get((part[before[i]], part[i]))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [p for p in part if p >= 0]

    apart = _apart(model)
    known: dict[bytes, list[int]] = {}

    def encode(data: bytes) -> list[int]:
        out: list[int] = []
        for piece in split(data) if split else [data]:
            if piece in special:
                out.append(special[piece])
            elif not apart:
                out += merge([byte[b] for b in piece])
            else:
                for run in _RUNS(piece):
                    ids = known.get(run)
                    if ids is None:
                        ids = merge([byte[b] for b in run])
                        if len(known) >= REMEMBERED:
                            known.clear()
                        if len(run) <= 64:
                            known[run] = ids
                    out += ids
        return out

    return encode


def fold(content: Column, model: Model, literals: bool = True) -> Column:
    """ids of a binary column as one Catalyst expression."""
    text = latin1(content)
    if literals:
        for t, i in sorted(model.special_ids.items(), key=lambda x: -len(x[0])):
            text = F.replace(text, F.lit(t.encode().decode("latin-1")), F.lit(layout.char_of(i)))
    for r, (a, b) in enumerate(model.merges):
        text = F.replace(text, F.lit(layout.char_of(a) + layout.char_of(b)), F.lit(layout.char_of(model.result(r))))
    code = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    first, hole, at = layout._LEADING_AT, layout._HOLE, layout._HOLE_AT
    return F.transform(code, lambda c: F.when(c >= first, c - first).when(c < at, c + layout.FIRST_BYTE).otherwise(c - hole + layout.FIRST_BYTE).cast("int"))


def encode(df: DataFrame, model: Model, content: str = "content", out: str = "tokens", literals: bool = True) -> DataFrame:
    """df with the ids of its binary column; null stays null."""
    if len(model.merges) <= FOLD and in_order(model) and not _apart(model):
        return df.withColumn(out, fold(F.col(content), model, literals))
    return df.withColumn(out, heaped(F.col(content), model, literals))


def heaped(content: Column, model: Model, literals: bool = True) -> Column:
    """ids of a binary column in Arrow batches: the runs of a batch at once if the model allows it, else by the heap."""
    made: list[Callable[[pa.Array], pa.Array]] = []
    together = in_order(model) and _apart(model)

    def run(column: pa.Array) -> pa.Array:
        if not made:
            if together:
                made.append(RunEncoder(model, encoder(model, False), literals))
            else:
                one = encoder(model, literals)
                made.append(lambda column: pa.array([None if x is None else one(x) for x in column.to_pylist()], pa.list_(pa.int32())))
        return made[0](column)

    return F.arrow_udf(run, "array<int>")(content)


def decode(df: DataFrame, model: Model, tokens: str = "tokens", out: str = "content", skip_special: bool = False) -> DataFrame:
    """df with the bytes of its ids. An id outside the vocabulary is an error; null stays null."""
    return df.withColumn(out, _joined(model.tokens, sorted(model.special_ids.values()) if skip_special else [])(F.col(tokens).cast("array<int>")))


def _joined(table: list[bytes], skipped: list[int]) -> Callable:
    # What is skipped has no bytes.
    kept = [*(b"" if i in set(skipped) else t for i, t in enumerate(table)), b""]  # the last stands for null

    def join(ids: pa.Array) -> pa.Array:
        lists = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        valid = lists.is_valid()
        flat = lists.flatten()
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        given = flat.drop_null().to_numpy()
        if len(given) and (given.min() < 0 or given.max() >= len(table)):
            raise ValueError("a token id is outside the vocabulary")
        numbers = pc.fill_null(flat, len(table)).to_numpy()
        vocabulary, at = pa.array(kept, pa.binary()), np.concatenate([[0], np.cumsum(size)])
        parts = []
        for a, z in slices(at, DECODED):
            # The tokens in their order are the values' bytes one after another.
            data, ends = values(vocabulary.take(pa.array(numbers[at[a] : at[z]])))
            offsets = pa.py_buffer(np.ascontiguousarray(ends[at[a : z + 1] - at[a]]))
            parts.append(pa.Array.from_buffers(pa.large_binary(), z - a, [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]))
        joined = pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())
        return pc.if_else(valid, joined, pa.scalar(None, pa.large_binary())).cast(pa.binary())

    return F.arrow_udf(join, "binary")


def sample_text(content: Column, first_bytes: int | None = None) -> Column:
    """The first bytes as text, in UTF-8 if they are that, else byte by byte in Latin-1; as the bytes of that text in UTF-8."""
    part = F.substring(content, 1, F.lit(first_bytes)) if first_bytes else content
    return F.when(F.is_valid_utf8(part.cast("string")), part).otherwise(F.encode(F.decode(part, "ISO-8859-1"), "UTF-8"))


def token_counts(df: DataFrame, model: Model, content: str = "content", first_bytes: int | None = None, out: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of a binary column's first bytes (``sample_text``)."""
    counted = encode(df.withColumn("_bytes", sample_text(F.col(content), first_bytes)), model, "_bytes", "_tokens")
    return counted.withColumn(out, F.size("_tokens")).drop("_bytes", "_tokens")


def compared(df: DataFrame, models: dict[str, Model], content: str = "content", first_bytes: int | None = None) -> DataFrame:
    """df with a column for each model: the tokens that it makes of the first bytes."""
    for name, model in models.items():
        df = token_counts(df, model, content, first_bytes, name)
    return df
