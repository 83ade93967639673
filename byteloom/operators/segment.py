"""Cutting sequences at delimiter runs. Runs are segments too, so the segments of a sequence make it up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from byteloom.config import Segmentation
from byteloom.functions.bytes import from_latin1, latin1
from byteloom.functions.digest import first_five
from byteloom.operators.blocks import slices
from byteloom.operators.blocks import values as joined

#: Marks cuts in Latin-1 text, which can't hold it.
_CUT = "\ue000"
#: White space of Unicode as UTF-8 bytes seen as Latin-1; bytes that are no UTF-8 are no white space.
_UNICODE = (
    r"(?:[\u0009-\u000D ]|\u00C2[\u0085\u00A0]|\u00E1\u009A\u0080|\u00E2\u0080[\u0080-\u008A\u00A8\u00A9\u00AF]"
    r"|\u00E2\u0081\u009F|\u00E3\u0080\u0080)"
)
RUNS = {"ascii": r"[\u0009-\u000D ]++", "null": r"\u0000++", "unicode": _UNICODE + "++"}


def runs(content: Column, mode: str) -> Column:
    """The runs of a binary value, as Latin-1 strings in order."""
    if mode == "none":
        return F.when(F.octet_length(content) > 0, F.array(latin1(content))).otherwise(F.array().cast("array<string>"))
    marked = F.regexp_replace(latin1(content), RUNS[mode], f"{_CUT}$0{_CUT}")
    return F.filter(F.split(marked, _CUT, -1), lambda x: x != "")


def is_delimiter(run: Column, mode: str) -> Column:
    return F.lit(False) if mode == "none" else run.rlike(f"\\A{RUNS[mode]}\\z")


def draw(seed: int, sequence: Column, position: Column) -> Column:
    """A number in [0, 1) that depends on the seed, the sequence and the place, and on no partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), sequence, position))
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("double") / float(1 << 40)


def segments(df: DataFrame, config: Segmentation, content: str = "content", sequence: str | None = None) -> DataFrame:
    """seq, pos, seg, is_delim: the segments of every sequence. sequence names its id; without, equal sequences draw alike."""
    seq = F.col(sequence) if sequence else F.xxhash64(content)
    mode = config.mode if config.enabled else "none"
    rows = df.select(seq.alias("seq"), F.posexplode(runs(F.col(content), mode)).alias("pos", "run"))
    if mode == "none" or config.probability >= 1:
        return rows.select("seq", "pos", from_latin1(F.col("run")).alias("seg"), is_delimiter(F.col("run"), mode).alias("is_delim"))
    # Gluing needs one sequence's runs in order: they are numbered groups of a running sum.
    rows = df.select(F.monotonically_increasing_id().alias("row"), seq.alias("seq"), runs(F.col(content), mode).alias("runs"))
    rows = rows.select("row", "seq", F.size("runs").alias("n"), F.posexplode("runs").alias("pos", "run"))
    rows = rows.withColumn("delim", is_delimiter(F.col("run"), mode)).withColumn("cut", draw(config.seed, F.col("seq"), F.col("pos")) < config.probability)
    by = Window.partitionBy("row").orderBy("pos")
    if mode == "null":
        # Each boundary draws for itself.
        begins = F.when(F.col("pos") == 0, True).otherwise(F.col("cut"))
    else:
        # A run between two words draws once for both its boundaries; at the ends of a sequence it always stands alone.
        alone = F.col("delim") & ((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1) | F.col("cut"))
        rows = rows.withColumn("alone", alone)
        begins = F.coalesce(F.col("alone") | F.lag("alone").over(by), F.lit(True))
    rows = rows.withColumn("part", F.sum(begins.cast("int")).over(by))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "run"))), lambda x: x["run"]), "")
    out = rows.groupBy("row", "seq", "part").agg(F.min("pos").alias("pos"), joined.alias("text"), F.every("delim").alias("is_delim"))
    return out.select("seq", "pos", from_latin1(F.col("text")).alias("seg"), "is_delim")


def _white(data: np.ndarray, mode: str) -> np.ndarray:
    """Which bytes belong to delimiters."""
    if mode == "null":
        return data == 0
    out = (data == 32) | ((data >= 9) & (data <= 13))
    if mode == "unicode" and len(data) > 1:
        # White space of two and three bytes, as in _UNICODE.
        x = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = x[:-2], x[1:-1], x[2:]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        three |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three |= ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        for hit, n in ((two, 2), (three, 3)):
            at = np.flatnonzero(hit)
            for k in range(n):
                out[at[at + k < len(out)] + k] = True
    return out


def _bounds(data: np.ndarray, offsets: np.ndarray, mode: str) -> np.ndarray:
    """Where the runs of joined values begin, and the end of the last; offsets: where the values begin and the last ends."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if mode != "none" and len(data):
        # A byte that no white space has parts the values, so that two of them make none together.
        n = len(offsets) - 1
        inside = np.ones(len(data) + n, bool)
        inside[offsets[1:] + np.arange(n)] = False
        apart = np.full(len(inside), 0xFF, np.uint8)
        apart[inside] = data
        white = _white(apart, mode)[inside]
        edge[1:-1] |= white[1:] != white[:-1]
    return np.flatnonzero(edge).astype(np.int64)


def white_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the runs of ASCII white space and of other bytes begin, and the end of the last."""
    return _bounds(data, offsets, "ascii")


def _draws(seed: int, sequences: list[str | None], value: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``draw`` of the places of values."""
    prefix = [f"{seed}:".encode() if s is None else f"{seed}:{s}:".encode() for s in sequences]
    digits = [b"%d" % i for i in range(int(place.max()) + 1)] if len(place) else []
    return first_five(prefix, digits, value, place) / float(1 << 40)


def bounds(data: np.ndarray, offsets: np.ndarray, config: Segmentation, sequences: list[str | None] | None = None) -> np.ndarray:
    """Where the segments of joined values begin, and the end of the last, as ``segments`` cuts them; sequences: the values' ids as text."""
    mode = config.mode if config.enabled else "none"
    at = _bounds(data, offsets, mode)
    if mode == "none" or config.probability >= 1 or len(at) < 2:
        return at
    first = np.searchsorted(at, offsets)  # runs before each value
    value = np.searchsorted(offsets, at[:-1], "right") - 1
    place = np.arange(len(value)) - first[value]
    if mode == "null":
        begins = place == 0
        drawn = np.flatnonzero(~begins)
        begins[drawn] = _draws(config.seed, sequences, value[drawn], place[drawn]) < config.probability
    else:
        delim = _white_runs(data, at, mode)
        alone = delim & ((place == 0) | (place == first[value + 1] - first[value] - 1))
        drawn = np.flatnonzero(delim & ~alone)
        alone[drawn] = _draws(config.seed, sequences, value[drawn], place[drawn]) < config.probability
        begins = (place == 0) | alone
        begins[1:] |= alone[:-1]
    return np.concatenate([at[:-1][begins], at[-1:]])


def _white_runs(data: np.ndarray, at: np.ndarray, mode: str) -> np.ndarray:
    """Which runs are delimiters, by their first three bytes."""
    start, n = at[:-1], np.diff(at)
    if mode == "ascii":
        return _white(data[start], mode)
    x = np.full((len(start), 4), 0xFF, np.uint8)
    for k in range(3):
        some = n > k
        x[some, k] = data[start[some] + k]
    return _white(x.reshape(-1), mode)[::4]


def _run_counts(column: pa.Array, config: Segmentation, sequences: list[str | None] | None = None) -> tuple[pa.Array, pa.Array]:
    """The different segments of the values of a binary column, and how often each occurs."""
    data, offsets = joined(column)
    if sequences is None:
        at = bounds(data, offsets, config)
    else:
        parts = [np.zeros(1, np.int64)]
        for a, z in slices(offsets, 1 << 20):
            parts.append(bounds(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], config, sequences[a:z])[1:] + offsets[a])
        at = np.concatenate(parts)
    runs_ = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    found = runs_.value_counts()
    return found.field("values").cast(pa.binary()), found.field("counts")


def words(df: DataFrame, config: Segmentation, content: str = "content", sequence: str | None = None) -> DataFrame:
    """word (Latin-1 string), weight: the distinct segments and how often each occurs. Empty sequences have none."""
    glued = config.enabled and config.probability < 1
    rows = df.select(content).where(F.octet_length(content) > 0)
    if glued:
        # As in segments: without an id, equal sequences draw alike.
        seq = F.col(sequence) if sequence else F.xxhash64(content)
        rows = df.where(F.octet_length(content) > 0).select(content, seq.cast("string").alias("_seq"))

    # The segments are counted as they come, first within each batch.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(list(_run_counts(b.column(0), config, b.column(1).to_pylist() if glued else None)), ["word", "weight"])

    counted = rows.mapInArrow(run, "word binary, weight long")
    return counted.groupBy("word").agg(F.sum("weight").alias("weight")).select(latin1(F.col("word")).alias("word"), "weight")
