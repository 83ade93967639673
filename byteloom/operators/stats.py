"""Histograms, entropy, and what rests on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes whose histograms are counted at once.
PART = 1 << 18


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins and the last one ends; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_rows(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, byte (hex), n: the histogram of the bytes of each key."""
    bytes_ = F.filter(F.split(F.hex(F.col(content)), "(?<=\\G..)"), lambda x: x != "")
    return df.select(key, F.explode(bytes_).alias("byte")).groupBy(key, "byte").agg(F.count("*").alias("n"))


def byte_histogram(df: DataFrame, content: str = "content") -> DataFrame:
    """byte (hex), n over all sequences, added up a batch at a time before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.bincount(_bytes(b.column(0))[0], minlength=256)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([f"{x:02X}" for x in at], pa.string()), pa.array(n[at].astype(np.int64))], ["byte", "n"])

    return df.select(content).mapInArrow(run, "byte string, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def entropies(column: pa.Array) -> np.ndarray:
    """Bits a byte of the values of a binary column; 0 for null and for no bytes."""
    data, at = _bytes(column)
    size = np.diff(at)
    total = np.zeros(len(size))
    # Cells of the histograms of 1,024 values at a time; of their bytes, so many that the arrays made of them stay small.
    for a in range(0, len(size), 1024):
        b = min(a + 1024, len(size))
        cells = np.zeros((b - a) << 8, np.int64)
        for i in range(int(at[a]), int(at[b]), PART):
            j = min(i + PART, int(at[b]))
            first, last = np.searchsorted(at, [i, j - 1], "right") - 1
            row = np.repeat(np.arange(first - a, last + 1 - a), np.diff(np.clip(at[first : last + 2], i, j)))
            n = np.bincount((row - row[0]) << 8 | data[i:j])
            cells[int(row[0]) << 8 : (int(row[0]) << 8) + len(n)] += n
        cells = cells.reshape(b - a, 256)
        total[a:b] = (cells * np.log2(np.maximum(cells, 1))).sum(axis=1)
    out = np.zeros(len(size))
    some = size > 0
    n = size[some].astype(np.float64)
    out[some] = np.maximum(0.0, np.log2(n) - total[some] / n)
    return out


def _entropies(column: pa.Array) -> pa.Array:
    return pa.array(entropies(column))


def entropy_of(content: Column) -> Column:
    """Bits a byte of one value, from its histogram; 0 for no bytes. No shuffle."""
    return F.arrow_udf(_entropies, "double")(content)


def with_entropy(df: DataFrame, content: str = "content", name: str = "entropy") -> DataFrame:
    return df.withColumn(name, entropy_of(F.col(content)))


def entropy_window(df: DataFrame, low: float | None = None, high: float | None = None, content: str = "content", clamp: bool = True) -> DataFrame:
    """Sequences whose entropy lies in [low, high]. A missing side is 0 or 8; without both, all stay."""
    if low is None and high is None:
        return df
    lo, hi = 0.0 if low is None else low, 8.0 if high is None else high
    if clamp:
        lo, hi = min(max(lo, 0.0), 8.0), min(max(hi, 0.0), 8.0)
    if lo > hi:
        raise ValueError("the least entropy is above the greatest")
    return df.where(entropy_of(F.col(content)).between(lo, hi))


def deduplicated(df: DataFrame, index: str, content: str = "content") -> DataFrame:
    """df with hash, and first_index: the lowest index with the same content."""
    out = df.withColumn("hash", F.sha2(F.col(content), 256))
    return out.withColumn("first_index", F.min(index).over(Window.partitionBy("hash")))


def chunk_weights(df: DataFrame) -> DataFrame:
    """df (byte_len, entropy, ...) with weight, which sums to 1: clamped entropy times clamped root of the relative length."""
    base = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("entropy") / 8))
    one = df.agg(F.avg("byte_len").alias("_mean"))
    relative = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.sqrt(F.col("byte_len") / F.col("_mean"))))
    # The totals are one row each.
    raw = df.crossJoin(F.broadcast(one)).withColumn("weight", base * relative).drop("_mean")
    two = raw.agg(F.sum("weight").alias("_total"), F.count("*").alias("_n"))
    share = F.when(F.col("_total") > 0, F.col("weight") / F.col("_total")).otherwise(1.0 / F.col("_n"))
    return raw.crossJoin(F.broadcast(two)).withColumn("weight", share).drop("_total", "_n")
