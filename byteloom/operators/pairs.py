"""Adjacent pairs of words written one character a token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adjacent(word: Column) -> Column:
    """The overlapping pairs of a word, as strings of two characters."""
    w = F.split(word, "")
    n = F.size(w)
    return F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))


def byte_pair_counts(df: DataFrame, content: str = "content") -> DataFrame:
    """pair (two bytes), n: counts of all adjacent bytes within each value, added up a batch at a time before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0).cast(pa.large_binary()).drop_null()
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            if len(data) < 2:
                continue
            pair = data[:-1].astype(np.uint16) << 8 | data[1:]
            within = np.ones(len(pair), bool)
            edge = offsets[1:-1] - offsets[0] - 1  # where a value ends and the next begins
            within[edge[(edge >= 0) & (edge < len(pair))]] = False
            n = np.bincount(pair[within], minlength=1 << 16)
            at = np.flatnonzero(n)
            keys = pa.array([int(x).to_bytes(2, "big") for x in at], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array(n[at].astype(np.int64))], ["pair", "n"])

    return df.select(content).mapInArrow(run, "pair binary, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """pair, n: weighted counts of all adjacent pairs of words (word, weight)."""
    pairs = words.where(F.length("word") > 1).select("weight", F.explode(adjacent(F.col("word"))).alias("pair"))
    return pairs.groupBy("pair").agg(F.sum("weight").alias("n"))


def top_pairs(counts: DataFrame, k: int) -> DataFrame:
    """The k pairs of greatest count; of equal counts those with the lower tokens first."""
    return counts.orderBy(F.desc("n"), "pair").limit(k)


def rewritten(word: Column, merges: list[tuple[str, str]]) -> Column:
    """word with each (pair, token) replaced in turn, from left to right and without overlaps."""
    for pair, token in merges:
        word = F.replace(word, F.lit(pair), F.lit(token))
    return word
