"""Buckets of rows that may be near one another: large ones in blocks, links counted once, components of what is linked.

Rows have a key, their bucket, and k, their number. A bucket of more than ``cap`` rows is cut into blocks of ``cap`` / 2, and
every two of its blocks are compared as a bucket of their own, so that no task holds more than some ``cap`` rows of one
bucket and no pair of rows is left out. Rows of one block meet in several of those; ``side`` tells in which they count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from byteloom.llm import common

#: Rows of Python batches, at least, that are looked at together.
TOGETHER = 1 << 14
#: Buckets up to this size are compared lag by lag with all others of the batch, larger ones by themselves.
SMALL = 64


def capped(rows: DataFrame, cap: int) -> DataFrame:
    """The rows (key, k, ...) with block and side; block 0 is a whole bucket."""
    plain = rows.withColumn("block", F.lit(0).cast("long")).withColumn("side", F.lit(1).cast("long"))
    big = rows.groupBy("key").count().where(F.col("count") > cap).select("key", F.ceil(F.col("count") * 2 / cap).alias("blocks"))
    big = common.cut(big)
    if big.isEmpty():
        return plain
    big = common.sized(big)
    own = rows.join(big, "key").withColumn("own", F.pmod(F.xxhash64(F.lit(cap), "k"), "blocks"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("own <> other")
    # Two rows of one block count where it meets the next one.
    block = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other") + 1
    side = F.col("own") * 2 + (F.col("other") == F.pmod(F.col("own") + 1, F.col("blocks"))).cast("long")
    two = own.withColumn("block", block).withColumn("side", side).drop("blocks", "own", "other")
    return plain.join(big, "key", "left_anti").unionByName(two)


def gathered(rows: DataFrame) -> DataFrame:
    """key, block, side, k and the rest, of buckets with two rows or more, each bucket in one partition and sorted."""
    rest = [c for c in rows.columns if c not in ("key", "block", "side", "k")]
    # A window sees one bucket or two blocks, whose size cap bounds.
    many = rows.withColumn("_n", F.count("*").over(Window.partitionBy("key", "block"))).where("_n > 1")
    return many.select("key", "block", "side", "k", *rest).sortWithinPartitions("key", "block", "k")


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows in batches that end where a bucket does."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        last = batch.column(0)[-1], batch.column(1)[-1]
        if n < TOGETHER or (held[0].column(0)[0], held[0].column(1)[0]) == last:
            continue
        joined_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        own = (np.asarray(joined_.column(0)) == last[0].as_py()) & (np.asarray(joined_.column(1)) == last[1].as_py())
        stop = int(np.flatnonzero(~own)[-1]) + 1
        yield joined_.slice(0, stop)
        held = [joined_.slice(stop)]
        n = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pairs_of(
    key: np.ndarray, block: np.ndarray, side: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], block_near: Callable[[int, int, int, int], np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the near pairs of every bucket that count there, the earlier row first.

    near(a, b) tells it of rows a[i] and b[i]; block_near(s, t, end) of rows s to t with all rows from s to end, as a matrix.
    """
    if not len(key):
        return
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
    size = np.diff(np.append(new, len(key)))
    left = np.repeat(size, size) - (np.arange(len(key)) - np.repeat(new, size)) - 1  # rows of the bucket that follow
    left[np.repeat(size > SMALL, size)] = 0

    def counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (side[a] >> 1 != side[b] >> 1) | (side[a] & 1 == 1)
        return (a, b) if ok.all() else (a[ok], b[ok])

    lag, at = 1, np.flatnonzero(left >= 1)
    while len(at):
        hit = at[near(at, at + lag)]
        if len(hit):
            yield counted(hit, hit + lag)
        lag += 1
        at = at[left[at] >= lag]
    for s, n in zip(new[size > SMALL].tolist(), size[size > SMALL].tolist()):
        step = max(8, min(256, (1 << 17) // n))
        for i in range(s, s + n, step):
            j = min(i + step, s + n)
            a, b = np.divmod(np.flatnonzero(block_near(i, j, s + n)), s + n - i)
            after = a < b
            if after.any():
                yield counted(a[after] + i, b[after] + i)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labels of components once the pairs (a, b), a < b, join them, and the pairs (2 x n) that did."""
    pairs = [np.zeros((2, 0), np.int64)]
    while len(at := np.flatnonzero(label[a] != label[b])):
        a, b = a[at], b[at]
        # Each label that meets a lower one gets below it by one pair, which makes no ring.
        high, first = np.unique(np.maximum(label[a], label[b]), return_index=True)
        pairs.append(np.stack([a[first], b[first]]))
        below = np.arange(len(label))
        below[high] = np.minimum(label[a], label[b])[first]
        while (below[below] != below).any():
            below = below[below]
        label = below[label]
    return label, np.concatenate(pairs, axis=1)


LINKS = "u long, v long, n long"


def links(k: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (u, v, null) that join the components of the pairs, and rows (u, null, n) with the number of pairs of a row."""
    label, n, edges = np.arange(len(k)), np.zeros(len(k), np.int64), [np.zeros((2, 0), np.int64)]
    for a, b in pairs:
        if len(a):
            n += np.bincount(a, minlength=len(k)) + np.bincount(b, minlength=len(k))
            label, new = joined(label, a, b)
            edges.append(new)
    e, at = np.concatenate(edges, axis=1), np.flatnonzero(n)
    u = np.concatenate([k[e[0]], k[at]])
    counts = np.zeros(len(at), bool)
    v = pa.array(np.concatenate([k[e[1]], k[at]]), pa.int64(), mask=np.append(np.zeros(e.shape[1], bool), ~counts))
    return pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(np.concatenate([e[0], n[at]]), pa.int64(), mask=np.append(np.ones(e.shape[1], bool), counts))], ["u", "v", "n"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """k, root: for every node of the pairs (u, v), the lowest node of its connected component, by alternating stars.

    Minima are aggregated before they are shuffled and joined back, so a node with any number of neighbours is no task of its
    own. An error if the components aren't done after so many rounds, which are some logarithm of the longest chain.
    """
    e = common.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u").toDF("u", "v"))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.toDF("u", "v"))
        e = common.cut(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components aren't done after {rounds} rounds")
    return e.select(F.col("u").alias("k"), F.col("v").alias("root")).union(e.select("v", "v").toDF("k", "root")).distinct()


def classes(reps: DataFrame, linked: DataFrame) -> DataFrame:
    """reps (k, rep, ...) with kept, the lowest rep of the row's component, and links, the number of rows near it."""
    linked = common.cut(linked)
    roots = components(linked.where("v is not null").select("u", "v"))
    n = linked.where("v is null").groupBy(F.col("u").alias("k")).agg(F.sum("n").alias("links"))
    member = common.cut(roots.join(reps.select("k", "rep"), "k"))
    kept = member.groupBy("root").agg(F.min("rep").alias("kept"))
    known = member.join(kept, "root").select("k", "kept").join(n, "k")
    out = reps.join(known, "k", "left")
    return out.withColumn("kept", F.coalesce("kept", "rep")).withColumn("links", F.coalesce("links", F.lit(0)).cast("long"))
