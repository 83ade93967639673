"""Near-duplicate embeddings by a pivot-permutation index.

Vectors are compared by their cosine. Each is described by the ordered list of the ``NEAREST`` pivots - reference
vectors drawn from the table - that it is closest to. Inverted lists are kept for pairs of pivots: two vectors that share
at least two pivots meet in a list. For those that meet the pivots shared are counted; only those that share ``MIN_SHARED``
or more with another one of their list, whose sketch - the signs of 64 random projections - is as near as near vectors' are,
stay in it, and their vectors are fetched to it and verified by their exact cosine. So lists are shuffled as numbers and
permutations, and vectors go to the few lists in which they have a likely partner. A pair counts in the list of the two
lowest pivots that it shares, so links are counted without listing the pairs of a group.

A list of more than ``CAP`` vectors is divided by a third pivot, which loses no vectors that share three; one that is still
larger is compared in full, by blocks (``buckets``). The pairs that join components of a list make up the groups (connected
components), whose class is the lowest id.

The number of pivots grows with the table up to ``MAX_PIVOTS``, which bounds what is sent to the executors. Every vector
is indexed. Vectors that were made from one another at the least similarity meet with probability above 0.95 (see the
tests); a nearest pivot that ties with another is the one drawn first.

Defined cases. A null vector, one without length, with a null, infinite or NaN component, or of another dimension than
most (of two dimensions that are as frequent the lower), is near nothing: a class of its own without links. Vectors that are
equal once scaled to length 1, in 32 bits, are duplicates but no links of each other. Repeated rows are listed each, alike; equal ids with
different vectors are different rows. A null id is an id of its own, lowest in order. Vectors may have any dimension. An
empty table has no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom.llm import buckets, common

SIMILARITY = 0.95
NEAREST, MIN_SHARED = 7, 3
MIN_PIVOTS, MAX_PIVOTS, ROWS_PER_PIVOT = 32, 1024, 128
CAP = 20_000
#: Signs of random projections in a sketch.
SKETCH = 64
#: The key of a list of pivots p < q is p << 16 | q, that of p < q < r is (1 << 32 | p << 16 | q) << 16 | r.
_THIRD = 1 << 48


def vectors_of(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, k (key of the row), vec as float32 bytes of length 1, null for vectors that can't be compared."""
    id_type = table.schema[id_col].dataType.simpleString()
    rows = table.select(table[id_col].alias("vec_id"), F.xxhash64(table[id_col].isNull(), table[id_col], table[vec_col]).alias("k"), table[vec_col].cast("array<float>").alias("v"))
    most = rows.where("size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = 0 if most is None else most["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pc.equal(pc.list_value_length(b.column(2)), size).fill_null(False)
            out = np.full(b.num_rows, None, object)
            if size and pc.any(ok).as_py():
                v = b.column(2).filter(ok).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                norm = np.sqrt((v * v).sum(axis=1))
                fine = np.isfinite(norm) & (norm > 0)
                unit = (v / np.where(fine, norm, 1)[:, None]).astype(np.float32)
                for i, x, good in zip(np.flatnonzero(ok.to_numpy(zero_copy_only=False)).tolist(), unit, fine.tolist()):
                    out[i] = x.tobytes() if good else None
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out.tolist(), pa.binary())], ["vec_id", "k", "vec"])

    return rows.mapInArrow(run, f"vec_id {id_type}, k long, vec binary")


def _matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def sketch_limit(similarity: float) -> int:
    """The most bits by which the sketches of near vectors differ, but for one pair in some ten thousand."""
    p = math.acos(min(1.0, max(-1.0, similarity))) / math.pi
    return min(SKETCH, math.ceil(SKETCH * p + 4 * math.sqrt(SKETCH * p * (1 - p))))


def lists(reps: DataFrame, pivots: np.ndarray) -> DataFrame:
    """key, k, pivots, sketch: each row of reps (k, vec) in the inverted list of every pair of its nearest pivots."""
    nearest = min(NEAREST, len(pivots))
    planes = np.random.default_rng(0x51).normal(size=(pivots.shape[1], SKETCH)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1))
            order = np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int16)
            described = pa.array([x.tobytes() for x in order], pa.binary())
            sketch = pa.array(np.packbits(v @ planes > 0, axis=1).view(np.int64)[:, 0])
            by = np.sort(order, axis=1).astype(np.int64)
            for i, j in combinations(range(nearest), 2):
                yield pa.RecordBatch.from_arrays([pa.array(by[:, i] << 16 | by[:, j]), b.column(0), described, sketch], ["key", "k", "pivots", "sketch"])

    return reps.select("k", "vec").mapInArrow(run, "key long, k long, pivots binary, sketch long")


def divided(rows: DataFrame, cap: int) -> DataFrame:
    """The lists, those of more than cap vectors divided by a third pivot above their two."""
    big = common.cut(rows.groupBy("key").count().where(F.col("count") > cap).select("key"))
    if big.isEmpty():
        return rows
    big = common.sized(big)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, own = np.asarray(b.column(0)), _matrix(b.column(2), np.int16)
            for i in range(own.shape[1]):
                third = own[:, i].astype(np.int64)
                # A pair counts where its lowest pivots are, so a lower third one isn't wanted.
                above = third > key & 0xFFFF
                yield pa.RecordBatch.from_arrays([pa.array(_THIRD | key << 16 | third), b.column(1), b.column(2), b.column(3)], ["key", "k", "pivots", "sketch"]).filter(pa.array(above))

    third = rows.join(big, "key", "left_semi").select("key", "k", "pivots", "sketch").mapInArrow(run, "key long, k long, pivots binary, sketch long")
    return rows.join(big, "key", "left_anti").select("key", "k", "pivots", "sketch").union(third)


class _Shared:
    """Which rows share enough pivots and count in their list."""

    def __init__(self, key: np.ndarray, own: np.ndarray, least: int):
        self.columns = [np.ascontiguousarray(x) for x in own.T]
        self.least = least
        third = key >= _THIRD
        # The highest pivot of the key, and how many the key has.
        self.top = (key & 0xFFFF).astype(np.int16)
        self.n = np.where(third, 3, 2).astype(np.int8)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, low = np.zeros(len(a), np.int8), np.zeros(len(a), np.int8)
        right, top = [y[b] for y in self.columns], self.top[a]
        for x in self.columns:
            left = x[a]
            hit = left == right[0]
            for y in right[1:]:
                hit |= left == y
            n += hit
            low += hit & (left <= top)
        return (n >= self.least) & (low == self.n[a])


def candidates(rows: DataFrame, least: int, similarity: float) -> DataFrame:
    """The rows of the lists (key, block, side, k, pivots) that have a likely partner there."""
    limit = sketch_limit(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in buckets.whole(batches):
            key, block, side = (np.asarray(part.column(i)) for i in range(3))
            shared, sketch = _Shared(key, _matrix(part.column(4), np.int16), least), np.asarray(part.column(5)).view(np.uint64)

            def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                out = np.bitwise_count(sketch[a] ^ sketch[b]) <= limit
                at = np.flatnonzero(out)
                out[at] = shared(a[at], b[at])
                return out

            def block_near(s: int, t: int, end: int) -> np.ndarray:
                out = np.bitwise_count(sketch[s:t, None] ^ sketch[s:end]) <= limit
                a, b = np.nonzero(out)
                out[a, b] = shared(a + s, b + s)
                return out

            stays = np.zeros(len(key), bool)
            for a, b in buckets.pairs_of(key, block, side, near, block_near):
                stays[a] = stays[b] = True
            yield part.filter(pa.array(stays)).select(["key", "block", "side", "k", "pivots"])

    return buckets.gathered(rows).mapInArrow(run, "key long, block long, side long, k long, pivots binary")


def linked(rows: DataFrame, least: int, similarity: float) -> DataFrame:
    """``buckets.LINKS`` of the near pairs of the rows (key, block, side, k, pivots, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in buckets.whole(batches):
            key, block, side, k = (np.asarray(part.column(i)) for i in range(4))
            shared, vec = _Shared(key, _matrix(part.column(4), np.int16), least), _matrix(part.column(5))

            def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                out = np.einsum("ij,ij->i", vec[a], vec[b]) >= similarity
                at = np.flatnonzero(out)
                out[at] = shared(a[at], b[at])
                return out

            def block_near(s: int, t: int, end: int) -> np.ndarray:
                out = vec[s:t] @ vec[s:end].T >= similarity
                a, b = np.nonzero(out)
                out[a, b] = shared(a + s, b + s)
                return out

            yield buckets.links(k, buckets.pairs_of(key, block, side, near, block_near))

    return buckets.gathered(rows).mapInArrow(run, buckets.LINKS)


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", similarity: float = SIMILARITY, cap: int = CAP) -> DataFrame:
    """vec_id, class_id, links: for each row of the table its class and how many other vectors are near its own."""
    rows = vectors_of(table, id_col, vec_col).persist()
    # Equal vectors are one in the index. Written once, so that the numbers stay as they are.
    reps = rows.where("vec is not null").groupBy("vec").agg(F.min(F.struct("vec_id", "k")).alias("rep"))
    reps = common.cut(reps.withColumn("k", F.monotonically_increasing_id()))
    wanted = min(MAX_PIVOTS, max(MIN_PIVOTS, reps.count() // ROWS_PER_PIVOT))
    chosen = [r.vec for r in reps.orderBy(F.xxhash64("vec"), "vec").limit(wanted).select("vec").collect()]
    if not chosen:
        return rows.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    pivots = np.frombuffer(b"".join(bytes(x) for x in chosen), np.float32).reshape(len(chosen), -1)
    least = min(MIN_SHARED, len(pivots))
    found = candidates(buckets.capped(divided(lists(reps, pivots), cap), cap), least, similarity)
    found = found.join(reps.select("k", "vec"), "k").select("key", "block", "side", "k", "pivots", "vec")
    known = buckets.classes(reps, linked(found, least, similarity)).select("vec", "kept", "links")
    out = rows.join(known, "vec", "left").withColumn("kept", F.coalesce("kept", F.struct("vec_id", "k")))
    return out.select("vec_id", F.col("kept.vec_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


#: The same rows in DuckDB's SQL, from embeddings (vec_id, embedding), by all pairs.
SQL = f"""
with recursive d as (
  select vec_id, list_transform(embedding, lambda x: (x / n)::float) as e from (
    select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings) where n > 0),
u as (select e, min(vec_id) as rep from d group by e),
near as (select a.rep as a, b.rep as b from u a join u b on a.rep <> b.rep and list_inner_product(a.e, b.e) >= {SIMILARITY}),
reached as (select rep as a, rep as b from u union select r.a, n.b from reached r join near n on r.b = n.a),
class as (select a, min(b) as class_id from reached group by a)
select vec_id, coalesce(c.class_id, vec_id) as class_id, (select count(*) from near n where n.a = u.rep) as links
from embeddings left join d using (vec_id) left join u using (e) left join class c on c.a = u.rep
"""
