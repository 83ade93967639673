"""Near-duplicate documents by SimHash with random bit sampling.

A document's signature has 256 bits: each bigram of its words votes with the bits of its hash. Words are the runs of
letters and digits of the lower-cased text; a text with one word has that word for its feature. Equal signatures are one
node, however many rows have them. Nodes are compared through several tables. Each table samples some of the 256
coordinates at random, equal samples form a bucket, and within a bucket all pairs are compared by their Hamming distance.
The more signatures there are, the more coordinates a table samples, so that a bucket holds some 1,000 unrelated ones at
most; the number of tables follows from that and from the recall wanted at the largest distance that counts as near. A
bucket of more than ``cap`` signatures is compared in full, by blocks (``buckets``): nothing is left out of it. A near pair
counts in the first of the tables in which it meets, which both signatures tell, so links are counted without listing the
pairs of a group. The pairs that join components of a bucket make up the groups (connected components), whose class is
the row with the lowest (doc_id, key of the row).

Defined cases. A null or empty text, or one without letters and digits, has no signature: it is a class of its own and has
no links. Texts are hashed to their ends, however long. Rows with equal signatures are duplicates, whatever their ids, and
no links of each other: links counts other signatures. Rows equal in doc_id and text are one document: listed each, alike;
``dedup_documents`` keeps one of them, but all rows without text. A null doc_id is an id of its own, lowest in order. Of
equal doc_ids the lower key of the row is the class. An empty table has no rows. Further columns are ignored, or kept as they are
by ``dedup_documents``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byteloom.llm import buckets, common, wordhash

BITS = 256
#: Largest distance of near-duplicates, in bits.
MAX_DISTANCE = 54
#: Recall of pairs at that distance that the tables are planned for; nearer pairs have more.
RECALL = 0.97
CAP = 20_000
#: Most bits that a table samples; the number of the table stands above them in a key.
KEY_BITS = 48
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).copy().view(np.uint64)[:, 0]


def signatures_of(texts: pa.Array) -> list[bytes | None]:
    """The signatures of lower-cased texts."""
    data, rows = common.flat(texts)
    start, _, h = wordhash.words(data, wordhash.PUNCTUATION)
    first = wordhash.by_row(start, rows)
    n = np.diff(first)
    # Features: bigrams that stay in their row, or the only word.
    row = np.repeat(np.arange(len(n)), n)
    f = h.copy()
    if len(h):
        f[:-1] = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + wordhash.mix(h[1:], 1)
        last = first[1:][n > 0] - 1
        alone = n[row] == 1
        keep = np.ones(len(h), bool)
        keep[last] = False
        keep |= alone
        f[alone] = h[alone]
        f, row = f[keep], row[keep]
    counts = np.bincount(row, minlength=len(n))
    sums = np.zeros((len(n), BITS), np.uint32)
    at = np.cumsum(counts) - counts
    # Eight bits are counted in one addition, in bytes that hold up to 255; each run of a row is no longer than that.
    runs = np.concatenate([np.arange(a, a + c, 255) for a, c in zip(at.tolist(), counts.tolist()) if c]) if len(f) else np.zeros(0, int)
    if len(f):
        b = np.concatenate([wordhash.mix(f, 11 + k).view(np.uint8).reshape(-1, 8) for k in range(BITS // 64)], axis=1)
        lanes = np.empty((len(runs), BITS // 8), np.uint64)
        for i, (x, y) in enumerate(zip(runs.tolist(), np.append(runs[1:], len(f)).tolist())):
            lanes[i] = _LANES[b[x:y]].sum(axis=0)
        owner = row[runs]
        new = np.flatnonzero(np.diff(owner, prepend=-1))
        sums[owner[new]] = np.add.reduceat(lanes.view(np.uint8).reshape(len(owner), BITS).astype(np.uint32), new, axis=0)
    packed = np.packbits(sums * 2 > counts[:, None], axis=1)
    return [packed[k].tobytes() if counts[k] else None for k in range(len(n))]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k (key of the row), has_text, sig for each row of docs; sig is null for a row without words."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, 3):
            sig = pa.array(signatures_of(b.column(3)), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], sig], ["doc_id", "k", "has_text", "sig"])

    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("doc_id"), common.row_key(docs, id_col, text_col).alias("k"), F.coalesce(F.length(text) > 0, F.lit(False)).alias("has_text"), F.lower(text).alias("t"))
    return rows.mapInArrow(run, f"doc_id {id_type}, k long, has_text boolean, sig binary")


def plan(n: int, distance: int = MAX_DISTANCE, recall: float = RECALL) -> tuple[int, int]:
    """Bits that a table samples and number of tables for n signatures."""
    bits = min(KEY_BITS, max(4, math.ceil(math.log2(max(2, n))) - 10))
    # Coordinates are sampled without replacement.
    hit = math.comb(BITS - max(1, distance), bits) / math.comb(BITS, bits)
    return bits, max(4, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def _sample(bits: int, *seed: int) -> np.ndarray:
    return np.random.default_rng([*seed, 0xB17]).choice(BITS, bits, replace=False)


def _keys(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    return b[:, at].astype(np.int64) @ (np.int64(1) << np.arange(len(at), dtype=np.int64))


def _bits(column: pa.Array) -> np.ndarray:
    return np.unpackbits(_packed(column), axis=1)


def _packed(column: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[len(column)]].reshape(-1, BITS // 8)


def bucket_rows(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """key, k, sig: a row for each signature and table; the key is the table's number and the sampled bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [_sample(bits, t) for t in range(tables)]
        for batch in batches:
            if batch.num_rows:
                b = _bits(batch.column(1))
                for t in range(tables):
                    key = _keys(b, at[t]) | np.int64(t << KEY_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(1)], ["key", "k", "sig"])

    return reps.select("k", "sig").mapInArrow(run, "key long, k long, sig binary")


def first_met(a: np.ndarray, b: np.ndarray, table: np.ndarray, sig: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """Whether the rows a[i] and b[i], of a bucket of table[i], meet in none of the tables before it."""
    ok = np.ones(len(a), bool)
    most = int(table.max(initial=0))
    if most:
        rows, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = back[: len(a)], back[len(a) :]
        bits = np.unpackbits(sig[rows].view(np.uint8).reshape(len(rows), -1), axis=1)
        live = np.flatnonzero(table > 0)
        for t in range(most):
            live = live[table[live] > t]
            if not len(live):
                break
            key = _keys(bits, at[t])
            met = key[x[live]] == key[y[live]]
            ok[live[met]] = False
            live = live[~met]
    return ok


def linked(rows: DataFrame, bits: int, tables: int, limit: int = MAX_DISTANCE) -> DataFrame:
    """``buckets.LINKS`` of the near pairs of the bucket rows (key, block, side, k, sig), each pair in its first table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [_sample(bits, t) for t in range(tables)]
        for part in buckets.whole(batches):
            key, block, side, k = (np.asarray(part.column(i)) for i in range(4))
            sig = _packed(part.column(4)).view(np.uint64)
            words = [np.ascontiguousarray(x) for x in sig.T]
            table = key >> KEY_BITS

            def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return np.bitwise_count(sig[a] ^ sig[b]).sum(axis=1) <= limit

            def block_near(s: int, t: int, end: int) -> np.ndarray:
                d = [np.bitwise_count(w[s:t, None] ^ w[s:end]) for w in words]
                d[0] += d[1]
                d[2] += d[3]
                return np.add(d[0], d[2], dtype=np.uint16) <= limit

            def first() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for a, b in buckets.pairs_of(key, block, side, near, block_near):
                    ok = first_met(a, b, table[a], sig, at)
                    yield a[ok], b[ok]

            yield buckets.links(k, first())

    return buckets.gathered(rows).mapInArrow(run, buckets.LINKS)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_DISTANCE, cap: int = CAP, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """The signatures of docs, cached, and for each of them (sig) its class: kept (doc_id, k), the lowest, and links.

    The tables are planned for the given recall at the distance limit.
    """
    sigs = signatures(docs, id_col, text_col).persist()
    reps = sigs.where("sig is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "k")).alias("rep"))
    # Written once, so that the numbers stay as they are.
    reps = common.cut(reps.withColumn("k", F.monotonically_increasing_id()))
    bits, tables = plan(reps.count(), limit, recall)
    rows = buckets.capped(bucket_rows(reps, bits, tables), cap)
    return sigs, buckets.classes(reps, linked(rows, bits, tables, limit)).select("sig", "kept", "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """doc_id, k, class_id, class_k, links: for each row of docs its class and how many other signatures are near its own."""
    sigs, found = classes(docs, id_col, text_col, **options)
    kept = F.coalesce("kept", F.struct("doc_id", "k"))
    out = sigs.join(found, "sig", "left").withColumn("kept", kept)
    out = out.select("doc_id", "k", F.col("kept.doc_id").alias("class_id"), F.col("kept.k").alias("class_k"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return out


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The rows of docs less those that a near-duplicate or an equal row replaces; its columns stay as they are."""
    sigs, found = classes(docs, id_col, text_col, **options)
    key, own = common.fresh(docs, "row_key", "own_id")
    gone = sigs.join(found, "sig").where("k <> kept.k or not doc_id <=> kept.doc_id").select("doc_id", "k").distinct().toDF(own, key)
    keyed = docs.withColumn(key, common.row_key(docs, id_col, text_col))

    def same(other: DataFrame) -> Column:
        return (keyed[key] == other[key]) & keyed[id_col].eqNullSafe(other[own])

    out = keyed.join(gone, same(gone), "left_anti")
    # Rows without text have nothing to compare: all of them stay. Of equal rows with text one does.
    twice = common.cut(sigs.where("has_text").groupBy("doc_id", "k").count().where("count > 1").select("doc_id", "k").toDF(own, key))
    if not twice.isEmpty():
        more = keyed.join(twice, same(twice), "left_semi").join(gone, same(gone), "left_anti").dropDuplicates([id_col, key])
        out = out.join(twice, same(twice), "left_anti").unionByName(more)
    return out.select(*docs.columns)
