"""Repeated passages by sparse suffixes, grouped by hashes.

A passage is ``MIN_WORDS`` successive words (runs of anything but ASCII white space and NUL, compared byte by byte). A
passage is repeated if it also stands elsewhere, in another document or again in the same one. What every repeated
passage covers is reported; its first occurrence, in the order of (doc_id, key of the row, place), is kept and all
others can be removed. Where an occurrence overlaps its own first one, as in a text that repeats one word, only what lies
beyond that counts as repeated, so that the first occurrence stays whole.

Of all suffixes only those are retained that begin at a minimiser: the place with the least hash of ``SEED`` words in a
passage. Two equal passages have the same minimiser at the same offset, so no repeat is lost. Retained suffixes are
grouped by the 64-bit hash of a stretch of ``REACH`` words around the minimiser - that to the right for passages that lie
mostly to its right, that to the left for the others. For those that aren't alone in their group all passages around the
minimiser are hashed in their documents. The passages of a suffix travel in one row, to where all suffixes with the same
stretch are; there they are grouped by their 64-bit hashes, which leaves the repeated ones. Suffixes are neither put in the
order of their words nor extended word by word, as only the equality of stretches of fixed length counts.

What is equal within a batch of documents is compared there before anything is shuffled: only the lowest document of a batch
stands for a passage in its group. A task also remembers, in a table of fixed size, what its batches had: once it has sent
one occurrence and one to keep it company, it sends others only where they are the lowest so far. So of a passage that a third of
all documents share some rows a task are shuffled, however many documents the task has, and no set of pairs.

Defined cases. Texts of fewer than MIN_WORDS words, null and empty ones included, have no passage. Very long texts have all
their passages compared. Rows equal in doc_id and text are one document: they don't repeat each other and are edited alike.
Rows of one doc_id with different texts are different documents. A null doc_id is an id of its own, lowest in order. Of
places with tied hashes the leftmost is the minimiser. An empty table has no rows. Further columns are ignored, or kept as
they are by ``remove_repeats``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from byteloom.llm import common, wordhash

MIN_WORDS, SEED = 50, 10
#: Words around a minimiser that are compared first.
REACH = 30
#: Hashes that a task remembers, a power of two.
SLOTS = 1 << 18


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The place of the least value, the leftmost of several, in every window of w values."""
    n = len(v) - w + 1
    size = -(-len(v) // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
    # The leftmost place: the first in the block where the running minimum from the right equals it, else in the next.
    at = np.arange(size)
    spot = np.where(padded == back, at, size).reshape(-1, w)
    spot = np.minimum.accumulate(spot[:, ::-1], axis=1)[:, ::-1].ravel()  # leftmost place at or after i whose value is the minimum of the rest of its block
    head = np.where(np.concatenate([[True], ahead[1:] < ahead[:-1]]) | (at % w == 0), at, 0)
    head = np.maximum.accumulate(head)  # the place of the running minimum
    left = spot[:n]
    return np.where(back[:n] == low, left, head[w - 1 : w - 1 + n])


class Document:
    """The words of one text, and the minimiser of every passage."""

    def __init__(self, h: np.ndarray):
        self.n = len(h) - MIN_WORDS + 1  # number of passages
        self.runs = wordhash.Runs(h)
        seeds = np.arange(len(h) - SEED + 1)
        self.at = _least(self.runs(seeds, seeds + SEED), MIN_WORDS - SEED + 1)
        self.offset = self.at - np.arange(self.n)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the stretches around the minimisers, and the places: twice the word, plus one for those to the left."""
        side = self.offset > MIN_WORDS - REACH
        right, left = np.unique(self.at[~side]), np.unique(self.at[side])
        reach = REACH - SEED + 1
        key = np.concatenate([self.runs(right, right + REACH), self.runs(left - reach, left + SEED) ^ np.uint64(1)])
        return key, np.concatenate([right * 2, left * 2 + 1])

    def passages(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of the places that is a minimiser: its key, and first and number of its passages, which are successive."""
        side = self.offset > MIN_WORDS - REACH
        own = self.at * 2 + side
        marked = np.zeros(2 * (self.n + MIN_WORDS), bool)
        marked[places[places < len(marked)]] = True
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.append(begin, self.n))
        hit = marked[own[begin]]
        begin, count = begin[hit], count[hit]
        at, left = self.at[begin], side[begin]
        reach = REACH - SEED + 1
        key = self.runs(np.where(left, at - reach, at), np.where(left, at + SEED, at + REACH)) ^ left.astype(np.uint64)
        return key, begin, count


def _documents(column: pa.Array) -> Iterator[tuple[int, Document]]:
    data, rows = common.flat(column)
    start, _, h = wordhash.words(data, wordhash.SPACE)
    first = wordhash.by_row(start, rows)
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a >= MIN_WORDS:
            yield k, Document(h[a:b])


class Met:
    """What a task has met lately, by hash. A slot holds the last of the hashes that fall in it; the others are forgotten."""

    def __init__(self, **columns: type):
        self.hash, self.used = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, bool)
        self.values = {name: np.zeros(SLOTS, kind) for name, kind in columns.items()}

    def known(self, h: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Whether each of the hashes is here, and what is remembered of it."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        return self.used[slot] & (self.hash[slot] == h), {name: x[slot] for name, x in self.values.items()}

    def keep(self, h: np.ndarray, **values: np.ndarray) -> None:
        """Remembers the hashes, all different, with their values."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        self.hash[slot] = h
        self.used[slot] = True
        last = self.hash[slot] == h
        for name, x in values.items():
            self.values[name][slot[last]] = x[last]


def _spread(k: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys of rows that need no company."""
    return wordhash.mix(k.view(np.uint64) ^ wordhash.mix(place.astype(np.uint64), 3), 4)


def retained(docs: DataFrame) -> DataFrame:
    """key, k, place, sure of the retained suffixes of docs (k, text).

    Of those with one key in a batch of documents, one has this key; the others, sure to be repeated, get keys of their own,
    and so does that one if the task has sent one that is sure before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met(k=np.int64, place=np.int32, told=bool)
        for b in common.pieces(batches, 1):
            ks, parts = np.asarray(b.column(0)), ([], [], [])
            for i, d in _documents(b.column(1)):
                key, place = d.keys()
                for part, x in zip(parts, (key, np.full(len(key), ks[i]), place.astype(np.int32))):
                    part.append(x)
            if not parts[0]:
                continue
            key, k, place = map(np.concatenate, parts)
            order = np.argsort(key, kind="stable")
            key, k, place = key[order], k[order], place[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            other = (k != k[head]) | (place != place[head])
            at, group = np.flatnonzero(new), np.cumsum(new) - 1
            known, was = met.known(key[at])
            told = known & was["told"]
            one = told | (known & ((was["k"] != k[at]) | (was["place"] != place[at]))) | np.logical_or.reduceat(other, at)
            met.keep(key[at], k=np.where(known, was["k"], k[at]), place=np.where(known, was["place"], place[at]), told=one)
            sure = one[group]
            away = ~new
            away[at] = told
            key = np.where(sure & away, _spread(k, place), key)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(k), pa.array(place), pa.array(sure)], ["key", "k", "place", "sure"])

    return docs.select("k", "text").mapInArrow(run, "key long, k long, place int, sure boolean")


def matched(suffixes: DataFrame) -> DataFrame:
    """k, places: for each document the suffixes that have an equal neighbour which is another one."""
    # A key of many documents has some rows a task.
    run = Window.partitionBy("key")
    own = F.struct("k", "place")
    found = suffixes.withColumn("lo", F.min(own).over(run)).withColumn("hi", F.max(own).over(run)).where("sure or lo <> hi")
    return found.groupBy("k").agg(F.collect_set("place").alias("places"))


def _ranks(ids: pa.Array, ks: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """The rank of each row in the order of (id, k), nulls first, and what each rank stands for; equal rows have one rank."""
    keys = [(i is not None, i, k) for i, k in zip(ids.to_pylist(), ks.tolist())]
    names = sorted(set(keys))
    place = {x: n for n, x in enumerate(names)}
    return np.array([place[x] for x in keys], np.int64), names


class Lowest:
    """The lowest document so far that each passage of a task stands in, and whether it has company where it was sent."""

    def __init__(self) -> None:
        self.names: list[tuple] = []
        self.met = Met(owner=np.int64, told=bool)

    def later(self, h: np.ndarray, rank: np.ndarray, names: list[tuple], shared: np.ndarray) -> np.ndarray:
        """Of the passages h, which needn't be sent as a lower document has them, and both that and a further one were sent.

        rank is the lowest document of the batch with the passage, by its place in names; shared tells that it isn't the only one.
        """
        known, was = self.met.known(h)
        base = len(self.names)
        self.names += names
        owner, own = np.where(known, was["owner"], 0), rank + base
        at = np.flatnonzero(known)
        pairs, back = np.unique(np.stack([owner[at], own[at]]), axis=1, return_inverse=True)
        order = np.array([(self.names[a] > self.names[b]) - (self.names[a] < self.names[b]) for a, b in pairs.T.tolist()], np.int64)
        side = np.zeros(len(h), np.int64)
        side[at] = order[back.ravel()]
        told = known & was["told"]
        self.met.keep(h, owner=np.where(known & (side <= 0), owner, own), told=told | shared | (side != 0))
        if len(self.names) > SLOTS:
            self.__init__()
        return told & (side < 0)


def extended(joined: DataFrame, doc: str, key: str, text: str, places: str, id_type: str) -> DataFrame:
    """key, doc_id, k, start, hs, later, seen: each matched suffix with its passages, the first of which begins at word start.

    joined has all columns of the documents and the places. Of the passages that are equal in a batch of documents only
    those of its lowest document have their hashes in hs. The others, whatever other batches hold, stand somewhere earlier:
    they are in the bits of later, and their hashes are null. So are those of which the task has sent a lower document and
    one more before. The bits of seen tell the passages that have others in the batch. A suffix with nothing left in hs gets
    a key of its own.
    """
    at = [joined.columns.index(c) for c in (doc, key, text, places)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest = Lowest()
        for b in common.pieces(batches, at[2]):
            ids, k, texts, places = (b.column(i) for i in at)
            ks, found = np.asarray(k), []
            for i, d in _documents(texts):
                key, begin, count = d.passages(np.asarray(places[i].values))
                if len(begin):
                    first = np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)
                    found.append((key, np.full(len(key), i), begin, count, d.runs(first, first + MIN_WORDS)))
            if not found:
                continue
            rank, names = _ranks(ids, ks)
            found.sort(key=lambda x: rank[x[1][0]])
            key, row, start, n, h = map(np.concatenate, zip(*found))
            # Equal passages, in the order of their documents.
            order = np.argsort(h, kind="stable")
            hs, own = h[order], np.repeat(rank[row], n)[order]
            new = np.concatenate([[True], hs[1:] != hs[:-1]])
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            other = own != own[first][group]
            shared = np.logical_or.reduceat(other, first)
            gone = lowest.later(hs[first], own[first], names, shared)
            is_later, is_seen = np.zeros(len(h), bool), np.zeros(len(h), bool)
            is_later[order], is_seen[order] = other | gone[group], shared[group] & ~other
            heads = np.cumsum(n) - n
            bit = np.int64(1) << (np.arange(len(h)) - np.repeat(heads, n))
            later, seen = (np.add.reduceat(np.where(x, bit, 0), heads) for x in (is_later, is_seen))
            open_ = np.logical_or.reduceat(~is_later, heads)
            key = np.where(open_, key, _spread(ks[row], start))
            kept = np.repeat(open_, n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(open_, n, 0))]), pa.int32()), pa.array(h[kept].view(np.int64), mask=is_later[kept]))
            columns = [pa.array(key.view(np.int64)), ids.take(pa.array(row)), pa.array(ks[row]), pa.array(start.astype(np.int32)), lists, pa.array(later), pa.array(seen)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "k", "start", "hs", "later", "seen"])

    return joined.mapInArrow(run, f"key long, doc_id {id_type}, k long, start int, hs array<long>, later long, seen long")


def spans(suffixes: DataFrame) -> DataFrame:
    """doc_id, k, removed, start_word, end_word: what repeated passages cover; the words [start, end)."""
    rows = suffixes.repartition("key").select("key", "doc_id", "k", "start", F.col("later").alias("known"), "seen", F.posexplode_outer("hs").alias("j", "h"))
    rows = rows.where("h is not null or j is null")
    # Equal passages have equal keys, so that they are sorted and compared where they are, one row for each batch.
    run = Window.partitionBy("key", "h")
    own = F.struct("doc_id", "k", (F.col("start") + F.col("j")).alias("at"))
    rows = rows.withColumn("own", own).withColumn("lo", F.min("own").over(run)).withColumn("hi", F.max("own").over(run))
    bit, end = F.expr("shiftleft(1L, j)"), F.lit(MIN_WORDS)
    repeated = F.col("h").isNotNull() & ((F.col("lo") != F.col("hi")) | (F.col("seen").bitwiseAND(bit) != 0))
    rows = rows.withColumn("repeated", F.coalesce(repeated, F.lit(False))).where("repeated or known <> 0")
    later = F.col("repeated") & (F.col("own") != F.col("lo"))
    over = later & (F.col("lo.k") == F.col("k")) & F.col("lo.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("own.at") - F.col("lo.at") < MIN_WORDS)
    # A suffix has at most MIN_WORDS - SEED + 1 passages: which of them repeat goes into the bits of one number.
    masks = rows.groupBy("key", "doc_id", "k", "start").agg(
        F.coalesce(F.bit_or(F.when(later & ~over, bit)), F.lit(0)).cast("long").bitwiseOR(F.max("known")).alias("later"),
        F.coalesce(F.bit_or(F.when(F.col("repeated") & ~later, bit)), F.lit(0)).cast("long").alias("first"),
        F.collect_list(F.when(over, F.struct((F.col("lo.at") + end).alias("s"), (F.col("own.at") + end).alias("e")))).alias("parts"),
    )
    no_parts = F.array().cast("array<struct<s:int,e:int>>")
    kinds = F.array(
        F.struct(F.lit(True).alias("removed"), F.col("later").alias("mask"), F.col("parts").alias("parts")),
        F.struct(F.lit(False).alias("removed"), F.col("first").alias("mask"), no_parts.alias("parts")),
    )
    found = masks.select("k", "doc_id", "start", F.explode(kinds).alias("x")).where("x.mask <> 0 or size(x.parts) > 0")
    found = found.select("k", "doc_id", "start", "x.removed", "x.mask", "x.parts").repartition("k")
    whole = F.expr(f"transform(filter(sequence(0, {MIN_WORDS - SEED}), j -> shiftright(mask, j) & 1 = 1), j -> named_struct('s', start + j, 'e', start + j + {MIN_WORDS}))")
    found = found.select("k", "doc_id", "removed", F.explode(F.concat(whole, "parts")).alias("x")).select("k", "doc_id", "removed", "x.s", "x.e")
    # These windows see one document.
    by = Window.partitionBy("k", "doc_id", "removed").orderBy("s", "e")
    reached = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("gap", (F.col("s") > reached).cast("int"))
    found = found.withColumn("island", F.sum(F.coalesce("gap", F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = found.groupBy("k", "doc_id", "removed", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
    return out.select("doc_id", "k", "removed", "start_word", "end_word")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    key, places = common.fresh(docs, "row_key", "places")
    # One exchange by key serves the search and, in remove_repeats, the edit.
    return docs.withColumn(key, common.row_key(docs, id_col, text_col)), key, places


def _spans(keyed: DataFrame, key: str, places: str, id_col: str, text_col: str) -> DataFrame:
    suffixes = retained(keyed.select(F.col(key).alias("k"), F.col(text_col).alias("text")))
    joined = keyed.join(matched(suffixes).toDF(key, places), key)
    return spans(extended(joined, id_col, key, text_col, places, keyed.schema[id_col].dataType.simpleString()))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k, removed, start_word, end_word: the stretches of words that repeated passages cover.

    removed tells those that also stand earlier; the others are first occurrences. A document can have both, and they can
    overlap.
    """
    keyed, key, places = _keyed(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "doc_id", "text")
    return _spans(keyed, key, places, "doc_id", "text")


def without_words(text: str, gone: list[tuple[int, int]]) -> str:
    """text without the words [start, end) of each pair, and without the white space that follows them."""
    data = np.frombuffer(text.encode() + b"\0", np.uint8)
    inside = ~wordhash.SPACE[data]
    starts = np.append(np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])), len(data) - 1)
    keep = np.ones(len(data) - 1, bool)
    for a, b in gone:
        keep[starts[a] : starts[min(b, len(starts) - 1)]] = False
    return data[:-1][keep].tobytes().decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the repeated passages cut out of their texts, all but the first occurrence of each.

    A column named n_chars_col, if docs has it, gets the new length of an edited text. A document of which no text is left
    is dropped; those whose text was null or empty before stay.
    """
    keyed, key, places = _keyed(docs, id_col, text_col)
    found = _spans(keyed, key, places, id_col, text_col).where("removed")
    cuts, k = common.fresh(keyed, "cuts", "found_k")
    found = found.groupBy("k").agg(F.collect_list(F.struct("doc_id", "start_word", "end_word")).alias("cuts")).toDF(k, cuts)

    def edit(text: pa.Array, cuts: pa.Array) -> pa.Array:
        out = [None if t is None or c is None else without_words(t, [(x["start_word"], x["end_word"]) for x in c]) for t, c in zip(text.to_pylist(), cuts.to_pylist())]
        return pa.array(out, pa.string())

    # Called nondeterministic, so that it isn't run a second time in the condition below. Only edited texts go to Python.
    edited = F.arrow_udf(edit, "string").asNondeterministic()
    cut = F.col(cuts).isNotNull()
    (new,) = common.fresh(keyed.withColumn(cuts, F.lit(0)), "edited_text")
    # Joined by the key alone, by which the documents are there already; a key is the document's together with its id.
    own = F.filter(cuts, lambda x: x["doc_id"].eqNullSafe(keyed[id_col]))
    joined = keyed.join(found, keyed[key] == found[k], "left").withColumn(cuts, F.when(F.size(own) > 0, own)).withColumn(new, edited(F.when(cut, F.col(text_col)), F.col(cuts)))
    values = {text_col: F.when(cut, F.col(new)).otherwise(F.col(text_col))}
    if n_chars_col in docs.columns:
        values[n_chars_col] = F.when(cut, F.length(new).cast(docs.schema[n_chars_col].dataType)).otherwise(F.col(n_chars_col))
    left = joined.where(~cut | (F.length(F.trim(F.col(new), F.lit(" \t\n\r\f"))) > 0))
    return left.select(*(values.get(c, F.col(c)).alias(c) for c in docs.columns))
