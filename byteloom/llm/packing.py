"""Best-fit packing of documents into bins of a fixed number of tokens.

A document of n tokens takes n + ``END`` places, for an end-of-text token. What exceeds the capacity is first cut into
full bins. Best-fit decreasing is planned over the histogram of lengths: of a length with c items, whole groups of equal
bins are filled at once, so the plan takes time in the number of lengths and none in the number of documents. Documents
then take the planned slots by their rank within their length, in the order of (doc_id, key of the row). The result is
that of best-fit decreasing over the documents one by one.

Ranks within a length come from ranks within (length, salt) and the histogram over both: a length has a salt for every
``SALT_ROWS`` items, so that one that many documents have isn't one task. The plan has at most some slots for each length;
it depends on the capacity.

Defined cases. A null text has no tokens and isn't packed; nor is an empty one. A very long text is cut into full bins and a
rest, all of it. Equal rows are packed once each; items of one length and equal (doc_id, key, piece) take their slots in either
order. A null doc_id is an id of its own, lowest in order. An empty table has no rows. Further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from byteloom.llm import common, token_counts

CAPACITY, END = 2048, 1
#: Items of one length, about, that are ranked in one task.
SALT_ROWS = 50_000


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, bins, items a bin, first bin, offset) of best-fit decreasing over {length: items}."""
    out: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[list[int]]] = {}  # room left: [first bin, bins] in the order in which they came
    rooms: list[int] = []
    bins = 0

    def leave(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append([first, n])

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left > 0:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                group = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(i)
            else:
                room = capacity
                group = [bins, -(-left // (capacity // length))]
                bins += group[1]
            each = room // length
            full = min(group[1], left // each)
            if full:
                out.append((length, rank, full, each, group[0], capacity - room))
                leave(room - each * length, group[0], full)
                rank, left = rank + full * each, left - full * each
            if full < group[1]:
                rest = group[0] + full, group[1] - full
                if 0 < left < each:
                    out.append((length, rank, 1, left, rest[0], capacity - room))
                    leave(room - left * length, rest[0], 1)
                    leave(room, rest[0] + 1, rest[1] - 1)
                    rank, left = rank + left, 0
                else:
                    leave(room, *rest)
    return out


def packed(lengths: DataFrame, capacity: int = CAPACITY, salt_rows: int = SALT_ROWS) -> DataFrame:
    """doc_id, piece, token_start, n_places, bin, offset for lengths (doc_id, k, n): n places from the start of a document.

    The pieces of a document are numbered from 0; piece i starts at its place i * capacity.
    """
    spark = lengths.sparkSession
    # The histogram and the ranks both need the lengths, which are dear to count and small to keep.
    lengths = common.cut(lengths.where("n > 0"))
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int")))
    parts = lengths.select("doc_id", "k", "n", piece.alias("piece"))
    parts = parts.withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece").cast("long") * capacity).cast("int"))
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    # Both tables have at most as many rows as a bin has places.
    salts = spark.createDataFrame([(n, -(-c // salt_rows)) for n, c in histogram.items()], "length int, salts long")
    parts = parts.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("k", "piece"), "salts")).drop("salts")
    by_salt = common.cut(parts.groupBy("length", "salt").count())
    schema = "length int, first long, bins long, each long, first_bin long, offset int"
    slots = spark.createDataFrame(plan(histogram, capacity), schema)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = by_salt.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "k", "piece")) - 1
    ranked = parts.withColumn("rank", rank).join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    # The plan's size depends on the capacity only.
    s = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    found = ranked.join(s, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("bins") * F.col("each")))
    nth = F.col("rank") - F.col("first")
    return found.select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("token_start"),
        F.col("length").alias("n_places"),
        (F.col("first_bin") + F.floor(nth / F.col("each"))).alias("bin"),
        (F.col("offset") + nth % F.col("each") * F.col("length")).cast("int").alias("offset"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str = token_counts.VOCABULARY) -> DataFrame:
    """The places of all documents, as ``packed`` has them, counted by a vocabulary file of ranks."""
    counts = token_counts.token_counts(docs, id_col, text_col, vocabulary)
    return packed(counts.where("n_tokens > 0").select("doc_id", "k", (F.col("n_tokens") + end).alias("n")), capacity)
