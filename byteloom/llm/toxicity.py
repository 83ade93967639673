"""Toxic documents by subword-bag embeddings under a linear softmax.

A text is the bag of the 4- to 7-byte n-grams of its lower-cased words, a boundary on each side included. Every n-gram's
hash has an embedding; their average goes into a linear softmax with two classes. Embeddings and softmax are trained
jointly in numpy (Adam) on every labelled document. As both layers are linear, an n-gram's share in the
logit is one number once they are trained. A document's score is the probability of its worst window of ``WINDOW``
words, so that a long text can't dilute an insult; every window of the whole text counts. Training begins with whole
texts; in ``ROUNDS`` further rounds the worst window that each training text has so far is added under the text's label,
which sharpens the weights on what makes a window toxic. A word that repeats the one before it counts once, or a window
of one word over and over would rest on a few n-grams. The threshold is set on labelled documents held out of it all,
a fifth of each class, by the F1 of every score that they have.

Labelled documents lie in shards of about ``SHARD`` by the hash of their ids. In a round each shard goes on from the
parameters that all share, by itself, over all its documents; then every parameter moves by the mean of what the shards
moved it by, each weighted by the number of its steps that touched it. With one shard that is training in one place. The
driver holds the parameters alone, whatever the number of documents and labels.

Defined cases. A null or empty text, or one without words, has no score and isn't toxic. Repeated labels of a document
count as toxic if one does. A labelled id is one example: of documents with one labelled id the least text is learned from. Labels
that are null are ignored; with no label of one of the classes nothing is toxic. If holding out would leave a class with no
document to learn from or none to judge by, none is held out, and the threshold is set on those that were learned from.
Repeated rows are scored alike. A score equal to the threshold isn't toxic; of equal windows the first is the worst. Very long
texts are scored in all their windows. An empty table of documents has no rows, and with it, or with no labels, there is no
model and nothing is toxic. A null id is kept and never labelled. Further columns are ignored, or kept as they are by
``filter_documents``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byteloom.llm import common, wordhash

#: Labelled ids of a shard, about; a new shard begins with each so many.
SHARD = 10_000
#: Whole texts are learned from in lots of about so many distinct n-grams, and stored in packs of about so many bytes.
LOT, PACK_BYTES = 4_000_000, 1 << 20
#: One in so many labelled documents of a class and shard is held out.
HELD = 5
#: Buckets whose parameters the shards send in one row.
BLOCK = 1 << 10
#: Bits for each labelled id in the table that tells most other ids apart, up to 8 MB.
FILTER = 8
BUCKETS, DIM, EPOCHS, BATCH, RATE = 1 << 18, 6, 3, 64, 0.03
WINDOW, ROUNDS = 6, 3
#: Least number of steps of each fit, for small samples.
STEPS = 150
GRAMS = (4, 5, 6, 7)


@dataclass(frozen=True)
class Model:
    """weight: each bucket's share in the logit; bias; threshold of the score."""

    weight: np.ndarray
    bias: float
    threshold: float


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Starts of the words, their ends, place of each row's first word, and for each n the places and buckets of n-grams."""
    data, rows = common.flat(texts)
    inside = ~wordhash.PUNCTUATION[data]
    start, end, h = wordhash.words(data, wordhash.PUNCTUATION)
    first = wordhash.by_row(start, rows)
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[first[:-1][first[:-1] < len(h)]] = True
    first = np.concatenate([[0], np.cumsum(new)])[first]
    start, end = start[new], end[new]
    # A boundary byte before and after all, so that every n-gram has room.
    more = GRAMS[-1]
    d = np.where(np.concatenate([[False], inside, [False] * more]), np.concatenate([[0], data, [0] * more]), 32).astype(np.uint32)
    ins = d != 32
    n_at = len(d) - more
    ok = ins[1 : 1 + n_at].copy()  # the byte inside that owns the n-gram
    g = d[:n_at] * np.uint32(0x01000193) + d[1 : 1 + n_at]
    out = []
    for n in range(3, GRAMS[-1] + 1):
        if n > 3:
            ok &= ins[n - 2 : n - 2 + n_at]
        g = g * np.uint32(0x01000193) + d[n - 1 : n - 1 + n_at]
        if n not in GRAMS:
            continue
        at = np.flatnonzero(ok)
        h = g[at] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out.append((at, (h >> np.uint32(14)).astype(np.int32)))
    return start, end, first, out


def _bag(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = np.sort(buckets)
    first = np.flatnonzero(np.diff(b, prepend=-1))
    return b[first], np.diff(first, append=len(b)).astype(np.float32)


def bags_of(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets of the n-grams of each lower-cased text, and how many fall in each."""
    start, grams = common.flat(texts)[1][0], _grams(texts)[3]
    cuts = [np.append(np.searchsorted(at, start), len(at)) for at, _ in grams]
    return [_bag(np.concatenate([bucket[cut[i] : cut[i + 1]] for (_, bucket), cut in zip(grams, cuts)])) for i in range(len(start))]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """bags_of one text."""
    return bags_of(pa.array([text]))[0]


class Windows:
    """All windows of some lower-cased texts: n, the number of rows; for each window its row, first byte and end; the n-grams."""

    def __init__(self, texts: pa.Array):
        start, end, first, self.grams = _grams(texts)
        size = int(end[-1]) + 2 if len(end) else 2
        # For each n, the first n-gram of every word and the one after its last.
        self.of_word = []
        for at, _ in self.grams:
            before = np.zeros(max(size, int(at[-1]) + 2 if len(at) else 0), np.int32)
            before[at + 1] = 1
            before = np.cumsum(before)
            self.of_word.append((before[start], before[end]))
        # Sums by word, without the words left out.
        self.count = np.concatenate([[0], np.cumsum(sum(y - x for x, y in self.of_word))])
        self.n = len(first) - 1
        n = np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        # A window starts at each word that has WINDOW words before the end of its row, else at the row's first word.
        at = np.arange(len(start))
        full = (at + WINDOW <= first[1:][row]) | (at == first[:-1][row])
        self.a, self.row = at[full], row[full]
        self.b = np.minimum(self.a + WINDOW, first[1:][self.row])
        self.start, self.end = start[self.a], end[np.maximum(self.b, 1) - 1]

    def mean(self, model: Model) -> np.ndarray:
        """The mean weight of each window."""
        total = np.zeros(len(self.count) - 1)
        for (_, bucket), (x, y) in zip(self.grams, self.of_word):
            sums = np.concatenate([[0], np.cumsum(model.weight[bucket], dtype=np.float64)])
            total += sums[y] - sums[x]
        total = np.concatenate([[0], np.cumsum(total)])
        return (total[self.b] - total[self.a]) / np.maximum(1, self.count[self.b] - self.count[self.a])


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """The greatest probability over the windows of each lower-cased text; NaN without words."""
    windows = Windows(texts)
    row, mean = windows.row, windows.mean(model)
    out = np.full(windows.n, np.nan)
    new = np.flatnonzero(np.diff(row, prepend=-1))
    if len(new):
        out[row[new]] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(mean, new) + model.bias, -50, 50)))
    return out


def learnable(texts: pa.Array) -> np.ndarray:
    """Whether a lower-cased text has an n-gram: two bytes of a word side by side, with a boundary on each side."""
    data, rows = common.flat(texts)
    inside = ~wordhash.PUNCTUATION[data]
    pairs = np.concatenate([[0], np.cumsum(inside[:-1] & inside[1:]), [0]])
    return pairs[rows[1]] > pairs[rows[0]]


def worst_windows(windows: Windows, model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """The features of the window of each text that scores highest."""
    mean, row = windows.mean(model), windows.row
    out = [_bag(np.zeros(0, np.int32))] * windows.n
    new = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
    worst = np.array([x + np.argmax(mean[x:y]) for x, y in zip(new[:-1].tolist(), new[1:].tolist())], int)
    cuts = [(np.searchsorted(at, windows.start[worst]), np.searchsorted(at, windows.end[worst])) for at, _ in windows.grams]
    for i, k in enumerate(worst):
        out[row[k]] = _bag(np.concatenate([bucket[x[i] : y[i]] for (_, bucket), (x, y) in zip(windows.grams, cuts)]))
    return out


class Trainer:
    """Embeddings of the buckets and a softmax over two classes, under Adam; it begins with params, or else by chance."""

    def __init__(self, seed: int | list[int] = 1, params: list[np.ndarray] | None = None):
        self.rng = np.random.default_rng(seed)
        if params is None:
            params = [self.rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), self.rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
        self.params = [p.copy() for p in params]
        self.m, self.v, self.step = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params], 0
        self.touched = np.zeros(BUCKETS, np.float32)  # by how many steps

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, balance: np.ndarray | None = None, steps: int | None = None) -> Model:
        """balance: the weight of a document of each class, by default such that both weigh alike in labels."""
        e, w, b = self.params
        epochs = max(epochs, -(-(STEPS if steps is None else steps) * BATCH // max(1, len(bags))))
        weight = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2))) if balance is None else balance
        seen, slot = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, np.int32)
        for _ in range(epochs):
            order = self.rng.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                part = order[k : k + BATCH]
                sizes = np.array([len(bags[i][0]) for i in part])
                every = np.concatenate([bags[i][0] for i in part])
                seen[every] = True
                ids = np.flatnonzero(seen)
                seen[ids] = False
                slot[ids] = np.arange(len(ids))
                inverse = slot[every]
                share = np.concatenate([bags[i][1] / bags[i][1].sum() for i in part])
                # The gradients of the two classes are opposite, so that one number an n-gram, or a text, stands for both.
                own, side = e.take(ids, axis=0), w[:, 1] - w[:, 0]
                z = np.add.reduceat((own @ side)[inverse] * share, np.cumsum(sizes) - sizes) + (b[1] - b[0])
                y = labels[part]
                p = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight[y] / len(part)).astype(np.float32)
                g = np.bincount(inverse, np.repeat(p, sizes) * share, len(ids)).astype(np.float32)
                up = own.T @ g
                grads = [g[:, None] * side, np.stack([-up, up], axis=1), np.array([-p.sum(), p.sum()])]
                self.step += 1
                self.touched[ids] += 1
                for j, g in enumerate(grads):
                    to = ids if j == 0 else np.arange(len(g))
                    m, v = self.m[j].take(to, axis=0), self.v[j].take(to, axis=0)
                    m += np.float32(0.1) * (g - m)
                    v += np.float32(0.01) * (g * g - v)
                    self.m[j][to], self.v[j][to] = m, v
                    m *= np.float32(RATE / (1 - 0.9**self.step))
                    v *= np.float32(1 / (1 - 0.99**self.step))
                    m /= np.sqrt(v) + np.float32(1e-8)
                    self.params[j][to] -= m
        return as_model(self.params)


def as_model(params: list[np.ndarray]) -> Model:
    e, w, b = params
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0]), 0.5)


def best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The threshold with the best F1, in the middle of the scores that it divides."""
    order = np.argsort(-score, kind="stable")
    s, y = score[order], label[order]
    hits = np.cumsum(y)
    f1 = np.where(np.append(s[:-1] > s[1:], True), 2 * hits / (np.arange(1, len(s) + 1) + y.sum()), -1)
    k = int(np.argmax(f1))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def fitted_threshold(scored: DataFrame) -> float:
    """best_threshold of the columns s and y, where only a few numbers of each partition come to the driver."""
    rows = common.cut(scored.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).orderBy(F.desc("s")).select("s", "n", "hits", F.spark_partition_id().alias("part")))
    parts = rows.groupBy("part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("s").alias("top")).orderBy("part").collect()
    total, n, hits, before = sum(p.hits for p in parts), 0, 0, {}
    for p, after in zip(parts, [*parts[1:], None]):
        before[p.part] = (n, hits, 0.0 if after is None else after.top)
        n, hits = n + p.n, hits + p.hits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        s, k, h = (got.column(i).to_numpy() for i in range(3))
        n, hits, after = before[got.column(3)[0].as_py()]
        f1 = 2 * (hits + np.cumsum(h)) / (n + np.cumsum(k) + total)
        at = int(np.argmax(f1))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64()) for x in (f1[at], s[at], s[at + 1] if at + 1 < len(s) else after)], ["f1", "s", "after"])

    best = max(rows.mapInArrow(run, "f1 double, s double, after double").collect(), key=lambda r: (r.f1, r.s))
    return (best.s + best.after) / 2


def _maybe_labelled(known: DataFrame, n: int) -> Column:
    """Whether an id, hashed in the column h, can be one of the n known: all known ids and some 5 % of others. So that few
    texts without a label are shuffled; a table of bits (two of FILTER for each id) of a bounded size."""
    size = 1 << min(26, max(10, (FILTER * n - 1).bit_length()))
    place = F.explode(F.array(*(F.shiftrightunsigned(F.xxhash64("id"), 32 * k).bitwiseAND(size - 1) for k in (0, 1))))
    words = known.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("x").to_numpy()

    def known_(h: pa.Array) -> pa.Array:
        h = h.to_numpy().view(np.uint64)
        out = np.ones(len(h), bool)
        for k in (0, 1):
            p = ((h >> np.uint64(32 * k)) & np.uint64(size - 1)).astype(np.int64)
            out &= (bits[p >> 6] >> (p & 63)) & 1 == 1
        return pa.array(out)

    return F.arrow_udf(known_, "boolean")(F.col("h"))


def _packed(docs: DataFrame, known: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """The labelled documents, each shard a partition: packs of text, class y, whether held out and whether it can be learned
    from, and for each pack the number of the latter by class and held: clean, toxic, clean held, toxic held."""
    texts = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col].cast(known.schema["id"].dataType)).alias("h"), docs[text_col].alias("t")).where("id is not null and length(t) > 0")
    texts = texts.where(_maybe_labelled(known, n)).select("id", F.lit(None).cast("int").alias("y"), F.lower("t").alias("t"))
    both = texts.unionByName(known.select("id", "y", F.lit(None).cast("string").alias("t"))).repartition(-(-n // SHARD), "id")
    rows = both.groupBy("id").agg(F.max("y").alias("y"), F.min("t").alias("t")).where("y is not null and t is not null").sortWithinPartitions(F.xxhash64("id"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for b in common.pieces(batches, 2, PACK_BYTES):
            y = b.column(1).to_numpy()
            if seen is None:  # another place to begin in each shard, so that few rows of a class aren't all held out
                seen = np.full(2, b.column(0)[0].as_py())
            place = np.where(y == 1, np.cumsum(y == 1) + seen[1], np.cumsum(y == 0) + seen[0])
            seen = seen + [np.sum(y == 0), np.sum(y == 1)]
            held, able = place % HELD == 0, learnable(b.column(2))
            pack = pa.RecordBatch.from_arrays([b.column(2).cast(pa.large_string()), pa.array(y), pa.array(held), pa.array(able)], ["t", "y", "held", "able"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pack.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(pack)
            counts = np.bincount(y[able] + 2 * held[able], minlength=4)
            yield pa.RecordBatch.from_arrays([b.column(0)[:1], pa.array([sink.getvalue().to_pybytes()], pa.binary()), *(pa.array([int(c)], pa.int64()) for c in counts)], ["shard", "pack", *COUNTS])

    return rows.select(F.spark_partition_id().alias("shard"), "y", "t").mapInArrow(run, f"shard int, pack binary, {', '.join(f'{c} long' for c in COUNTS)}")


COUNTS = ("clean", "toxic", "clean_held", "toxic_held")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each pack's shard and rows."""
    for batch in batches:
        for shard, pack in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield from ((shard, b) for b in pa.ipc.open_stream(pack.as_buffer()))


def _round(packed: DataFrame, params: list[np.ndarray], models: list[Model], hold: bool, balance: np.ndarray, steps: int) -> list[np.ndarray]:
    """The parameters after every shard went on from params: over whole texts, or over their worst windows by each of models."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, bags, labels, size, shard = None, [], [], 0, 0
        for shard, b in _unpacked(batches):
            trainer = trainer or Trainer([1, len(models), shard], params)
            use = b.column(3).to_numpy(zero_copy_only=False) & ~(hold & b.column(2).to_numpy(zero_copy_only=False))
            b = b.filter(pa.array(use))
            for part in common.pieces([b], 0):
                windows = Windows(part.column(0)) if models else None
                for some in [worst_windows(windows, m) for m in models] if models else [bags_of(part.column(0))]:
                    # Of a text with n-grams the window found may have none.
                    new = [(x, y) for x, y in zip(some, part.column(1).to_pylist()) if len(x[0])]
                    bags += [x for x, _ in new]
                    labels += [y for _, y in new]
                    size += sum(len(x[0]) for x, _ in new)
                if size > LOT:
                    trainer.fit(bags, np.array(labels), 2 if models else EPOCHS, balance, 0)
                    bags, labels, size = [], [], 0
        if bags:
            trainer.fit(bags, np.array(labels), 2 if models else EPOCHS, balance, 0 if trainer.step else steps)
        if trainer is None or not trainer.step:
            return
        moved = [new - old for new, old in zip(trainer.params, params)]
        for k in range(0, BUCKETS, BLOCK):
            at = np.flatnonzero(trainer.touched[k : k + BLOCK]).astype(np.int32)
            if len(at):
                yield _sent(k // BLOCK, shard, at, trainer.touched[k + at], moved[0][k + at])
        yield _sent(-1, shard, np.zeros(1, np.int32), np.float32([trainer.step]), np.concatenate([moved[1].ravel(), moved[2]])[None])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, weight = None, np.zeros(0), np.zeros(0)
        for batch in batches:
            for k, _, at, touched, moved in zip(*(c.to_pylist() for c in batch.columns)):
                at, touched = np.frombuffer(at, np.int32), np.frombuffer(touched, np.float32).astype(float)
                if k != block:
                    if block is not None:
                        yield _merged(block, total, weight)
                    block, total, weight = k, np.zeros((BLOCK, DIM) if k >= 0 else (1, 2 * DIM + 2)), np.zeros(BLOCK if k >= 0 else 1)
                total[at] += np.frombuffer(moved, np.float32).reshape(len(at), -1) * touched[:, None]
                weight[at] += touched
        if block is not None:
            yield _merged(block, total, weight)

    sent = packed.select("shard", "pack").mapInArrow(learn, "block int, shard int, at binary, touched binary, moved binary")
    rows = sent.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(merge, "block int, moved binary").collect()
    out = [p.copy() for p in params]
    for r in rows:
        moved = np.frombuffer(r.moved, np.float32)
        if r.block >= 0:
            out[0][r.block * BLOCK : (r.block + 1) * BLOCK] += moved.reshape(BLOCK, DIM)
        else:
            out[1] += moved[: 2 * DIM].reshape(DIM, 2)
            out[2] += moved[2 * DIM :]
    return out


def _sent(block: int, shard: int, at: np.ndarray, touched: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([block], pa.int32()), pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at, touched, moved))]
    return pa.RecordBatch.from_arrays(columns, ["block", "shard", "at", "touched", "moved"])


def _merged(block: int, total: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    moved = (total / np.maximum(1, weight)[:, None]).astype(np.float32)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([moved.tobytes()], pa.binary())], ["block", "moved"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model fitted on every labelled document; None without both classes."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    classes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        return None
    packed = common.cut(_packed(docs, known, sum(classes.values()), id_col, text_col))
    counts = np.array([x or 0 for x in packed.agg(*(F.sum(c) for c in COUNTS)).first()]).reshape(2, 2)
    hold = bool(counts.all())
    learned = counts[0] if hold else counts.sum(axis=0)
    if not learned.all():
        return None
    balance = learned.sum() / (2 * learned)
    params, models = Trainer().params, []
    for _ in range(1 + ROUNDS):
        params = _round(packed, params, models, hold, balance, STEPS)
        models = [*models, as_model(params)]
    model = models[-1]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _unpacked(batches):
            b = b.filter(b.column(2)) if hold else b
            for part in common.pieces([b], 0):
                s = scores(part.column(0), model)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64(), mask=np.isnan(s)), part.column(1)], ["s", "y"])

    scored = packed.select("shard", "pack").mapInArrow(judge, "s double, y int").where("s is not null").persist()
    threshold = fitted_threshold(scored)
    scored.unpersist()
    return Model(model.weight, model.bias, threshold)


def score_column(lowered: Column, model: Model) -> Column:
    """The score of a column of lower-cased texts."""

    def score(t: pa.Array) -> pa.Array:
        out = [scores(b.column(0), model) for b in common.pieces([pa.RecordBatch.from_arrays([t], ["t"])], 0)]
        value = np.concatenate(out) if out else np.zeros(0)
        return pa.array(value, pa.float64(), mask=np.isnan(value))

    return F.arrow_udf(score, "double")(lowered)


def toxic_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of the documents whose score is above the threshold."""
    out = docs.select(docs[id_col].alias("doc_id"), F.lower(docs[text_col]).alias("t"))
    if model is None:
        return out.select("doc_id", F.lit(None).cast("double").alias("score")).where(F.lit(False))
    return out.select("doc_id", score_column(F.col("t"), model).alias("score")).where(F.col("score") > model.threshold)


def filter_documents(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't toxic."""
    if model is None:
        return docs
    (score,) = common.fresh(docs, "toxicity_score")
    scored = docs.withColumn(score, score_column(F.lower(docs[text_col]), model))
    return scored.where(F.col(score).isNull() | (F.col(score) <= model.threshold)).drop(score)
