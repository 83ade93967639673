"""Training: segmentation and counts on Spark, then the merge loop on Spark or, for few distinct words, in memory.

The loop on Spark keeps the words in blocks (``operators.blocks``) and the counts of their different pairs on the driver,
decides there, rewrites the blocks, and takes in how the counts changed. Several merges are decided in one round where that
can't differ from one at a time: the next pair q, after merges (a, b) of this round, shares no end with them (its first
token isn't b, its last isn't a), and its count is above that of every pair (x, a) and (b, y) that stands in the words, so
that no pair with a new token can outrank it.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom import layout
from byteloom.checkpoints import cut, flat
from byteloom.config import TrainerConfig
from byteloom.model import Model
from byteloom.operators import blocks, kernel, segment

#: Distinct words, and characters in them, up to which "auto" trains in memory.
MEMORY_WORDS, MEMORY_CHARS = 2_000_000, 50_000_000
#: Rounds between two cuts of the lineage.
CUT_EVERY = 24


def _loop(words: DataFrame, found: blocks.Layout, config: TrainerConfig, batch: int | None = None, weighted: bool = True) -> kernel.Trained:
    """The merges of words (word binary, weight), whose blocks stay on the executors; the driver holds the pairs' counts."""
    decider = kernel.Decider(config)
    base, size = config.base_size, found.size
    # Tokens of the codes.
    ids = np.concatenate([[0], found.alphabet + layout.FIRST_BYTE, np.arange(base, base + size - found.bytes)]).astype(np.int64)
    rejected: set[int] = set()
    counts: dict[int, int] = {}
    unknown: dict[int, int] = {}  # code of a merge whose number of places isn't known yet, and its rank
    rounds = 0
    state = blocks.packed(words, found, weighted).persist()

    def told(state: DataFrame) -> None:
        for pair, n in zip(*(x.tolist() for x in blocks.changes(state))):
            if pair < 0:
                if (rank := unknown.pop(-1 - pair, None)) is not None:
                    decider.out.metrics[rank]["merges_applied"] = n
            elif left := counts.get(pair, 0) + n:
                counts[pair] = left
            else:
                del counts[pair]

    told(state)
    stop = decider.full()
    while True:
        taken: list[tuple[int, int, int]] = []
        if stop is None:
            pair, n = (np.fromiter(x, np.int64, len(counts)) for x in (counts.keys(), counts.values()))
            order = np.argsort(-n, kind="stable")
            pair, n = pair[order], n[order]
            some = np.lexsort((pair, -n))
            limit = 0
            for p, m in zip(pair[some].tolist(), n[some].tolist()):
                if m < config.min_frequency:
                    break
                a, b = divmod(p, size)
                tokens = (int(ids[a]), int(ids[b]))
                if p in rejected or not decider.fits(tokens):
                    continue
                if taken and (m <= limit or any(a == y or b == x for x, y, _ in taken)):
                    break
                stop = decider.full()
                if stop or (batch is not None and len(taken) >= batch):
                    break
                verdict = decider.judge(tokens, m)
                if verdict == "stop":
                    stop = kernel.PLATEAU
                    break
                if verdict == "reject":
                    rejected.add(p)
                    continue
                # Pairs are counted once a round, so this is their number before its first merge.
                code = found.bytes + decider.merge(tokens, m, m, len(counts)) - base
                if a == b:  # overlaps: aaa has two pairs and one merge
                    unknown[code] = code - found.bytes
                taken.append((a, b, code))
                limit = max(limit, _outranking(decider, ids, pair, n, taken))
            if stop is None and not taken:
                stop = kernel.NO_PAIRS
            stop = stop or decider.full()
        if stop is not None and not unknown:
            break
        rounds += 1
        new = blocks.merged(flat(state), taken, found)
        new = (cut(new) if rounds % CUT_EVERY == 0 else new).persist()
        told(new)
        state.unpersist()
        state = new
    state.unpersist()
    return decider.done(stop)


def _outranking(decider: kernel.Decider, ids: np.ndarray, pair: np.ndarray, n: np.ndarray, taken: list[tuple[int, int, int]]) -> int:
    """The most that a pair with the token of the last merge taken can count; pairs that are turned down don't count, unless for a plateau.

    A neighbour is the token that stands there, or one that a merge of this round makes of it. pair and n: the counts, falling.
    """
    tokens, size = decider.out.tokens, len(ids)
    a, b, c = taken[-1]
    best = 0
    for beside, own in ((pair % size == a, 0), (pair // size == b, 1)):
        at = np.flatnonzero(beside)
        for p, m in zip(pair[at].tolist(), n[at].tolist()):
            if m <= best:
                break
            other = p % size if own else p // size
            others = [other, *(t[2] for t in taken if t[1 - own] == other)]
            if decider.config.plateau or any(decider.wanted((int(ids[c]), int(ids[o])) if own else (int(ids[o]), int(ids[c]))) for o in others):
                best = m
    return best


def _joined(words: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, joined, and the length of each."""
    column = words.combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer((column.buffers()[2] if len(column) else None) or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def finished(trained: kernel.Trained, config: TrainerConfig, pad: bool = True) -> Model:
    tokens = trained.tokens + (kernel.padding(trained.tokens, config.vocab_size) if pad else [])
    return Model(tokens, trained.merges, config, trained.metrics, trained.stop_reason, trained.seconds)


def train_on_words(words: DataFrame, config: TrainerConfig, engine: str = "auto", batch: int | None = None) -> Model:
    """A model from words (Latin-1 word, weight). engine is spark, memory, or auto: in memory if the words are few."""
    rows = words.select(F.encode("word", "ISO-8859-1").alias("word"), F.col("weight").cast("long").alias("weight"))
    return _trained(rows, config, engine, batch)


def _trained(rows: DataFrame, config: TrainerConfig, engine: str, batch: int | None, weighted: bool = True) -> Model:
    """A model from words (word binary, weight). Words without weights are as large as their source, and read again instead of kept."""
    if config.merge_budget < 1:
        raise ValueError("the vocabulary has no room for a merge")
    if engine not in ("auto", "spark", "memory"):
        raise ValueError("engine is auto, spark or memory")
    rows = rows.persist() if weighted else rows
    n, chars, alphabet = blocks.totals(rows)
    if not n:
        raise ValueError("there is nothing to train on")
    if engine == "memory" or (engine == "auto" and n <= MEMORY_WORDS and chars <= MEMORY_CHARS):
        found = rows.where(F.octet_length("word") > 1).toArrow()
        trained = kernel.train_arrays(*_joined(found.column(0)), found.column(1).to_numpy(), config)
    else:
        trained = _loop(rows, blocks.Layout(alphabet, config.merge_budget), config, batch, weighted)
    if weighted:
        rows.unpersist()
    return finished(trained, config)


def train(sequences: DataFrame, config: TrainerConfig, content: str = "content", sequence: str | None = None, engine: str = "auto", batch: int | None = None) -> Model:
    """A model from sequences of bytes; empty ones are skipped."""
    if not config.segmentation.enabled:
        # Whole sequences repeat little, so they aren't shuffled to be counted: equal ones add up all the same.
        rows = sequences.select(F.col(content).alias("word"), F.lit(1).cast("long").alias("weight")).where(F.octet_length("word") > 0)
        return _trained(rows, config, engine, batch, weighted=False)
    return train_on_words(segment.words(sequences, config.segmentation, content, sequence), config, engine, batch)


def train_on_union(parts: Iterable[DataFrame], config: TrainerConfig, **options: object) -> Model:
    """A model from several sources together."""
    both = None
    for p in parts:
        both = p.select("content") if both is None else both.unionByName(p.select("content"))
    if both is None:
        raise ValueError("there is nothing to train on")
    return train(both, config, **options)
