"""Training by chunks: a model for each distinct chunk, and one vocabulary combined from all of them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom import layout
from byteloom.config import TrainerConfig
from byteloom.model import Model
from byteloom.operators import blocks, kernel, segment, small, stats
from byteloom.plans.train import finished

MODES = ("first", "frequency", "support", "entropy")
DUPLICATES = ("unique", "count")
_MERGE = pa.struct([("rank", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("best_frequency", pa.int64()), ("merges_applied", pa.int64())])
_RESULT = "byte_len long, entropy double, vocab_size int, stop_reason string, merges array<struct<rank:int,left:binary,right:binary,best_frequency:bigint,merges_applied:bigint>>"
#: Bytes of chunks that are cut at once.
_SOME = 1 << 20


@dataclass
class ChunkResult:
    """model; stats of the combination; chunks: a row for each chunk that was combined; report: all of it as JSON."""

    model: Model
    stats: dict
    chunks: DataFrame
    report: dict
    kept: list[DataFrame] = field(default_factory=list)

    def unpersist(self) -> None:
        """Lets go of the chunks' results, which are cached."""
        for df in self.kept:
            df.unpersist()

    def report_json(self) -> str:
        return json.dumps(self.report, indent=2)


def trained_chunks(rows: DataFrame, config: TrainerConfig, low: float | None = None, high: float | None = None) -> DataFrame:
    """index, hash, byte_len, entropy, vocab_size, stop_reason, merges for chunks (index, hash, content, seq) that aren't empty.

    Each is trained where it is read, also one that others equal: that costs less than to shuffle all contents. Chunks
    outside the entropy bounds get no merges. seq, as text, draws where runs glue.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = small.SmallTrainer(config)
        for b in batches:
            entropy = stats.entropies(b.column(2))
            data, at = blocks.values(b.column(2))
            size = np.diff(at)
            inside = (entropy >= (-np.inf if low is None else low)) & (entropy <= (np.inf if high is None else high))
            seqs = b.column(3).to_pylist()
            found: list[tuple] = []
            for a, z in blocks.slices(at, _SOME):
                part, offsets = data[at[a] : at[z]], at[a : z + 1] - at[a]
                edges = segment.bounds(part, offsets, config.segmentation, seqs[a:z])
                first = np.searchsorted(edges, offsets)
                for i in range(z - a):
                    own = edges[first[i] : first[i + 1] + 1]
                    found.append(trainer.train(part[offsets[i] : offsets[i + 1]], own - own[0]) if inside[a + i] else ([], None))
            merges = [m for ms, _ in found for m in ms]
            counts = np.array([len(ms) for ms, _ in found], np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)])
            columns = [*zip(*merges)] or [()] * 4
            ranks = np.arange(len(merges)) - np.repeat(ends[:-1], counts)
            flat = pa.StructArray.from_arrays([pa.array(ranks, pa.int32()), *(pa.array(c, f.type) for c, f in zip(columns, [*_MERGE][1:]))], fields=[*_MERGE])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            # Padding fills the vocabulary.
            sizes = pa.array(np.full(len(found), config.vocab_size), pa.int32(), mask=~inside)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(entropy), sizes, pa.array([r for _, r in found], pa.string()), lists], names)

    names = ["index", "hash", "byte_len", "entropy", "vocab_size", "stop_reason", "merges"]
    kind = rows.schema["index"].dataType.simpleString()
    return rows.select("index", "hash", "content", "seq").mapInArrow(run, f"index {kind}, hash string, {_RESULT}")


def combined_merges(merges: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """left, right, total, weighted, support for merges (index, left, right, best_frequency) and weights (index, weight)."""
    if weights is None:
        weighted = merges.withColumn("weight", F.lit(1.0))
    else:
        n = weights.count()
        # Chunks are far fewer than merges; the planner knows their size.
        weighted = merges.join(weights.select("index", "weight"), "index", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0 / max(1, n))))
    return weighted.groupBy("left", "right").agg(
        F.sum("best_frequency").alias("total"), F.sum(F.col("best_frequency") * F.col("weight")).alias("weighted"), F.count("*").alias("support")
    )


def ordered(combined: DataFrame, mode: str, chunks: int) -> DataFrame:
    """The combined merges in the order in which a mode takes them; ties go by the bytes.

    Weighted counts are compared to six decimals: what lies beyond depends on the order in which they were added up.
    """
    length = F.octet_length("left") + F.octet_length("right")
    total, support, weighted = F.desc("total"), F.desc("support"), F.round("weighted", 6).desc()
    if mode == "entropy":
        combined = combined.where(F.col("support") >= (2 if chunks > 1 else 1))
    by = {"frequency": (total, support), "support": (support, total), "entropy": (weighted, support, total)}[mode]
    return combined.orderBy(*by, length, "left", "right")


def assembled(candidates: Iterable[tuple[bytes, bytes]], config: TrainerConfig) -> tuple[Model, dict]:
    """A model of the candidates in order; one whose sides aren't known yet waits for the next pass.

    No more candidates are drawn than it takes to fill the vocabulary, and only those that wait are held.
    """
    budget = config.merge_budget
    tokens = layout.base_tokens(config.trailing)
    ids = {t: i for i, t in enumerate(tokens)}
    merges: list[tuple[int, int]] = []
    duplicates, waiting = 0, candidates
    missing = 0
    while len(merges) < budget:
        later, grown = [], False
        for left, right in waiting:
            if len(merges) >= budget:
                break
            if left not in ids or right not in ids:
                later.append((left, right))
            elif left + right in ids:
                duplicates += 1
            else:
                merges.append((ids[left], ids[right]))
                ids[left + right] = len(tokens)
                tokens.append(left + right)
                grown = True
        waiting = later
        if not waiting or not grown:
            missing = len(waiting)
            break
    done = {"merges_requested": budget, "merges_realized": len(merges), "duplicates_skipped": duplicates, "missing_dependencies": missing}
    return Model(tokens, merges, config), done


def train_chunks(
    chunks: DataFrame, config: TrainerConfig, mode: str = "support", duplicates: str = "count", low: float | None = None, high: float | None = None, content: str = "content", index: str = "index"
) -> ChunkResult:
    """Trains the chunks of (index, content) and combines the merges.

    duplicates: with unique a chunk's repeats are skipped, with count each repeat is another sample. Chunks outside the
    entropy bounds are skipped. Plateaus don't stop chunk training.
    """
    if mode not in MODES or duplicates not in DUPLICATES:
        raise ValueError(f"mode is one of {MODES}, duplicates one of {DUPLICATES}")
    config = config.with_(plateau=False)
    rows = chunks.select(F.col(index).alias("index"), F.col(content).alias("content")).where(F.octet_length("content") > 0)
    if config.segmentation.enabled and config.segmentation.probability < 1:
        # Equal chunks draw as the first of them.
        rows = stats.deduplicated(rows, "index").withColumn("seq", F.col("first_index").cast("string"))
    else:
        rows = rows.withColumn("hash", F.sha2("content", 256)).withColumn("seq", F.lit(None).cast("string"))
    rows = trained_chunks(rows, config, low, high).persist()
    inside = F.lit(True)
    if low is not None:
        inside &= F.col("entropy") >= low
    if high is not None:
        inside &= F.col("entropy") <= high
    # Equal chunks have equal entropies.
    groups = rows.groupBy("hash", "entropy").agg(F.count("*").alias("n"), F.min("index").alias("index"))
    seen = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("seen"),
        F.count("*").alias("distinct"),
        F.count_if(F.col("entropy") < (low if low is not None else -1.0)).alias("low"),
        F.count_if(F.col("entropy") > (high if high is not None else 99.0)).alias("high"),
        F.coalesce(F.sum(F.when(inside, F.col("n") - 1)), F.lit(0)).alias("repeats"),
    ).first()
    samples = rows.where(inside)
    if duplicates == "unique":
        samples = samples.join(groups.select("hash", "index"), ["hash", "index"], "left_semi")
    samples = samples.persist() if duplicates == "unique" else samples
    n = samples.count()
    if not n:
        raise ValueError("no chunk is left to train on")
    weights = stats.chunk_weights(samples.select("index", "byte_len", "entropy"))
    if mode == "first":
        head = samples.orderBy("index").first()
        tokens = layout.base_tokens(config.trailing)
        ids = {t: i for i, t in enumerate(tokens)}
        merges = []
        for m in head["merges"]:
            left, right = bytes(m["left"]), bytes(m["right"])
            merges.append((ids[left], ids[right]))
            ids[left + right] = len(tokens)
            tokens.append(left + right)
        trained = kernel.Trained(tokens, merges, [], head["stop_reason"])
        model = finished(trained, config)
        done = {"merges_requested": config.merge_budget, "merges_realized": len(model.merges), "duplicates_skipped": 0, "missing_dependencies": 0}
    else:
        merges = samples.select("index", F.explode("merges").alias("m")).select("index", "m.left", "m.right", "m.best_frequency")
        take = ordered(combined_merges(merges, weights if mode == "entropy" else None), mode, n)
        model, done = assembled(((bytes(r["left"]), bytes(r["right"])) for r in take.select("left", "right").toLocalIterator()), config)
    summary = samples.select("index", "byte_len", F.col("entropy").alias("entropy_bits"), "vocab_size", F.size("merges").alias("merge_count"), "merges")
    report = {
        "combine_mode": mode,
        "duplicate_mode": duplicates,
        "processed_chunks": seen["seen"],
        "total_chunks": n,
        "unique_chunks": seen["distinct"],
        "skipped_low_entropy": seen["low"],
        "skipped_high_entropy": seen["high"],
        "duplicates_skipped": seen["repeats"] if duplicates == "unique" else 0,
        "duplicates_reused": seen["repeats"] if duplicates == "count" else 0,
        "combine_stats": done,
    }
    return ChunkResult(model, done, summary, report, [rows, samples] if duplicates == "unique" else [rows])


def chunk_reports(result: ChunkResult) -> Iterator[str]:
    """The rows of the chunks as JSON texts, in order."""
    names = ("index", "byte_len", "entropy_bits", "vocab_size", "merge_count")
    merge = "transform(merges, m -> named_struct('iteration', m.rank + 1, 'left', hex(m.left), 'right', hex(m.right), 'best_frequency', m.best_frequency, 'merges_applied', m.merges_applied)) as merges"
    rows = result.chunks.selectExpr(*names, merge)
    for r in rows.orderBy("index").select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        yield r["j"]
