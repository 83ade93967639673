"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to numpy at once; a longer text makes a piece of its own.
PIECE_BYTES = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, in local mode, a temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        have = sc._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends at most so many rows of text to Python at once, unless the session has a setting of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, marked for broadcasting if its rows - of a few numbers each - are counted and no more than most."""
    return F.broadcast(df) if df.count() <= most else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64 bits of a row's id and text: rows that agree in both are one document."""
    return F.xxhash64(df[id_col].isNull(), df[id_col], df[text_col].isNull(), df[text_col])


def pieces(batches: Iterable[pa.RecordBatch], text: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose column no. text holds about limit bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size, dtype=np.int64), 0
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column with a NUL after each row, and each row's start and end; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lens = np.diff(offsets)
    starts = offsets[:-1] - offsets[0] + np.arange(len(lens))
    out = np.zeros(len(data) + len(lens), np.uint8)
    keep = np.ones(len(out), bool)
    keep[starts + lens] = False
    out[keep] = data
    return out, np.stack([starts, starts + lens])
