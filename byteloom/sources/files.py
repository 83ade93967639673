"""Binary files as sequences: (source, chunk_index, content).

Inputs are paths that all machines see, or URIs that pyarrow's file systems open (file, hdfs, s3, gs). Files that are cut
into chunks are read in ranges, so they can have any size, and one large file keeps all cores busy.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.config import Ingest


#: Bytes of a file that one task reads at once, and most tasks.
RANGE, MOST_PARTITIONS = 64 << 20, 100_000


def list_paths(inputs: Iterable[str], config: Ingest = Ingest()) -> list[str]:
    """The files under the inputs in sorted order. A missing input is an error, and so is finding no file."""
    out: list[str] = []
    for item in inputs:
        if "://" in item:
            system, path = fs.FileSystem.from_uri(item)
            info = system.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(item)
            start = item[: len(item) - len(path)] if item.endswith(path) else item.split("://")[0] + "://"
            found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=config.recursive))
            out += [start + f.path for f in found if f.is_file]
        elif os.path.islink(item) and not config.follow_symlinks:
            raise ValueError(f"{item} is a symbolic link; set follow_symlinks to read it")
        elif os.path.isfile(item):
            out.append(item)
        elif os.path.isdir(item):
            for folder, folders, files in os.walk(item, followlinks=config.follow_symlinks):
                paths = (os.path.join(folder, f) for f in files)
                out += [p for p in paths if config.follow_symlinks or not os.path.islink(p)]
                if not config.recursive:
                    folders.clear()
        else:
            raise FileNotFoundError(item)
    if not out:
        raise ValueError("the inputs have no files")
    return sorted(out)


def chunks_of(content: Column, size: int) -> Column:
    """An array of pieces of size bytes, the last one shorter; of nothing for no bytes. Size 0 keeps all in one."""
    n = F.octet_length(content)
    if size == 0:
        return F.when(n > 0, F.array(content)).otherwise(F.array().cast("array<binary>"))
    at = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    # sequence(0, -1) would count down.
    return F.when(n > 0, F.transform(at, lambda i: F.substring(content, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def chunked(df: DataFrame, size: int, content: str = "content") -> DataFrame:
    """df with its content cut into chunks, and their chunk_index."""
    others = [c for c in df.columns if c != content]
    return df.select(*others, F.posexplode(chunks_of(F.col(content), size)).alias("chunk_index", content))


def _whole(spark: SparkSession, inputs: Iterable[str], config: Ingest) -> DataFrame:
    # The JVM may have another working folder.
    return spark.read.format("binaryFile").load([p if "://" in p else os.path.abspath(p) for p in list_paths(inputs, config)])


def _sizes(paths: list[str]) -> list[tuple[str, int]]:
    return [(p, fs.FileSystem.from_uri(p)[0].get_file_info(fs.FileSystem.from_uri(p)[1]).size if "://" in p else os.path.getsize(p)) for p in paths]


def binary_files(spark: SparkSession, inputs: Iterable[str], config: Ingest = Ingest(), range_bytes: int = RANGE) -> DataFrame:
    """source, chunk_index, content of files and folders. With chunk size 0 a file is one row, of up to 2 GiB."""
    size = config.chunk_size
    if size == 0:
        return chunked(_whole(spark, inputs, config).select(F.col("path").alias("source"), "content"), 0)
    step = max(1, range_bytes // size)  # chunks of a range
    files = [(p if "://" in p else os.path.abspath(p), n) for p, n in _sizes(list_paths(inputs, config)) if n]
    ranges = sum(-(-n // (step * size)) for _, n in files)
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / (step * size)))).alias("range")
    parts = spark.createDataFrame(files, "path string, n long").select("path", at).repartition(max(1, min(ranges, MOST_PARTITIONS)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                source = path if "://" in path else f"file:{path}"
                with system.open_input_file(inner) as f:
                    f.seek(k * step * size)
                    some = max(1, (1 << 20) // size)
                    for first in range(k * step, (k + 1) * step, some):
                        data = f.read(min(some, (k + 1) * step - first) * size)
                        if not data:
                            break
                        pieces = [data[i : i + size] for i in range(0, len(data), size)]
                        numbers = pa.array(range(first, first + len(pieces)), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([source] * len(pieces)), numbers, pa.array(pieces, pa.binary())], ["source", "chunk_index", "content"])

    return parts.mapInArrow(read, "source string, chunk_index long, content binary")


def totals(spark: SparkSession, inputs: Iterable[str], config: Ingest = Ingest()) -> DataFrame:
    """total_chunks and total_bytes, from the lengths of the files alone."""
    files = _whole(spark, inputs, config).where("length > 0")
    chunks = F.ceil(F.col("length") / config.chunk_size) if config.chunk_size else F.lit(1)
    return files.agg(F.coalesce(F.sum(chunks), F.lit(0)).cast("long").alias("total_chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))


def export_texts(df: DataFrame, path: str, text: str = "text", order: str | None = None) -> None:
    """Writes texts into text files, an empty line after each; in the order of a column over all files, if one is given. Nulls are left out."""
    rows = df.where(F.col(text).isNotNull())
    rows = rows.orderBy(order) if order else rows
    rows.select(F.concat(text, F.lit("\n"))).write.text(path)


def in_memory(spark: SparkSession, sequences: Iterable[bytes]) -> DataFrame:
    """content of sequences at hand."""
    return spark.createDataFrame([(bytearray(s),) for s in sequences], "content binary")
