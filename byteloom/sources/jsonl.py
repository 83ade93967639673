"""JSON lines, plain or gzipped, and lists of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_spec(spec: str) -> tuple[str, list[str]]:
    """Path and fields of PATH:FIELD[.FIELD...]; the last colon divides."""
    path, colon, fields = spec.rpartition(":")
    names = [f.strip() for f in fields.split(".") if f.strip()]
    if not colon or not path or not names:
        raise ValueError(f"a JSON-lines input is PATH:FIELD, not {spec!r}")
    return path, names


def _path(fields: list[str]) -> str:
    return "$" + "".join(f if f.startswith("[") else "." + f if "[" in f else f"['{f}']" for f in fields)


def extract_field(line: Column, fields: list[str]) -> Column:
    """The string at a path of a JSON text. A line that isn't JSON, a missing field or another type is an error."""
    value = F.variant_get(F.try_parse_json(line), _path(fields), "variant")
    kind = F.schema_of_variant(value)
    good = F.when(kind == "STRING", F.variant_get(F.try_parse_json(line), _path(fields), "string"))
    text = F.concat(F.lit(f"no string at {'.'.join(fields)} in: "), F.substring(line, 1, 200))
    return F.coalesce(good, F.raise_error(text).cast("string"))


def jsonl(spark: SparkSession, spec: str, partitions: int | None = None) -> DataFrame:
    """source, content: a sequence for each line's field; blank lines and empty strings are skipped.

    The codec follows from the file's name. Gzip can't be split: give partitions to spread what follows.
    """
    path, fields = parse_spec(spec)
    lines = spark.read.text(path).where(F.trim("value") != "")
    if partitions:
        lines = lines.repartition(partitions)
    out = lines.select(F.col("_metadata.file_path").alias("source"), F.encode(extract_field(F.col("value"), fields), "UTF-8").alias("content"))
    return out.where(F.octet_length("content") > 0)


def token_lists(text: Column) -> Column:
    """Ids written with white space between; an item that is no number is an error."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
