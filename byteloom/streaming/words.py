"""Counting the words of a stream of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from byteloom.config import Segmentation
from byteloom.operators import segment


def stream_word_counts(stream: DataFrame, config: Segmentation, path: str, checkpoint: str, content: str = "content") -> StreamingQuery:
    """Starts a query that writes the word counts of each batch of the stream to a folder of its own under path.

    A batch that is run again replaces what it wrote. ``word_counts`` adds the batches up.
    """
    if config.enabled and config.probability < 1:
        raise ValueError("a stream is cut at every delimiter run or at none")
    mode = config.mode if config.enabled else "none"

    def write(batch: DataFrame, number: int) -> None:
        words = batch.select(F.explode(segment.runs(F.col(content), mode)).alias("word"))
        words.groupBy("word").agg(F.count("*").alias("weight")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """word, weight of all the batches written to path so far."""
    return spark.read.schema("word string, weight long, batch long").parquet(path).groupBy("word").agg(F.sum("weight").alias("weight"))
