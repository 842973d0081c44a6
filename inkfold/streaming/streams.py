"""Streaming forms: exact deduplication, scoring by micro-batch, event-time counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkfold.functions.strings import plain_tokens
from inkfold.operators.dedup import normalized_lines
from inkfold.operators.scoring import fluency_parts


def dedup_stream(lines: DataFrame, text: str = "text", time: str | None = None, within: str = "1 hour") -> DataFrame:
    """The first row of each normalised text, blank ones left out. With an event time the state is bounded by the watermark; without one it is kept for ever."""
    hashed = normalized_lines(lines, text).withColumn("__h", F.md5(F.col(text).cast("binary")))
    if time is None:
        return hashed.dropDuplicates(["__h"]).drop("__h")
    return hashed.withWatermark(time, within).dropDuplicatesWithinWatermark(["__h"]).drop("__h")


def score_batch(requests: DataFrame) -> DataFrame:
    """Fluency parts of one micro-batch of (chat_id, prompt_idx, text)."""
    texts = requests.where(F.trim("text") != "")
    words = texts.select("chat_id", F.explode(plain_tokens(F.col("text"))).alias("word"))
    return fluency_parts(texts, words)


def score_stream(requests: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs score_batch on every micro-batch and hands the result to the sink with the batch's number, which makes repeats harmless."""
    return requests.writeStream.foreachBatch(lambda df, n: sink(score_batch(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n, total) by tumbling window, with late rows dropped beyond the watermark."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def stream_of(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
