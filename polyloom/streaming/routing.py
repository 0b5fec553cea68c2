"""Texts that arrive as a stream, classified and routed as those of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from polyloom.functions.detect import detect_robust
from polyloom.functions.text import text_class


def classified(stream: DataFrame, available: list[str], text: str = "text") -> DataFrame:
    """The stream with class and language, without state: batches, retries and order don't matter."""
    kind = text_class(F.col(text))
    return stream.withColumn("class", kind).withColumn("language", F.when(F.col("class") == "translatable", detect_robust(F.col(text), available)))


def start(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each micro-batch in a folder of its own, overwritten if it is run again: exactly once, whatever fails in between."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, key, n by tumbling window; rows later than ``late`` behind the newest are dropped, and state older than that goes."""
    by = stream.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("window.start").alias("start"), key, "n")
