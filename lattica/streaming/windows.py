"""Streaming programs over events(ts, user_id, event_type, value)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.store import shared_folder


def replay(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream: all files of a folder, or one file by a pattern that only it fits."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    single = f"{folder}/[{name[0]}]{name[1:]}"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(single)


def window_counts(events: DataFrame, duration: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(window_start, window_end, event_type, n, total) by tumbling or sliding windows."""
    if watermark:
        events = _marked(events, watermark)
    window = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    grouped = events.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def _marked(events: DataFrame, watermark: str) -> DataFrame:
    """With a watermark on ts, which needs a time with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def session_counts(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, session_start, session_end, n) by sessions that end after a gap."""
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_events(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each event_id once; with a watermark the state stays bounded."""
    return _marked(events, watermark).dropDuplicatesWithinWatermark(["event_id"]) if watermark else events.dropDuplicates(["event_id"])


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total): state by user, updated with every batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def idle_users(events: DataFrame, watermark: str, gap_ms: int) -> DataFrame:
    """(user_id, n, last_ms) of users once the watermark has passed their last event by a gap: state with a
    timeout in event time, so it holds only users who are not idle yet."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_ms": [last]})
            return
        for pdf in batches:
            n, last = n + len(pdf), max(last, int(pdf["ms"].max()))
        state.update((n, last))
        state.setTimeoutTimestamp(last + gap_ms)

    marked = _marked(events, watermark).select("user_id", "ts", F.unix_millis("ts").alias("ms"))
    return marked.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, last_ms long", "n long, last_ms long", "append", "EventTimeTimeout")


def run_to_end(stream: DataFrame, label: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and read what it wrote: in complete mode the last result,
    else all rows of all batches with their batch number as `batch__`."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch__={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(stream.schema.add("batch__", "integer")).parquet(f"{base}/out")
    return found.drop("batch__") if mode == "complete" else found
