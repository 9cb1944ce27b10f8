"""Streams replayed in several batches give what one batch gives."""

import pytest
from pyspark.sql import functions as F

from lattica.streaming import windows


@pytest.fixture()
def parts(spark, data, tmp_path):
    path = str(tmp_path / "events.parquet")
    spark.read.parquet(f"{data}/events.parquet").repartition(4).write.parquet(path)
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_windows_over_batches(spark, parts):
    whole = spark.read.parquet(parts)
    got = windows.run_to_end(windows.window_counts(windows.replay(spark, parts), "1 hour").withColumn("total", F.round("total", 4)), "t")
    assert rows(got) == rows(windows.window_counts(whole, "1 hour").withColumn("total", F.round("total", 4)))


def test_state_is_kept_between_batches(spark, parts):
    got = windows.run_to_end(windows.running_totals(windows.replay(spark, parts)), "t", "update")
    assert got.select("batch__").distinct().count() == 4
    last = got.groupBy("user_id").agg(F.max("n").alias("n"))
    assert rows(last) == rows(spark.read.parquet(parts).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))


def test_duplicates_across_batches_and_watermark(spark, parts):
    stream = windows.replay(spark, parts)
    twice = stream.unionAll(stream)
    n = spark.read.parquet(parts).count()
    assert windows.run_to_end(windows.distinct_events(twice).select("event_id"), "t", "append").count() == n
    assert windows.run_to_end(windows.distinct_events(twice, "3650 days").select("event_id"), "t", "append").count() == n
    late = windows.run_to_end(windows.window_counts(stream, "1 hour", watermark="3650 days"), "t", "update")
    assert late.count() > 0
