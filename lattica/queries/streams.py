"""Streaming programs, run over the events table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lattica.store import shared_folder
from lattica.streaming import windows

from .common import prepare


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return windows.replay(spark, f"{sf_dir}/events.parquet")


def _plain_times(df: DataFrame) -> DataFrame:
    return df.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes))


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.run_to_end(windows.window_counts(_stream(spark, sf_dir), "1 hour"), "tumbling")
    return _plain_times(df).withColumn("total", F.round("total", 2))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.run_to_end(windows.window_counts(_stream(spark, sf_dir), "2 hours", "1 hour"), "sliding")
    return _plain_times(df).withColumn("total", F.round("total", 2))


def update_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row that each key was updated to."""
    counts = _stream(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    df = windows.run_to_end(counts, "update", "update")
    return df.groupBy("event_type").agg(F.max_by("n", "batch__").alias("n"))


def append_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.run_to_end(_stream(spark, sf_dir).where("event_type = 'click'").select("event_id", "user_id"), "append", "append")
    return df.drop("batch__")


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _stream(spark, sf_dir)
    df = windows.run_to_end(windows.distinct_events(stream.unionAll(stream)).select("event_id"), "distinct", "append")
    return df.drop("batch__")


def keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State kept by user in a function; the last update of each user."""
    df = windows.run_to_end(windows.running_totals(_stream(spark, sf_dir)), "state", "update")
    last = df.groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "batch__").alias("s"))
    return last.select("user_id", "s.n", F.round("s.total", 2).alias("total"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.run_to_end(windows.session_counts(_stream(spark, sf_dir), "1 hour"), "sessions")
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


def memory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result kept in a table in memory, by the query's name."""
    name = f"kept_{uuid.uuid4().hex[:8]}"
    counts = _stream(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query's handle and a listener tell of it."""
    seen: list[str] = []

    class Told(StreamingQueryListener):
        def onQueryStarted(self, event):
            seen.append("started")

        def onQueryProgress(self, event):
            pass

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            seen.append("failed" if event.exception else "ended")

    told, name = Told(), f"told_{uuid.uuid4().hex[:8]}"
    spark.streams.addListener(told)
    query = _stream(spark, sf_dir).where("value > 50").writeStream.format("noop").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(told)
    rows = sum(p["numInputRows"] for p in query.recentProgress)
    return spark.createDataFrame([(query.name == name, query.isActive, query.exception() is None, rows, ",".join(seen))], "named boolean, active boolean, sound boolean, n long, told string")


def idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who were idle for an hour before the watermark, ten minutes before the last event; the others stay in the state."""
    return windows.run_to_end(windows.idle_users(_stream(spark, sf_dir), "10 minutes", 3_600_000), "idle", "append").select("user_id", "n", F.floor(F.col("last_ms") / 1000).alias("last_s"))


WINDOWED = "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL {w} HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT date_trunc('hour', ts) - to_hours(k) AS s, event_type, value FROM events, {ks}) GROUP BY s, event_type"
PROGRAMS = {
    "stream_tumbling_window": (tumbling, WINDOWED.format(w=1, ks="(VALUES (0)) t(k)")),
    "stream_sliding_window": (sliding, WINDOWED.format(w=2, ks="(VALUES (0), (1)) t(k)")),
    "stream_update_mode": (update_mode, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "stream_append_mode": (append_mode, "SELECT event_id, user_id FROM events WHERE event_type = 'click'"),
    "stream_deduplicate": (deduplicated, "SELECT DISTINCT event_id FROM events"),
    "stream_keyed_state": (keyed_state, "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id"),
    "stream_state_timeout": (idle, "SELECT user_id, count(*) AS n, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 1 HOUR < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"),
    "stream_memory_sink": (memory_sink, "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type"),
    "stream_progress": (progress, "SELECT true AS named, false AS active, true AS sound, count(*) AS n, 'started,ended' AS told FROM events"),
    "stream_sessions": (sessions, "SELECT user_id, CAST(sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 1 HOUR THEN 1 ELSE 0 END) AS BIGINT) AS sessions, count(*) AS n FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id"),
}
QUERIES = {name: q for name, (q, _) in PROGRAMS.items()}
ORACLE_SQL = {name: text for name, (_, text) in PROGRAMS.items()}
