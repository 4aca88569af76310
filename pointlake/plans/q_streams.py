"""Queries that run a stream over what there is, then stop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from .registry import query
from .registry import work_folder as _work


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, sf):
    return jobs.counts(spark, jobs.stream_of(spark, f"{sf}/events.parquet").select("event_type"), ["event_type"], _work(spark))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest(spark, sf):
    s = jobs.stream_of(spark, f"{sf}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    return jobs.latest(spark, s, "user_id", ["ts", "event_id"], _work(spark)).select("user_id", "event_id", "event_type")


@query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Tumbling windows with a watermark wide enough that no row is late."""
    work = _work(spark)
    s = jobs.stream_of(spark, f"{sf}/events.parquet").select("ts", "event_type")
    w = jobs.windowed(s, "ts", ["event_type"], "6 hours", late="3650 days").select("start", "event_type", "n")
    jobs.run_once(w, f"{work}/checkpoint", jobs.merged_table(spark, f"{work}/table", ["start", "event_type"], "n"))
    return jobs.current(spark, f"{work}/table", ["start", "event_type"], [F.col("n")]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
