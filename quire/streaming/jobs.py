"""The job log as a stream: latest states, and jobs that outlive their hour (K1, K2).

The reference model has no streaming engine; this is the log of job events read as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "job_id STRING, status STRING, ts TIMESTAMP, original_name STRING, error STRING"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of job events, as a stream of the files that appear under path."""
    return spark.readStream.schema(EVENT_SCHEMA).json(path)


def latest_states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Per job and hour of the day: last status in it so far. State goes once the watermark has passed the hour."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "job_id").agg(F.max_by("status", "ts").alias("status"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


#: A job's hour, in milliseconds.
LIFETIME_MS = 3_600_000


def expiring_states(events: DataFrame, lifetime_ms: int = LIFETIME_MS, late: str = "10 minutes") -> DataFrame:
    """A job's state after each batch with events of it, and a last row with ``expired`` when its time from creation is over (K1, K2).

    One state for each job, whatever hours it spans. It goes once the watermark has passed creation and lifetime, also
    while the job is processed. To be written in update mode.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, created, updated = state.get if state.exists else (None, None, None)
        for frame in frames:
            if frame.empty:  # a call for the time being over brings no events
                continue
            frame = frame.sort_values("us", kind="stable")
            first, last = int(frame["us"].iloc[0]), int(frame["us"].iloc[-1])
            created = first if created is None else min(created, first)
            if updated is None or last >= updated:
                status, updated = frame["status"].iloc[-1], last
        ends = created // 1000 + lifetime_ms
        over = state.hasTimedOut or ends <= state.getCurrentWatermarkMs()
        if over:
            state.remove()
        else:
            state.update((status, created, updated))
            state.setTimeoutTimestamp(ends)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "created": [created], "updated": [updated], "expired": [over]})

    timed = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    out = timed.groupBy("job_id").applyInPandasWithState(step, "job_id STRING, status STRING, created LONG, updated LONG, expired BOOLEAN", "status STRING, created LONG, updated LONG", "update", "EventTimeTimeout")
    return out.select("job_id", "status", F.timestamp_micros("created").alias("created_at"), F.timestamp_micros("updated").alias("updated_at"), "expired")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Stretches of a job's events with no pause of ``gap``: what a time to live leaves together."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "job_id").agg(F.count("*").alias("events"), F.max_by("status", "ts").alias("status"))
