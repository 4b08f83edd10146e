"""Jobs as a log of events: latest state, lifetime, what is shown (K1-K4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIFETIME = "INTERVAL 1 HOUR"
# The share of work that each state stands for.
PROGRESS = {"uploaded": 10, "processing": 55, "completed": 100, "failed": 100}


def latest(events: DataFrame, by: str = "job_id", status: str = "status", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Per job: last status, when it was created and last changed (K1)."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    return events.groupBy(by).agg(F.max_by(status, order).alias("status"), F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"))


def expired(created: Column, now: Column, lifetime: str = LIFETIME) -> Column:
    """An hour after upload a job goes, also while it is processed (K2)."""
    return created + F.expr(lifetime) <= now


def alive(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where(~expired(F.col("created_at"), now))


def shown(jobs: DataFrame) -> DataFrame:
    """What others may see of a job, with its progress (K3, K4)."""
    progress = F.create_map(*(F.lit(x) for pair in PROGRESS.items() for x in pair))
    done = F.col("status") == "completed"
    return jobs.withColumns({"has_result": done, "has_report": F.col("status").isin("completed", "failed"), "progress": F.coalesce(F.try_element_at(progress, F.col("status")), F.lit(0))})
