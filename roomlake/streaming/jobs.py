"""Job status and frame choice, the same over a table or a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_job_state(events: DataFrame) -> DataFrame:
    """(job_id, state, frac, cancelled, n_events): last event of each job by (ts, event_id); a cancel request sticks.

    Aggregates only, so a stream keeps one row of state a job (update or complete mode).
    """
    order = F.struct("ts", "event_id")
    rows = events.groupBy("job_id").agg(
        F.max_by(F.struct("state", "frac"), F.when(F.col("state") != "cancel", order)).alias("last"), F.max(F.col("state") == "cancel").alias("cancelled"), F.count(F.lit(1)).alias("n_events")
    )
    return rows.select("job_id", F.col("last.state").alias("state"), F.col("last.frac").alias("frac"), "cancelled", "n_events")


def job_transitions(events: DataFrame) -> DataFrame:
    """(job_id, event_id, state, frac, aborted): every event of a stream merged into its job's state in arrival order.

    Once a cancel request came, later events are aborted. State is one row a job and leaves after a
    day of event time without events; events need a watermark on ts.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cancelled, frac = state.get if state.exists else (False, 0.0)
        newest = None
        for f in frames:
            f = f.sort_values(["ts", "event_id"])
            out = []
            for e, s, x, t in zip(f["event_id"], f["state"], f["frac"], f["ts"]):
                cancelled = cancelled or s == "cancel"
                frac = max(frac, float(x))
                newest = t if newest is None else max(newest, t)
                out.append((key[0], e, s, frac, cancelled))
            yield pd.DataFrame(out, columns=["job_id", "event_id", "state", "frac", "aborted"])
        state.update((cancelled, frac))
        if newest is not None:
            state.setTimeoutTimestamp(int(newest.timestamp() * 1000) + 86_400_000)

    return events.groupBy("job_id").applyInPandasWithState(
        step, "job_id long, event_id long, state string, frac double, aborted boolean", "cancelled boolean, frac double", "append", GroupStateTimeout.EventTimeTimeout
    )


def windowed_progress(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, state, n): events by hour and state, with late events up to ``late``."""
    hours = events.withWatermark("ts", late).groupBy(F.window("ts", width), "state").agg(F.count(F.lit(1)).alias("n"))
    return hours.select(F.col("window.start").alias("start"), "state", "n")


def cancel_job(spark, job_id: str) -> None:
    """Stop the Spark work that runs under a job's tag (SparkContext.addJobTag)."""
    spark.sparkContext.cancelJobsWithTag(f"job-{job_id}")
