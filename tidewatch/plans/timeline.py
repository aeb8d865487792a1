"""Marks of every flow over the last hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ordered import ROWS_PER_SLOT
from tidewatch.functions.scalars import plus_seconds
from tidewatch.operators import calls, runs

# fixed values: the hours a timeline may cover
MIN_HOURS, MAX_HOURS, DEFAULT_HOURS = 1, 168, 24


def timeline(
    flows: DataFrame,
    events: DataFrame,
    minutes: DataFrame,
    as_of: str,
    hours: int = DEFAULT_HOURS,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """(flow, start, end, outcome, detail, millis): runs, call buckets or single points by kind."""
    if not MIN_HOURS <= hours <= MAX_HOURS:
        raise ValueError(f"a timeline covers {MIN_HOURS} to {MAX_HOURS} hours, not {hours}")
    now = F.lit(as_of).cast("timestamp")
    since = plus_seconds(now, F.lit(-hours * 3600))
    kinds = flows.select("flow", "kind", "max_error_rate")
    recent = events.where((F.col("at") >= since) & (F.col("at") <= now)).join(
        kinds, "flow"
    )
    columns = ["flow", "start", "end", "outcome", "detail", "millis"]

    paired = runs.run_marks(recent.where(F.col("kind") == "heartbeat"), rows_per_slot)
    inbound = minutes.where(F.col("minute") <= now).join(
        kinds.where(F.col("kind") == "inbound").drop("kind"), "flow"
    )
    buckets = calls.call_buckets(inbound, since, hours).withColumns(
        {"end": F.col("start"), "millis": F.col("millis").try_cast("int")}
    )
    others = recent.where(~F.col("kind").isin("heartbeat", "inbound")).select(
        "flow", "at", "id", "outcome", "detail", "millis"
    )
    points = runs.thinned(others, calls.bucket_seconds(hours)).withColumns(
        {"start": F.col("at"), "end": F.col("at")}
    )
    return (
        paired.select(*columns)
        .unionByName(buckets.select(*columns))
        .unionByName(points.select(*columns))
    )
