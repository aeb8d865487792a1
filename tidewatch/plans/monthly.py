"""The reliability report of a period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ordered import ROWS_PER_SLOT
from tidewatch.operators import costs, reliability


def monthly_report(
    flows: DataFrame,
    changes: DataFrame,
    events: DataFrame,
    job_costs: DataFrame,
    start: str,
    end: str,
    as_of: str,
    zone: str,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """One row per flow: uptime against target, outages, runs and cost."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    until = F.least(last, F.lit(as_of).cast("timestamp"))
    rows = reliability.intervals(
        reliability.period_changes(changes, first, until), until, rows_per_slot
    )
    return reliability.reported(
        flows,
        reliability.summaries(rows, until),
        reliability.run_counts(events, first, until),
        costs.period_costs(job_costs, first, last, zone),
    )


def monthly_days(
    changes: DataFrame, start: str, end: str, as_of: str, zone: str,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """(flow, days): the same period's uptime per local day."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    until = F.least(last, F.lit(as_of).cast("timestamp"))
    rows = reliability.intervals(
        reliability.period_changes(changes, first, until), until, rows_per_slot
    )
    daily = reliability.daily_uptime(rows, zone)
    return reliability.daily_array(daily, first, last, zone)
