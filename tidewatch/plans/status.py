"""The state of all flows at an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import plus_seconds
from tidewatch.functions.schedules import around, open_windows
from tidewatch.operators import calls, costs, dependencies, maintenance, runs, state


def with_schedule(flows: DataFrame, zone: str) -> DataFrame:
    """Adds ``schedule_id``: flows with the same schedule and grace share one."""
    same = F.concat_ws(
        "|",
        "cron",
        "cron_style",
        F.coalesce("timezone", F.lit(zone)),
        F.array_join("calendar", "+"),
        F.col("grace_seconds").cast("string"),
    )
    return flows.withColumn("schedule_id", F.when(F.col("cron").isNotNull(), same))


def due_table(flows: DataFrame, as_of: str, zone: str) -> DataFrame:
    """The deadlines around ``as_of`` of every distinct schedule of the catalogue."""
    distinct = (
        flows.where(F.col("cron").isNotNull())
        .select(
            "schedule_id",
            "cron",
            "cron_style",
            F.coalesce("timezone", F.lit(zone)).alias("timezone"),
            "calendar",
            "grace_seconds",
        )
        .dropDuplicates(["schedule_id"])
    )
    return around(distinct, as_of)


def flow_state(
    events: DataFrame,
    minutes: DataFrame,
    flows: DataFrame,
    job_costs: DataFrame,
    as_of: str,
    polls: DataFrame | None = None,
    successes: DataFrame | None = None,
) -> DataFrame:
    """What is known of every flow: its reports, polls, calls, last anomaly and cost warning.

    ``polls`` and ``successes`` as :func:`tidewatch.operators.state.folded` takes them; without
    them only run reports and calls are known.
    """
    now = F.lit(as_of).cast("timestamp")
    past = events.where(F.col("at") <= now)
    tolerances = flows.select("flow", "tolerance")
    anomalies = runs.latest_anomaly(past, tolerances)
    called = calls.last_call(minutes.where(F.col("minute") <= now)).withColumnRenamed(
        "last_ok", "_called"
    )
    spikes = costs.cost_spikes(
        costs_before(job_costs, as_of)
    ).where(F.col("day") == F.date_sub(F.to_date(now), 1))
    watching = flows.where(F.col("kind") == "databricks").select("flow", "job_id")
    warned = watching.join(spikes, "job_id").select(
        "flow", F.col("warning").alias("cost_warning")
    )
    if polls is None:
        known = state.replayed(past, as_of).withColumn("check_warning", F.lit(None).cast("string"))
    else:
        known = state.folded(past, polls, successes, as_of)
    return (
        known.join(called, "flow", "full")
        .join(anomalies, "flow", "left")
        .join(warned, "flow", "left")
        .withColumn("last_ok", F.greatest("last_ok", "_called"))
        .drop("_called")
    )


def costs_before(job_costs: DataFrame, as_of: str) -> DataFrame:
    """Only the days a spike of yesterday is judged by."""
    today = F.to_date(F.lit(as_of).cast("timestamp"))
    first = F.date_sub(today, costs.USUAL_DAYS + 1)
    return job_costs.where((F.col("day") >= first) & (F.col("day") < today))


def evaluated(
    flows: DataFrame,
    events: DataFrame,
    minutes: DataFrame,
    job_costs: DataFrame,
    as_of: str,
    zone: str,
    polls: DataFrame | None = None,
    successes: DataFrame | None = None,
) -> DataFrame:
    """Every flow with its own state, before blocking and maintenance."""
    now = F.lit(as_of).cast("timestamp")
    planned = with_schedule(flows, zone)
    since = plus_seconds(now, F.lit(-state.CALL_WINDOW_SECONDS))
    totals = calls.totals_since(minutes.where(F.col("minute") <= now), since)
    known = flow_state(events, minutes, flows, job_costs, as_of, polls, successes)
    rows = state.with_inputs(planned, known, totals, due_table(planned, as_of, zone))
    return state.judged(rows, as_of, zone)


def current(
    flows: DataFrame,
    events: DataFrame,
    minutes: DataFrame,
    job_costs: DataFrame,
    windows: DataFrame,
    as_of: str,
    zone: str,
    polls: DataFrame | None = None,
    successes: DataFrame | None = None,
) -> DataFrame:
    """The whole picture: own state, then blocking, then maintenance."""
    columns = ["flow", "kind", "owner", "after", "last_ok", "state", "detail"]
    own = evaluated(flows, events, minutes, job_costs, as_of, zone, polls, successes).select(*columns)
    with_blocks = dependencies.blocked(own)
    return maintenance.overlaid(with_blocks, open_windows(windows, as_of), zone)
