"""The state of every flow: replayed from history, then judged at an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import (
    STATES,
    duration_sql,
    error_rate,
    local_label,
    plus_seconds,
    seconds_since,
)

# fixed values: fewest calls an error rate means something for, and the window it is taken over
MIN_CALLS = 10
CALL_WINDOW_SECONDS = 3600


def replayed(events: DataFrame, as_of: str) -> DataFrame:
    """(flow, last_ok, running_since, problem) as the run reports left them.

    A start sets running; an ok clears running and problem; a fail clears running and sets the
    problem. Each is the latest of some kind of report, so one partial aggregation does it.
    """
    known = events.where(F.col("at") <= F.lit(as_of).cast("timestamp"))
    order = F.struct("at", "id")
    ended = F.col("outcome").isin("ok", "fail")
    latest = known.groupBy("flow").agg(
        F.max(F.when(F.col("outcome") == "ok", F.col("at"))).alias("last_ok"),
        F.max_by(F.struct("outcome", "at"), order).alias("_last"),
        F.max_by(F.struct("outcome", "detail"), F.when(ended, order)).alias("_end"),
    )
    return latest.select(
        "flow",
        "last_ok",
        F.when(F.col("_last.outcome") == "start", F.col("_last.at")).alias("running_since"),
        F.when(F.col("_end.outcome") == "fail", F.col("_end.detail")).alias("problem"),
    )


def folded(events: DataFrame, polls: DataFrame, successes: DataFrame, as_of: str) -> DataFrame:
    """(flow, last_ok, running_since, problem, check_warning) from run reports and polls together.

    ``polls(flow, poll_at, problem, warning, schema_warnings)`` and ``successes(flow, at)`` are
    what polls of other systems left. A poll replaces the problem and the warnings, also with
    none; a run that ends replaces the problem; whichever came last counts, of one instant the
    poll. ``last_ok`` never goes back and only starts and ends of runs decide ``running_since``.
    The three tables meet in one aggregate, combined before the shuffle.
    """
    now = F.lit(as_of).cast("timestamp")
    ended = F.col("outcome").isin("ok", "fail")
    nothing = F.lit(None).cast("string")
    runs = events.where(F.col("at") <= now).select(
        "flow",
        "at",
        F.col("id").cast("long").alias("id"),
        "outcome",
        F.when(ended, 0).alias("_rank"),
        F.when(F.col("outcome") == "fail", F.coalesce("detail", F.lit(""))).alias("_problem"),
        nothing.alias("_warning"),
        F.when(F.col("outcome") == "ok", F.col("at")).alias("_ok"),
    )
    warnings = F.concat(
        F.array_compact(F.array("warning")),
        F.coalesce("schema_warnings", F.array().cast("array<string>")),
    )
    polled = polls.where(F.col("poll_at") <= now).select(
        "flow",
        F.col("poll_at").alias("at"),
        F.lit(None).cast("long").alias("id"),
        nothing.alias("outcome"),
        F.lit(1).alias("_rank"),
        F.col("problem").alias("_problem"),
        F.nullif(F.array_join(warnings, "; "), F.lit("")).alias("_warning"),
        F.lit(None).cast("timestamp").alias("_ok"),
    )
    good = successes.where(F.col("at") <= now).select(
        "flow", F.col("at").alias("_ok")
    )
    rows = runs.unionByName(polled).unionByName(good, allowMissingColumns=True)
    # equal instants and ids are told apart by what was said, so repeats change nothing
    when = F.struct("at", "_rank", "id", "_problem", "_warning")
    latest = rows.groupBy("flow").agg(
        F.max("_ok").alias("last_ok"),
        F.max_by(
            F.struct("outcome", "at"), F.when(F.col("outcome").isNotNull(), F.struct("at", "id"))
        ).alias("_run"),
        F.max_by(F.struct("_problem"), F.when(F.col("_rank").isNotNull(), when)).alias("_end"),
        F.max_by(F.struct("_warning"), F.when(F.col("_rank") == 1, when)).alias("_poll"),
    )
    return latest.select(
        "flow",
        "last_ok",
        F.when(F.col("_run.outcome") == "start", F.col("_run.at")).alias("running_since"),
        F.col("_end._problem").alias("problem"),
        F.col("_poll._warning").alias("check_warning"),
    )


def with_inputs(
    flows: DataFrame,
    state: DataFrame,
    totals: DataFrame,
    due: DataFrame,
    costs: DataFrame | None = None,
) -> DataFrame:
    """The catalogue with everything a state is judged by; what is missing becomes a default.

    Left joins on the flow id; each side has at most one row per flow.
    """
    counts = ["ok", "client_errors", "server_errors"]
    rows = (
        flows.join(state, "flow", "left")
        .join(totals.select("flow", *counts), "flow", "left")
        .join(due, "schedule_id", "left")
        .fillna(0, counts)
    )
    if costs is not None:
        job = F.when(F.col("kind") == "databricks", F.col("job_id"))
        rows = rows.withColumn("_job", job).join(
            costs.withColumnRenamed("job_id", "_job"), "_job", "left"
        )
        rows = rows.drop("_job")
    return rows


def judged(rows: DataFrame, as_of: str, zone: str) -> DataFrame:
    """Adds ``state`` and ``detail``: the first rule that matches wins.

    Columns read: kind, cron, every_seconds, grace_seconds, max_runtime_s, max_error_rate,
    timezone, last_ok, running_since, problem, check_warning, anomaly, cost_warning, ok,
    client_errors, server_errors, due_at, previous_at, next_at, error.
    """
    now = F.lit(as_of).cast("timestamp")
    missed = "last_ok <= timestamp_micros(unix_micros(previous_at) + grace_seconds * 1000000)"
    rows = rows.withColumns(
        {
            "_age": seconds_since(F.col("last_ok"), now),
            "_ran": seconds_since(F.col("running_since"), now),
            "_total": F.expr("ok + client_errors + server_errors"),
            "_missed": F.expr(f"cron IS NOT NULL AND coalesce({missed}, false)"),
        }
    )
    # the deadline that was missed, or the next one
    deadline = plus_seconds(F.expr("if(_missed, due_at, next_at)"), F.col("grace_seconds"))
    rows = rows.withColumns(
        {
            "_deadline": local_label(deadline, F.coalesce("timezone", F.lit(zone))),
            "_rate": error_rate(F.col("server_errors"), F.col("_total")),
            "_now": F.unix_micros(now),
        }
    )

    def verdict(state: str, detail: str) -> str:
        return f"named_struct('state', '{state}', 'detail', {detail})"

    stuck = """kind = 'heartbeat'
        AND _now - unix_micros(running_since) > max_runtime_s * 1000000"""
    failing = f"kind = 'inbound' AND _total >= {MIN_CALLS} AND _rate > max_error_rate"
    overdue = """cron IS NULL
        AND _now - unix_micros(last_ok) > (every_seconds + grace_seconds) * 1000000"""
    warning = "nullif(concat_ws('; ', check_warning, anomaly, cost_warning), '')"
    # nothing is due before the first deadline has passed
    upcoming = """if(cron IS NOT NULL AND due_at IS NOT NULL AND next_at IS NOT NULL,
        concat(', next due ', _deadline), '')"""
    share = "cast(cast(bround(_rate * 100, 0) AS bigint) AS string)"
    rules = [
        ("problem IS NOT NULL", "failed", "problem"),
        (stuck, "failed", f"concat('still running after ', {duration_sql('_ran')})"),
        (failing, "failed", f"concat({share}, '% server errors in the last hour')"),
        ("last_ok IS NULL", "pending", "'no data yet'"),
        ("cron IS NOT NULL AND error IS NOT NULL", "late", "concat('schedule: ', error)"),
        ("_missed", "late", "concat('was due by ', _deadline)"),
        (
            overdue,
            "late",
            f"concat('nothing for ', {duration_sql('_age')}, ', expected every ', "
            f"{duration_sql('every_seconds')})",
        ),
        (f"{warning} IS NOT NULL", "warning", warning),
    ]
    cases = " ".join(f"WHEN {test} THEN {verdict(s, d)}" for test, s, d in rules)
    fine = verdict("ok", f"concat('last ok ', {duration_sql('_age')}, ' ago', {upcoming})")
    return (
        rows.withColumn("_v", F.expr(f"CASE {cases} ELSE {fine} END"))
        .withColumns({"state": F.col("_v.state"), "detail": F.col("_v.detail")})
        .drop("_v", "_age", "_ran", "_total", "_missed", "_deadline", "_rate", "_now")
    )


def per_state(statuses: DataFrame) -> DataFrame:
    """(state, flows) for all states, also those no flow is in."""
    names = statuses.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    counts = statuses.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    # at most seven rows on either side
    return names.join(F.broadcast(counts), "state", "left").select(
        "state", F.coalesce("n", F.lit(0).cast("long")).alias("flows")
    )
