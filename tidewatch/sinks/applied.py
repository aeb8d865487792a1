"""Applying poll reports to stored state, and publishing gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ordered import ROWS_PER_SLOT, SLOT, neighbours, slotted
from tidewatch.functions.scalars import STATES, seconds_since


def report_events(
    reports: DataFrame, successes: DataFrame, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """Run events a series of polls leaves behind.

    ``successes(flow, at, detail, millis, metrics)`` become ok events. Of
    ``reports(flow, poll_at, problem)`` those become fail events whose problem differs from
    the poll before.
    """
    rows = neighbours(
        slotted(reports.select("flow", "poll_at", "problem"), ["flow"], "poll_at", rows_per_slot),
        ["flow"],
        ["poll_at"],
        previous={"_problem": F.col("problem")},
    ).drop(SLOT)
    new = F.col("problem").isNotNull() & ~F.col("problem").eqNullSafe(F.col("_problem"))
    failed = rows.where(new).select(
        "flow",
        F.col("poll_at").alias("at"),
        F.lit("fail").alias("outcome"),
        F.col("problem").alias("detail"),
        F.lit(None).cast("int").alias("millis"),
        F.lit(None).cast("map<string,double>").alias("metrics"),
    )
    ok = successes.select(
        "flow", "at", F.lit("ok").alias("outcome"), "detail", "millis", "metrics"
    )
    return ok.unionByName(failed)


def report_state(reports: DataFrame, successes: DataFrame) -> DataFrame:
    """(flow, last_ok, problem, check_warning) after the last poll of each flow.

    ``reports(flow, poll_at, problem, warning, schema_warnings)``: the warning is the poll's
    own and then its schema changes, replaced on every poll; ``last_ok`` never goes back.
    """
    last = reports.groupBy("flow").agg(
        F.max_by(F.struct("problem", "warning", "schema_warnings"), "poll_at").alias("_last")
    )
    ok = successes.groupBy("flow").agg(F.max("at").alias("last_ok"))
    warnings = F.concat(
        F.array_compact(F.array("_last.warning")),
        F.coalesce("_last.schema_warnings", F.array().cast("array<string>")),
    )
    return last.join(ok, "flow", "left").select(
        "flow",
        "last_ok",
        F.col("_last.problem").alias("problem"),
        F.nullif(F.array_join(warnings, "; "), F.lit("")).alias("check_warning"),
    )


def gauges(statuses: DataFrame, as_of: Column) -> DataFrame:
    """(gauge, flow, kind, owner, state, value): state, age of the last success, flows per state.

    Every flow gives its rows in one pass; all states are seeded with zero, so that those no
    flow is in are reported as well.
    """
    nothing = F.lit(None).cast("string")

    def row(gauge: str, value: Column, labels: set[str] = frozenset()) -> Column:
        names = ("flow", "kind", "owner", "state")
        return F.struct(
            F.lit(gauge).alias("gauge"),
            *[(F.col(n) if n in labels else nothing).alias(n) for n in names],
            value.cast("double").alias("value"),
        )

    age = F.greatest(seconds_since(F.col("last_ok"), as_of), F.lit(0).cast("long"))
    rows = statuses.select(
        F.explode(
            F.array(
                row("flow_state", F.lit(1), {"flow", "kind", "owner", "state"}),
                row("last_ok_age_seconds", age, {"flow"}),
                row("flows", F.lit(1), {"state"}),
            )
        ).alias("_g")
    ).select("_g.*")
    seeds = statuses.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    zeros = seeds.select(row("flows", F.lit(0), {"state"}).alias("_g")).select("_g.*")
    return (
        rows.where(F.col("value").isNotNull())
        .unionByName(zeros)
        .groupBy("gauge", "flow", "kind", "owner", "state")
        .agg(F.sum("value").alias("value"))
    )
