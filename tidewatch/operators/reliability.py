"""Uptime, outages and targets over a period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.business_days import local_midnight
from tidewatch.functions.ordered import ROWS_PER_SLOT, SLOT, neighbours, slotted
from tidewatch.functions.scalars import (
    MICROS,
    STATES,
    UNMEASURED,
    UP,
    int_div,
    micros_between,
    rank_in,
)

ORDER = ["at", "id"]
#: Decimal digits of an id and, behind it, of a state's place.
ID_DIGITS = 20


def is_up(state: Column) -> Column:
    return state.isin(*UP)


def is_measured(state: Column) -> Column:
    return ~state.isin(*UNMEASURED)


def period_changes(changes: DataFrame, start: Column, until: Column) -> DataFrame:
    """The state each flow was in when the period began, then every change inside it.

    The carried-in state is stamped at ``start``. Time, id and the state's place in the fixed list
    of states are packed into one decimal, whose maximum a hash aggregate keeps in a buffer of
    fixed width: however long the history, nothing of it is sorted. Ids are not negative.
    """
    narrow = changes.select("flow", "at", "id", "state")
    digits = F.lit(str(10**ID_DIGITS)).cast("decimal(21,0)")
    packed = (
        F.unix_micros("at").cast("decimal(18,0)") * digits
        + F.col("id").cast("decimal(19,0)") * F.lit(10)
        + rank_in(F.col("state"), STATES)
    )
    rest = F.pmod(F.col("_last"), digits)
    place = F.pmod(rest, F.lit(10)).cast("int")
    before = (
        narrow.where(F.col("at") < start)
        .groupBy("flow")
        .agg(F.max(packed.cast("decimal(38,0)")).alias("_last"))
        .select(
            "flow",
            start.alias("at"),
            ((rest - place) / F.lit(10)).cast("long").alias("id"),
            F.element_at(F.array(*map(F.lit, STATES)), place + 1).alias("state"),
        )
    )
    inside = narrow.where((F.col("at") >= start) & (F.col("at") < until))
    return before.unionByName(inside)


def intervals(changes: DataFrame, until: Column, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Each state until the next change, the last one until ``until``.

    Also ``was_up``: whether the last state before it that was up or down was up.
    """
    known = F.when(is_measured(F.col("state")), is_up(F.col("state")))
    rows = neighbours(
        slotted(changes, ["flow"], "at", rows_per_slot),
        ["flow"],
        ORDER,
        following={"ends": F.col("at")},
        carried={"was_up": known},
    )
    return rows.withColumn("ends", F.coalesce("ends", until))


def lasted(row_start: Column, row_end: Column) -> Column:
    return F.greatest(micros_between(row_start, row_end), F.lit(0).cast("long"))


def outages(rows: DataFrame) -> DataFrame:
    """(flow, started, ended): from a down state to the next up state, null while ongoing.

    ``rows`` from :func:`intervals`. States that are not measured neither open nor close one.
    Only the turns between up and down are ordered again.
    """
    state = F.col("state")
    turns = rows.where(
        is_measured(state) & (is_up(state) != F.coalesce("was_up", F.lit(True)))
    )
    slot = [SLOT] if SLOT in turns.columns else []
    turns = turns.select("flow", "at", "id", is_up(state).alias("up"), *slot)
    paired = neighbours(turns, ["flow"], ORDER, following={"ended": F.col("at")})
    return paired.where(~F.col("up")).select("flow", F.col("at").alias("started"), "ended")


def uptime_of(measured: Column, up: Column) -> Column:
    """Whole seconds up over whole seconds measured, null when nothing was measured."""
    million = F.lit(MICROS)
    whole = F.nullif(int_div(measured, million), F.lit(0).cast("long"))
    return int_div(up, million).cast("double") / whole


def summaries(rows: DataFrame, until: Column) -> DataFrame:
    """(flow, uptime, incidents, longest_outage_seconds, mean_recovery_seconds)."""
    state = F.col("state")
    length = lasted(F.col("at"), F.col("ends"))
    time = rows.groupBy("flow").agg(
        F.sum(F.when(is_measured(state), length).otherwise(0)).alias("_measured"),
        F.sum(F.when(is_up(state), length).otherwise(0)).alias("_up"),
    )
    took = micros_between(F.col("started"), F.coalesce("ended", until))
    closed = F.col("ended").isNotNull()
    down = (
        outages(rows)
        .groupBy("flow")
        .agg(
            F.count(F.lit(1)).alias("incidents"),
            F.max(took).alias("_longest"),
            F.sum(F.when(closed, took)).alias("_total"),
            F.count_if(closed).alias("_closed"),
        )
    )
    zero = F.lit(0).cast("long")
    return time.join(down, "flow", "left").select(
        "flow",
        uptime_of(F.col("_measured"), F.col("_up")).alias("uptime"),
        F.coalesce("incidents", zero).alias("incidents"),
        F.coalesce(int_div(F.col("_longest"), F.lit(MICROS)), zero).alias(
            "longest_outage_seconds"
        ),
        int_div(F.col("_total"), F.col("_closed") * MICROS).alias("mean_recovery_seconds"),
    )


def daily_uptime(rows: DataFrame, zone: str) -> DataFrame:
    """(flow, day, uptime) for local days with something measured.

    Every interval is cut at local midnights and the pieces are summed by day: no comparison
    of days with intervals, and partial sums before the shuffle.
    """
    state = F.col("state")
    day = F.col("day")
    first = F.to_date(F.from_utc_timestamp("at", zone))
    last = F.to_date(
        F.from_utc_timestamp(F.timestamp_micros(F.unix_micros("ends") - 1), zone)
    )
    pieces = (
        rows.where((F.col("at") < F.col("ends")) & is_measured(state))
        .select("flow", "state", "at", "ends", F.explode(F.sequence(first, last)).alias("day"))
        .withColumn(
            "_length",
            lasted(
                F.greatest(F.col("at"), local_midnight(day, zone)),
                F.least(F.col("ends"), local_midnight(F.date_add(day, 1), zone)),
            ),
        )
    )
    sums = pieces.groupBy("flow", "day").agg(
        F.sum("_length").alias("_measured"),
        F.sum(F.when(is_up(state), F.col("_length")).otherwise(0)).alias("_up"),
    )
    return sums.select(
        "flow", "day", uptime_of(F.col("_measured"), F.col("_up")).alias("uptime")
    )


def daily_array(daily: DataFrame, start: Column, end: Column, zone: str) -> DataFrame:
    """(flow, days): one entry per local day of the period, null where nothing was measured.

    A period has a few dozen days, so the arrays are short.
    """
    first = F.to_date(F.from_utc_timestamp(start, zone))
    last = F.to_date(F.from_utc_timestamp(F.timestamp_micros(F.unix_micros(end) - 1), zone))
    entries = F.map_from_entries(F.collect_list(F.struct("day", "uptime")))
    return (
        daily.groupBy("flow")
        .agg(entries.alias("_by_day"))
        .select(
            "flow",
            F.transform(
                F.sequence(first, last), lambda d: F.try_element_at("_by_day", d)
            ).alias("days"),
        )
    )


def run_counts(events: DataFrame, start: Column, until: Column) -> DataFrame:
    inside = events.where((F.col("at") >= start) & (F.col("at") < until))
    return inside.groupBy("flow").agg(
        F.count_if(F.col("outcome") == "ok").alias("runs_ok"),
        F.count_if(F.col("outcome") == "fail").alias("runs_failed"),
    )


def reported(
    flows: DataFrame, uptimes: DataFrame, counts: DataFrame, costs: DataFrame
) -> DataFrame:
    """One row per flow of the catalogue, also for flows without any data."""
    job = F.when(F.col("kind") == "databricks", F.col("job_id"))
    target = F.col("sla")
    return (
        flows.withColumn("_job", job)
        .join(uptimes, "flow", "left")
        .join(counts, "flow", "left")
        .join(costs.select(F.col("job_id").alias("_job"), "cost"), "_job", "left")
        .fillna(0, ["incidents", "longest_outage_seconds", "runs_ok", "runs_failed"])
        .withColumn("met", F.col("uptime") >= target)
        .select(
            "flow",
            "kind",
            "owner",
            "uptime",
            target.alias("target"),
            "met",
            "incidents",
            "longest_outage_seconds",
            "mean_recovery_seconds",
            "runs_ok",
            "runs_failed",
            "cost",
        )
    )


def tiles(report: DataFrame, by_owner: bool = False) -> DataFrame:
    """Missed targets, mean uptime, incidents, longest outage and cost, overall or per owner."""
    groups = [F.coalesce("owner", F.lit("no owner")).alias("owner")] if by_owner else []
    return report.groupBy(*groups).agg(
        F.count_if(F.col("met") == F.lit(False)).alias("missed"),
        F.avg("uptime").alias("mean_uptime"),
        F.coalesce(F.sum("incidents"), F.lit(0).cast("long")).alias("incidents"),
        F.coalesce(F.max("longest_outage_seconds"), F.lit(0).cast("long")).alias(
            "longest_outage_seconds"
        ),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
    )


def owner_order() -> list[Column]:
    """Owners by name, flows without one last."""
    return [(F.col("owner") == "no owner").asc(), F.col("owner").asc()]
