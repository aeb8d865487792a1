"""Filters and orders of flow and report lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalars import ATTENTION, SEVERITY, rank_in


def matching(
    flows: DataFrame, kind: str = "all", text: str = "", only: Column | None = None
) -> DataFrame:
    """Flows of a kind whose id, kind or source contains a text, in any case."""
    needle = text.strip().lower()
    if kind != "all":
        flows = flows.where(F.col("kind") == kind)
    if needle:
        hit = F.lit(False)
        for name in ("flow", "kind", "source"):
            hit = hit | F.coalesce(F.contains(F.lower(name), F.lit(needle)), F.lit(False))
        flows = flows.where(hit)
    return flows if only is None else flows.where(only)


def unacknowledged(statuses: DataFrame) -> DataFrame:
    """Flows that need attention and that nobody has acknowledged."""
    return statuses.where(
        F.col("state").isin(*ATTENTION) & ~F.coalesce("acknowledged", F.lit(False))
    )


def within(rows: DataFrame, at: str, start: Column, end: Column, as_of: Column) -> DataFrame:
    """The half-open period, cut off at ``as_of``."""
    return rows.where((F.col(at) >= start) & (F.col(at) < F.least(end, as_of)))


def missed(report: DataFrame) -> DataFrame:
    """Reports below their target; without data or target nothing is missed."""
    return report.where(F.col("met") == F.lit(False))


def by_urgency(statuses: DataFrame) -> DataFrame:
    return statuses.orderBy(rank_in(F.col("state"), SEVERITY), "flow")


def report_key(name: str) -> Column:
    """What a report column sorts by."""
    # fixed values: where missing values go
    keys = {
        "flow": F.col("flow"),
        "uptime": F.coalesce("uptime", F.lit(2.0)),
        "target": F.when(F.col("met") == F.lit(False), 0).when(F.col("met"), 1).otherwise(2),
        "incidents": F.col("incidents"),
        "outage": F.col("longest_outage_seconds"),
        "recovery": F.coalesce("mean_recovery_seconds", F.lit(-1).cast("long")),
        "runs": F.col("runs_failed"),
        "cost": F.coalesce("cost", F.lit(-1.0)),
    }
    return keys[name]


def ordered_report(report: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """A report in the order of one of its columns, ties in order of the flow."""
    column = report_key(key)
    return report.orderBy(column.desc() if descending else column.asc(), "flow")


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows by time and id; only ``n`` rows per task reach the driver's merge."""
    return rows.orderBy(F.desc("at"), F.desc("id")).limit(n)


def first_with_remainder(names: DataFrame, key: str, name: str, shown: int = 5) -> DataFrame:
    """(key, first, more): the first few names of each key in order, and how many are left.

    Counting is an aggregate and the limit applies before the shuffle, so however many names a
    key has, only ``shown`` of them come together.
    """
    order = Window.partitionBy(key).orderBy(name)
    first = (
        names.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= shown)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(name)).alias("first"))
    )
    counts = names.groupBy(key).agg(F.count(F.lit(1)).alias("_count"))
    return counts.join(first, key).select(
        key, "first", (F.col("_count") - F.size("first")).alias("more")
    )


def with_remainder(first: Column, more: Column) -> Column:
    """``a, b and 3 more``."""
    head = F.array_join(first, ", ")
    return F.when(
        more > 0, F.concat(head, F.lit(" and "), more.cast("string"), F.lit(" more"))
    ).otherwise(head)
