"""What jobs cost, from usage records and list prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalars import upper_median

# fixed values: the spike rule
USUAL_DAYS = 14
MIN_USUAL_DAYS = 5
SPIKE_FACTOR = 2.0
SPIKE_MIN_EXTRA = 1.0
# fixed value: days fetched again on each refresh
WINDOW_DAYS = 40


def priced_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with the price valid when it ended; usage without a price drops out.

    An equi-join on the sku with the price interval as a residual condition, always as a skew-split
    sort-merge join: Spark's size check takes a price list that comes from exploded rows for as small
    as the table below it, and would send all of it through the driver.
    """
    same = ["sku", "cloud", "unit"]
    end = F.col("usage_end_time")
    valid = (end >= F.col("price_start")) & (
        F.col("price_end").isNull() | (end < F.col("price_end"))
    )
    billed = usage.where(F.col("job_id").isNotNull())
    return billed.join(prices.hint("merge"), same).where(valid)


def job_costs(
    usage: DataFrame,
    prices: DataFrame,
    since: Column | None = None,
    workspace: str | None = None,
) -> DataFrame:
    """(job_id, day, dbus, cost, currency); corrections are negative usage rows."""
    if since is not None:
        usage = usage.where(F.col("usage_date") >= since)
    if workspace is not None:
        usage = usage.where(F.col("workspace_id") == workspace)
    # summed per currency first: the largest of strings would make Spark sort every record
    sums = (
        priced_usage(usage, prices)
        .groupBy("job_id", F.col("usage_date").alias("day"), "currency")
        .agg(
            F.sum("quantity").alias("dbus"),
            F.sum(F.col("quantity") * F.col("price")).alias("cost"),
        )
    )
    return sums.groupBy("job_id", "day").agg(
        F.sum("dbus").alias("dbus"),
        F.sum("cost").alias("cost"),
        F.max("currency").alias("currency"),
    )


def cost_summary(costs: DataFrame, as_of: str) -> DataFrame:
    """(job_id, yesterday, last_30_days, currency) of whole days, today excluded."""
    today = F.to_date(F.lit(as_of).cast("timestamp"))
    recent = costs.where(
        (F.col("day") >= F.date_sub(today, 30)) & (F.col("day") < today)
    )
    yesterday = F.when(F.col("day") == F.date_sub(today, 1), F.col("cost"))
    return recent.groupBy("job_id").agg(
        F.coalesce(F.sum(yesterday), F.lit(0.0)).alias("yesterday"),
        F.sum("cost").alias("last_30_days"),
        F.max("currency").alias("currency"),
    )


def period_costs(costs: DataFrame, start: Column, end: Column, zone: str) -> DataFrame:
    """(job_id, cost, currency) of the local dates a period covers."""
    first = F.to_date(F.from_utc_timestamp(start, zone))
    last = F.to_date(F.from_utc_timestamp(end, zone))
    return (
        costs.where((F.col("day") >= first) & (F.col("day") < last))
        .groupBy("job_id")
        .agg(F.sum("cost").alias("cost"), F.max("currency").alias("currency"))
    )


def cost_spikes(costs: DataFrame) -> DataFrame:
    """(job_id, day, cost, usual, warning) for every day far above the usual one.

    One row per job and day, so a job's window is as long as its history in days.
    """
    number = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long")
    before = Window.partitionBy("job_id").orderBy("_day").rangeBetween(-USUAL_DAYS, -1)
    rows = costs.withColumn("_day", number).withColumn(
        "_usual_days", F.collect_list("cost").over(before)
    )
    usual = F.when(
        F.size("_usual_days") >= MIN_USUAL_DAYS, upper_median(F.col("_usual_days"))
    )
    cost = F.col("cost")
    high = (
        (F.col("usual") > 0)
        & (cost > F.col("usual") * SPIKE_FACTOR)
        & (cost - F.col("usual") >= SPIKE_MIN_EXTRA)
    )
    text = F.concat(
        F.lit("cost yesterday "),
        F.format_string("%.2f", cost),
        F.lit(" "),
        F.col("currency"),
        F.lit(", usually about "),
        F.format_string("%.2f", "usual"),
    )
    return (
        rows.withColumn("usual", usual)
        .where(high)
        .select("job_id", "day", "cost", "usual", text.alias("warning"))
    )


def replaced_window(stored: DataFrame, fetched: DataFrame, as_of: str) -> DataFrame:
    """Stored days older than the window, and the fetched ones in its place."""
    first = F.date_sub(F.to_date(F.lit(as_of).cast("timestamp")), WINDOW_DAYS)
    return stored.where(F.col("day") < first).unionByName(fetched)
