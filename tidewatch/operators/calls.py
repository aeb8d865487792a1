"""Inbound calls, counted per minute and in wider buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import error_rate, int_div, status_class

# fixed values: longest call believed, and the most marks a timeline shows
MAX_MILLIS = 86_400_000
MAX_MARKS = 600

COUNTS = ["ok", "client_errors", "server_errors", "total_millis"]


def clamped(millis: Column) -> Column:
    day = F.lit(MAX_MILLIS).cast("long")
    return F.least(F.greatest(F.coalesce(millis, F.lit(0).cast("long")), F.lit(0).cast("long")), day)


def per_minute(calls: DataFrame) -> DataFrame:
    """(flow, minute, ok, client_errors, server_errors, total_millis) of single calls."""
    kind = status_class(F.col("status"))
    return calls.groupBy("flow", F.date_trunc("minute", "at").alias("minute")).agg(
        F.count_if(kind == "ok").alias("ok"),
        F.count_if(kind == "client_error").alias("client_errors"),
        F.count_if(kind == "server_error").alias("server_errors"),
        F.sum(clamped(F.col("millis"))).alias("total_millis"),
    )


def totals_since(minutes: DataFrame, since: Column) -> DataFrame:
    """(flow, ok, client_errors, server_errors) of the minutes from ``since`` on."""
    return (
        minutes.where(F.col("minute") >= since)
        .groupBy("flow")
        .agg(*[F.sum(c).alias(c) for c in COUNTS[:3]])
    )


def _total() -> Column:
    return F.col("ok") + F.col("client_errors") + F.col("server_errors")


def _text() -> Column:
    return F.concat(
        _total().cast("string"),
        F.lit(" calls, "),
        F.col("client_errors").cast("string"),
        F.lit(" client errors, "),
        F.col("server_errors").cast("string"),
        F.lit(" server errors"),
    )


def bucket_seconds(hours: int) -> int:
    return max(1, hours * 3600 // MAX_MARKS)


def call_buckets(minutes: DataFrame, since: Column, hours: int) -> DataFrame:
    """Timeline marks: a bucket fails when its share of server errors is above the flow's.

    ``minutes`` carries ``max_error_rate`` from the catalogue.
    """
    width = F.lit(max(60, bucket_seconds(hours)))
    epoch = F.unix_seconds("minute")
    sums = (
        minutes.where(F.col("minute") >= since)
        .groupBy(
            "flow",
            "max_error_rate",
            F.timestamp_seconds(epoch - F.pmod(epoch, width)).alias("start"),
        )
        .agg(*[F.sum(c).alias(c) for c in COUNTS])
    )
    bad = error_rate(F.col("server_errors"), _total()) > F.col("max_error_rate")
    calls = F.greatest(_total(), F.lit(1).cast("long"))
    return sums.select(
        "flow",
        "start",
        F.when(bad, "fail").otherwise("ok").alias("outcome"),
        _text().alias("detail"),
        int_div(F.col("total_millis"), calls).alias("millis"),
    )


def as_events(minutes: DataFrame) -> DataFrame:
    """Minutes in the shape of run reports; any server error makes a failed one."""
    return minutes.select(
        "flow",
        F.col("minute").alias("at"),
        F.when(F.col("server_errors") > 0, "fail").otherwise("ok").alias("outcome"),
        _text().alias("detail"),
        int_div(F.col("total_millis"), _total()).alias("millis"),
    )


def merged(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Stored minutes with new counts added to them."""
    both = stored.select("flow", "minute", *COUNTS).unionByName(
        added.select("flow", "minute", *COUNTS)
    )
    return both.groupBy("flow", "minute").agg(*[F.sum(c).alias(c) for c in COUNTS])


def last_call(minutes: DataFrame) -> DataFrame:
    """(flow, last_ok): a minute with calls is a sign of life."""
    return minutes.groupBy("flow").agg(F.max("minute").alias("last_ok"))
