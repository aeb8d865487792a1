"""Minute counts and exports over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scalars import status_class
from tidewatch.operators.calls import clamped
from tidewatch.sinks.export import read_watermark, settled


def minute_counts(calls: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Counts per flow and minute of arrival over a stream of single calls.

    ``at`` is when a call arrived, so nothing is late and the watermark needs no slack beyond
    ``delay``. In append mode a minute is emitted once, after it has closed. Counts are added
    up on the map side before the state is touched, so a busy flow costs little.
    """
    kind = status_class(F.col("status"))
    counted = (
        calls.withWatermark("at", delay)
        .groupBy("flow", F.window("at", "1 minute"))
        .agg(
            F.count_if(kind == "ok").alias("ok"),
            F.count_if(kind == "client_error").alias("client_errors"),
            F.count_if(kind == "server_error").alias("server_errors"),
            F.sum(clamped(F.col("millis"))).alias("total_millis"),
        )
    )
    return counted.select(
        "flow", F.col("window.start").alias("minute"), "ok", "client_errors",
        "server_errors", "total_millis",
    )


def additive_sink(target: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink of partial counts that readers add up.

    Every batch owns one folder and replaces it when it is run again, so a restart neither
    loses nor doubles counts; the stored minutes are never rewritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def settled_sink(
    target: str,
    history: Callable[[SparkSession], DataFrame],
    as_of: Callable[[], Column] = F.current_timestamp,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that exports the settled rows of a table of growing history.

    A batch only says that there is something new: a stream offers its rows once, so what is too
    young in it would be lost. The rows are read from the history, after the last id that
    earlier batches have exported; young ones, and everything after the first of them, are
    there for a later batch. A batch that runs again replaces its rows and its mark.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        watermark = read_watermark(spark, f"{target}-marks", number)
        # fixed first, as rows go on settling
        last = settled(history(spark), watermark, as_of()).agg(F.max("id")).first()[0]
        last = watermark if last is None else last
        rows = history(spark).where((F.col("id") > watermark) & (F.col("id") <= last))
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
        mark = spark.createDataFrame([(last,)], "watermark long")
        mark.write.mode("overwrite").parquet(f"{target}-marks/batch={number}")

    return write


def without_repeats(rows: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """A stream of exported history without the rows of batches written twice."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
