"""Incremental export of settled history, retention, and reading it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# fixed values: how long a row takes to settle, and how long state changes are kept
SETTLE_SECONDS = 60
STATE_DAYS = 400
NO_ID = -1
LAST_ID = 9_223_372_036_854_775_807


def settled(
    rows: DataFrame, watermark: int, as_of: Column, limit: int | None = None
) -> DataFrame:
    """Rows after the watermark and before the first one that is still being written.

    Ids are handed out before rows commit, so the selection stops at the first id written
    under a minute ago. With ``limit`` it is one batch of the lowest ids, the way an export
    that loops takes them; without, everything that has settled, in one distributed append.
    """
    after = rows.where(F.col("id") > watermark)
    young = F.unix_micros("recorded_at") > F.unix_micros(as_of) - SETTLE_SECONDS * 1_000_000
    first_young = after.where(young).agg(
        F.coalesce(F.min("id"), F.lit(LAST_ID)).alias("first")
    )
    chosen = after.where(F.col("id") < first_young.scalar())
    return chosen if limit is None else chosen.orderBy("id").limit(limit)


def closed_minutes(minutes: DataFrame, watermark: Column, as_of: Column) -> DataFrame:
    """Minutes after the watermark that had ended a minute before ``as_of``'s own minute."""
    end = F.date_trunc("minute", as_of) - F.expr("interval 1 minute")
    return minutes.where((F.col("minute") > watermark) & (F.col("minute") < end))


def pruned(rows: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    """What retention keeps: rows not older than a number of days; reaches the scan as a filter."""
    oldest = F.timestamp_micros(F.unix_micros(as_of) - days * 86_400 * 1_000_000)
    return rows.where(F.col(at) >= oldest)


def deduplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Exported history without batches that were written twice."""
    return rows.dropDuplicates(keys)


def read_watermark(spark: SparkSession, folder: str, before_batch: int | None = None) -> int:
    """The largest watermark written; of the batches before one, where it is given."""
    try:
        marks = spark.read.parquet(folder)
    except AnalysisException:
        return NO_ID
    if before_batch is not None:
        marks = marks.where(F.col("batch") < before_batch)
    return marks.agg(F.coalesce(F.max("watermark"), F.lit(NO_ID))).first()[0]


def export_settled(
    spark: SparkSession, rows: DataFrame, target: str, marks: str, as_of: Column
) -> int:
    """Appends what has settled since the last export, then moves the watermark.

    The watermark only ever gains rows and its largest one counts. A crash between the two
    writes appends a batch again; readers use :func:`deduplicated`.
    """
    watermark = read_watermark(spark, marks)
    # what is exported is fixed first: looking again later would see more than was written
    last = settled(rows, watermark, as_of).agg(F.max("id")).first()[0]
    if last is None:
        return watermark
    batch = rows.where((F.col("id") > watermark) & (F.col("id") <= last))
    batch.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(
        target
    )
    spark.createDataFrame([(last,)], "watermark long").write.mode("append").parquet(marks)
    return last


def export_minutes(
    spark: SparkSession, minutes: DataFrame, target: str, marks: str, as_of: Column
) -> int:
    """Writes the minutes that have closed since the last export, each exactly once.

    Every export owns one folder of rows and one of its mark, numbered after the marks there
    are. A crash between the two writes leaves rows without a mark; the next export has the same
    number and replaces them. Returns the last minute exported, in microseconds.
    """
    try:
        known = spark.read.parquet(marks).agg(F.max("watermark"), F.max("batch")).first()
    except AnalysisException:
        known = (None, None)
    watermark = NO_ID if known[0] is None else known[0]
    number = 0 if known[1] is None else known[1] + 1
    after = F.timestamp_micros(F.lit(watermark))
    # what is exported is fixed first, as minutes go on closing
    last = closed_minutes(minutes, after, as_of).agg(F.max(F.unix_micros("minute"))).first()[0]
    if last is None:
        return watermark
    until = F.timestamp_micros(F.lit(last))
    rows = minutes.where((F.col("minute") > after) & (F.col("minute") <= until))
    rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
    mark = spark.createDataFrame([(last,)], "watermark long")
    mark.write.mode("overwrite").parquet(f"{marks}/batch={number}")
    return last
