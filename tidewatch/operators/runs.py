"""Run reports: pairing, durations, recent history, thinning, unusual metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.ordered import ROWS_PER_SLOT, SLOT, neighbours, recent, slotted
from tidewatch.functions.scalars import int_div, micros_between, readable, upper_median

# fixed values: runs a metric is compared with, and how many are enough
HISTORY = 10
MIN_HISTORY = 5
ORDER = ["at", "id"]


def run_marks(events: DataFrame, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Each end with the start right before it; unanswered and running starts; lone ends.

    Only the immediate neighbours of a row matter, so nothing is accumulated along a flow.
    """
    narrow = events.select("flow", "at", "id", "outcome", "detail", "metrics")
    rows = neighbours(
        slotted(narrow, ["flow"], "at", rows_per_slot),
        ["flow"],
        ORDER,
        previous={"_was": F.col("outcome"), "_was_at": F.col("at")},
        following={"_then": F.col("outcome")},
    )
    is_start = F.col("outcome") == "start"
    rows = rows.where(~is_start | F.col("_then").isNull() | (F.col("_then") == "start"))
    started = F.when(F.col("_was") == "start", F.col("_was_at")).otherwise(F.col("at"))
    millis = int_div(micros_between(started, F.col("at")), F.lit(1000))
    running = is_start & F.col("_then").isNull()
    return rows.select(
        "flow",
        F.when(is_start, F.col("at")).otherwise(started).alias("start"),
        F.when(~is_start, F.col("at")).alias("end"),
        F.when(running, "running")
        .when(is_start, "unfinished")
        .otherwise(F.col("outcome"))
        .alias("outcome"),
        F.when(is_start & ~running, "never reported an exit code")
        .otherwise(F.col("detail"))
        .alias("detail"),
        F.when(~is_start, millis.try_cast("int")).alias("millis"),
        F.when(~is_start, F.col("metrics")).alias("metrics"),
    )


def with_seconds(events: DataFrame, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Finished runs get the metric ``seconds`` from their start, over one the job sent."""
    rows = neighbours(
        slotted(events, ["flow"], "at", rows_per_slot),
        ["flow"],
        ORDER,
        previous={"_was": F.col("outcome"), "_was_at": F.col("at")},
    )
    took = F.round(micros_between(F.col("_was_at"), F.col("at")) / F.lit(1e6))
    sent = F.map_filter(
        F.coalesce("metrics", F.create_map().cast("map<string,double>")),
        lambda k, _: k != "seconds",
    )
    measured = F.map_concat(sent, F.create_map(F.lit("seconds"), took))
    finished = (F.col("outcome") != "start") & (F.col("_was") == "start")
    return rows.withColumn(
        "metrics", F.when(finished, measured).otherwise(F.col("metrics"))
    ).drop("_was", "_was_at", SLOT)


def recent_rows(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The newest ``n`` rows per flow; the limit applies before the shuffle, too."""
    newest = Window.partitionBy("flow").orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def last_failures(events: DataFrame) -> DataFrame:
    failed = events.where(F.col("outcome") == "fail")
    return failed.groupBy("flow").agg(F.max("at").alias("failed_at"))


def thinned(marks: DataFrame, bucket_seconds: int) -> DataFrame:
    """Every mark that is not ok, and the first ok mark of each bucket."""
    ok = F.col("outcome") == "ok"
    bucket = F.floor(F.unix_seconds("at") / F.lit(bucket_seconds))
    first = (
        marks.where(ok)
        .groupBy("flow", bucket.alias("_bucket"))
        .agg(F.min_by(F.struct(*marks.columns), F.struct(*ORDER)).alias("_row"))
        .select("_row.*")
    )
    return marks.where(~ok).unionByName(first)


def unusual(value: Column, usual: Column, tolerance: Column) -> Column:
    low, high = usual * (1 - tolerance), usual / (1 - tolerance)
    return (usual > 0) & ((value < low) | (value > high))


def finding(name: Column, value: Column, usual: Column) -> Column:
    return F.concat(
        name,
        F.lit(" "),
        readable(value),
        F.lit(" is unusual, usually about "),
        readable(usual),
    )


def _metric_rows(events: DataFrame) -> DataFrame:
    reported = events.where((F.col("outcome") == "ok") & F.col("metrics").isNotNull())
    return reported.select("flow", "id", "at", F.explode("metrics").alias("name", "value"))


def _joined_findings(rows: DataFrame, keys: list[str]) -> DataFrame:
    # at most 20 metrics a run, so the list is short
    text = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("name", "finding"))),
            lambda f: f["finding"],
        ),
        "; ",
    )
    return rows.groupBy(*keys).agg(text.alias("anomaly"))


def run_anomalies(
    events: DataFrame, tolerances: DataFrame, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """(flow, id, at, anomaly) for every ok run with a metric far from the runs before it.

    ``tolerances(flow, tolerance)`` comes from the catalogue.
    """
    rows = recent(
        slotted(_metric_rows(events), ["flow", "name"], "at", rows_per_slot),
        ["flow", "name"],
        ORDER,
        F.col("value"),
        HISTORY,
        "history",
    )
    judged = (
        rows.where(F.size("history") >= MIN_HISTORY)
        .withColumn("usual", upper_median(F.col("history")))
        .join(tolerances, "flow")
        .where(unusual(F.col("value"), F.col("usual"), F.col("tolerance")))
        .withColumn("finding", finding(F.col("name"), F.col("value"), F.col("usual")))
    )
    return _joined_findings(judged, ["flow", "id", "at"])


def latest_anomaly(events: DataFrame, tolerances: DataFrame) -> DataFrame:
    """(flow, anomaly) of each flow's latest ok run with metrics; null when nothing is unusual.

    Needs only the newest eleven values per metric, so no history is windowed over.
    """
    reported = events.where((F.col("outcome") == "ok") & F.col("metrics").isNotNull())
    latest = reported.groupBy("flow").agg(
        F.max_by("id", F.struct(*ORDER)).alias("_latest")
    )
    newest = Window.partitionBy("flow", "name").orderBy(F.desc("at"), F.desc("id"))
    kept = (
        _metric_rows(events)
        .withColumn("_n", F.row_number().over(newest))
        .where(F.col("_n") <= HISTORY + 1)
    )
    per_metric = kept.groupBy("flow", "name").agg(
        F.max(F.when(F.col("_n") == 1, F.col("id"))).alias("id"),
        F.max(F.when(F.col("_n") == 1, F.col("value"))).alias("value"),
        F.collect_list(F.when(F.col("_n") > 1, F.col("value"))).alias("history"),
    )
    found = (
        per_metric.where(F.size("history") >= MIN_HISTORY)
        .withColumn("usual", upper_median(F.col("history")))
        .join(tolerances, "flow")
        .where(unusual(F.col("value"), F.col("usual"), F.col("tolerance")))
        .withColumn("finding", finding(F.col("name"), F.col("value"), F.col("usual")))
    )
    texts = _joined_findings(found, ["flow", "id"])
    return latest.join(
        texts.withColumnRenamed("id", "_latest"), ["flow", "_latest"], "left"
    ).select("flow", "anomaly")
