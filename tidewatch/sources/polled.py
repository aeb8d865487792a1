"""What polls of other systems found: job runs, probes and folder listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scalars import human_duration, int_div, seconds_since

# fixed value: how early a certificate is warned about
CERTIFICATE_DAYS = 14


def run_successes(runs: DataFrame, last_ok: DataFrame) -> DataFrame:
    """(job_id, at, detail, seconds) of successful runs that ended after the last success.

    ``last_ok(job_id, last_ok)`` has one row per job.
    """
    at = F.timestamp_millis("end_ms")
    good = runs.where(F.col("result_state") == "SUCCESS")
    new = F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok"))
    return (
        good.withColumn("at", at)
        .join(last_ok, "job_id", "left")
        .where(new)
        .select(
            "job_id",
            "at",
            F.concat(F.lit("run "), F.col("run_id").cast("string")).alias("detail"),
            int_div(F.col("end_ms") - F.col("start_ms"), F.lit(1000)).alias("seconds"),
        )
    )


def run_problems(runs: DataFrame) -> DataFrame:
    """(job_id, problem) of jobs whose newest run did not succeed; an aggregate, no sort."""
    newest = runs.groupBy("job_id").agg(
        F.max_by(
            F.struct("run_id", "result_state", "message"), F.struct("start_ms", "run_id")
        ).alias("_run")
    )
    result = F.lower(F.coalesce("_run.result_state", F.lit("unknown")))
    text = F.concat(
        F.lit("run "),
        F.col("_run.run_id").cast("string"),
        F.lit(" "),
        result,
        F.lit(": "),
        F.coalesce("_run.message", F.lit("")),
    )
    failed = ~F.col("_run.result_state").eqNullSafe(F.lit("SUCCESS"))
    return newest.where(failed).select("job_id", text.alias("problem"))


def probe_checks(probes: DataFrame, limits: DataFrame) -> DataFrame:
    """(flow, at, problem, success_detail, millis, warning) of HTTP probe samples.

    ``limits(flow, max_latency_ms)`` comes from the catalogue; null means no limit.
    """
    good = (F.col("status") >= 200) & (F.col("status") < 300)
    slow = F.col("elapsed_ms") > F.col("max_latency_ms")
    problem = F.when(~good, F.concat(F.lit("http "), F.col("status").cast("string"))).when(
        slow,
        F.concat(
            F.lit("slow response: "), F.col("elapsed_ms").cast("string"), F.lit(" ms")
        ),
    )
    left = F.unix_micros("cert_not_after") - F.unix_micros("at")
    expiring = F.when(
        left < CERTIFICATE_DAYS * 86_400 * 1_000_000,
        F.concat(
            F.lit("tls certificate expires in "),
            human_duration(seconds_since(F.col("at"), F.col("cert_not_after"))),
            F.lit(" ("),
            F.date_format("cert_not_after", "yyyy-MM-dd"),
            F.lit(")"),
        ),
    )
    fine = F.col("problem").isNull()
    return (
        probes.join(limits, "flow", "left")
        .withColumn("problem", problem)
        .select(
            *probes.columns,
            "problem",
            F.when(
                fine, F.concat(F.lit("http "), F.col("status").cast("string"))
            ).alias("success_detail"),
            F.when(fine, F.col("elapsed_ms")).alias("millis"),
            expiring.alias("warning"),
        )
    )


def folder_listing(spark: SparkSession, path: str, flow: str, poll_at: str) -> DataFrame:
    """Every object below a prefix as a listing; contents are never read."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "modificationTime")
    )
    return found.select(
        F.lit(flow).alias("flow"),
        F.lit(poll_at).cast("timestamp").alias("poll_at"),
        F.col("path").alias("key"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )
