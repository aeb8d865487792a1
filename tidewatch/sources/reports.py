"""Run reports and call batches, as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import valid_id

# fixed values: limits of one report
MAX_METRICS = 20
MAX_CALLS = 10_000
MAX_STATUS = 65_535

# Spark reads more than JSON allows, and nothing behind the first value, so the form is looked at as well.
# What repeats never gives back what it took: time is linear in the body.
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
_NAME = r'"(?:[^"\\]|\\.)*+"'
_PAIR = rf"\s*+{_NAME}\s*+:\s*+{_NUMBER}\s*+"
NUMBERS = rf"\A\s*+\{{(?:{_PAIR}(?:,{_PAIR}){{0,{MAX_METRICS - 1}}}+|\s*+)\}}\s*+\z"
STRICT = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}


def _judged(raw: DataFrame) -> DataFrame:
    body = F.col("body")
    blank = F.coalesce(F.trim(F.regexp_replace(body, r"\s", "")) == "", F.lit(True))
    sent = F.from_json(body, "map<string,double>", STRICT)
    many = F.coalesce(F.size(sent) > MAX_METRICS, F.lit(False))
    # anything that is not an object of numbers parses to null or to null values; 1e999 is beyond a double
    infinite = F.exists(F.map_values(sent), lambda v: v.isNull() | (F.abs(v) == float("inf")))
    broken = ~blank & (
        sent.isNull() | F.coalesce(infinite, F.lit(False)) | (~many & ~F.rlike(body, F.lit(NUMBERS)))
    )
    names_bad = F.exists(F.map_keys(sent), lambda k: ~valid_id(k))
    code = F.when(F.rlike("result", F.lit(r"\A[+-]?[0-9]+\z")), F.col("result").try_cast("long"))
    refusal = (
        F.when(broken, "the body is not an object whose values are numbers")
        .when(
            ~blank & (many | names_bad),
            "at most 20 metrics, each with a plain name",
        )
        .when(~valid_id(F.col("flow")), "a flow id has 1 to 64 of a-z, 0-9, dash, underscore and dot")
        .when(
            (F.col("result") != "start") & code.isNull(), "the result is neither start nor an exit code"
        )
    )
    return raw.withColumns(
        {
            "_metrics": F.when(~blank, sent),
            "_code": code,
            "refusal": refusal,
        }
    )


def run_reports(raw: DataFrame) -> DataFrame:
    """Accepted ``(flow, result, body, at)`` rows as run events; works on streams as well."""
    start = F.col("result") == "start"
    ok = F.col("_code") == 0
    detail = (
        F.when(start, "started")
        .when(ok, "exit 0")
        .otherwise(F.concat(F.lit("exited with code "), F.col("_code").cast("string")))
    )
    accepted = _judged(raw).where(F.col("refusal").isNull())
    return accepted.withColumns(
        {
            "outcome": F.when(start, "start").when(ok, "ok").otherwise("fail"),
            "detail": detail,
            "metrics": F.when(~start, F.col("_metrics")),
        }
    ).drop("_metrics", "_code", "refusal", "result", "body")


def refused_reports(raw: DataFrame) -> DataFrame:
    """The rows :func:`run_reports` leaves out, with the reason."""
    return _judged(raw).where(F.col("refusal").isNotNull()).drop("_metrics", "_code")


def _calls(body: Column) -> Column:
    one = "status int, millis bigint"
    single = F.from_json(body, one)
    many = F.from_json(body, f"array<struct<{one}>>")
    return F.when(F.ltrim(body).startswith("["), many).otherwise(F.array(single))


def _judged_calls(raw: DataFrame) -> DataFrame:
    rows = raw.withColumn("_calls", _calls(F.col("body")))
    known = F.forall("_calls", lambda c: F.coalesce(c["status"].between(0, MAX_STATUS), F.lit(False)))
    whole = F.coalesce(known, F.lit(False))
    refusal = F.when(~whole, "not a call or a list of calls, each with a status").when(
        F.size("_calls") > MAX_CALLS, f"more than {MAX_CALLS} calls in one batch"
    )
    return rows.withColumn("refusal", refusal)


def refused_calls(raw: DataFrame) -> DataFrame:
    """The batches :func:`call_reports` leaves out, with the reason."""
    return _judged_calls(raw).where(F.col("refusal").isNotNull()).drop("_calls")


def call_reports(raw: DataFrame) -> DataFrame:
    """(…, status, millis): one row per call of accepted ``(flow, at, body)`` batches."""
    return (
        _judged_calls(raw)
        .where(F.col("refusal").isNull())
        .drop("refusal")
        .withColumn("_call", F.explode("_calls"))
        .withColumns({"status": F.col("_call.status"), "millis": F.col("_call.millis")})
        .drop("_calls", "_call", "body")
    )
