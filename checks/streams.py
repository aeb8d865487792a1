"""The streaming operators as queries: the test tables are read as streams until they end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.model import Model
from checks.oracle_queries import CHANGES, WALK
from checks.oracles import oracle
from checks.queries import at, query
from tidewatch.operators import tables
from tidewatch.session import shared_folder
from tidewatch.sinks import export
from tidewatch.streaming import stateful, windows


class StreamModel(Model):
    """The model over a stream of the events; only what looks at single rows can be used."""

    @property
    def _events(self) -> DataFrame:
        schema = self.table("events").schema
        rows = self.spark.readStream.schema(schema).parquet(f"{self.folder}/events*.parquet")
        return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def scratch(m: Model) -> str:
    return f"{shared_folder(m.spark)}/{uuid.uuid4().hex}"


def landed(m: Model, rows: DataFrame) -> DataFrame:
    """A computed table as a stream."""
    folder = scratch(m)
    rows.write.parquet(folder)
    return m.spark.readStream.schema(rows.schema).parquet(folder)


def finished(m: Model, stream: DataFrame) -> DataFrame:
    folder = scratch(m)
    running = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/marks")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(f"{folder}/rows")
    )
    running.awaitTermination()
    return m.spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def streamed(m: Model) -> StreamModel:
    return StreamModel(m.spark, m.folder)


@query
def streamed_minute_counts(m):
    return finished(m, windows.minute_counts(streamed(m).calls))


@query
def streamed_settled_export(m):
    folder = scratch(m)
    history = m.events.select("id", "flow", "at", "recorded_at")
    # the history lands in four parts, so young rows lie on the border of batches
    history.withColumn("part", F.col("id") % 4).write.partitionBy("part").parquet(
        f"{folder}/history"
    )
    sink = windows.settled_sink(f"{folder}/rows", lambda _: history, lambda: at("2024-01-20 12:00:00"))
    running = (
        m.spark.readStream.schema(history.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{folder}/history")
        .writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{folder}/marks")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return m.spark.read.parquet(f"{folder}/rows").select("id", "flow", "at")


@query
def exported_minutes(m):
    """Three exports; the second comes at a time when nothing more has closed."""
    folder = scratch(m)
    for now in ("2024-01-10 00:00:30", "2024-01-10 00:00:40", "2024-01-25 10:30:30"):
        export.export_minutes(m.spark, m.minutes, f"{folder}/rows", f"{folder}/marks", at(now))
    rows = m.spark.read.parquet(f"{folder}/rows")
    return rows.select("flow", "minute", "ok", "client_errors", "server_errors", "total_millis")


@query
def streamed_absence(m):
    expected = m.flows.select(
        "flow",
        (F.col("every_seconds") + F.col("grace_seconds")).alias("expected_seconds"),
        F.when(F.col("kind") == "heartbeat", F.col("max_runtime_s")).alias("max_runtime_s"),
    )
    reports = streamed(m).events.select("flow", "id", "at", "outcome")
    reports = reports.withWatermark("at", "0 seconds").join(expected, "flow")
    return finished(m, stateful.absence(reports, "EventTime"))


@query
def streamed_file_arrivals(m):
    numbered = m.polls.withColumn(
        "poll", F.expr("cast(row_number() OVER (PARTITION BY flow ORDER BY poll_at) AS bigint)")
    )
    listings = (
        m.listings.where("name LIKE '%.xml'")
        .join(numbered, ["flow", "poll_at"])
        .join(m.rules.select("flow", "baseline"), "flow")
    )
    return finished(m, stateful.settled_files(landed(m, listings)))


@query
def streamed_alerts(m):
    none = F.lit(None)
    evaluations = streamed(m).evaluations.select(
        F.lit("evaluation").alias("kind"), "id", "flow", "at", "state", "delivered",
        none.cast("timestamp").alias("until"),
    )
    silences = streamed(m).silences.select(
        F.lit("silence").alias("kind"), F.lit(-1).cast("long").alias("id"), "flow",
        F.col("set_at").alias("at"), none.cast("string").alias("state"),
        F.lit(True).alias("delivered"), "until",
    )
    return finished(m, stateful.alerting(evaluations.unionByName(silences)))


@query
def streamed_schema_changes(m):
    changes = landed(m, tables.schema_changes(m.schemas))
    changes = changes.withWatermark("changed_at", "0 seconds")
    return finished(m, stateful.fresh_changes(changes, time_mode="EventTime"))


oracle("streamed_minute_counts", "SELECT * FROM mi WHERE minute < (SELECT date_trunc('minute', max(ts)) FROM events)")
oracle("streamed_settled_export", """SELECT id, flow, at FROM ev WHERE id < coalesce((SELECT min(id) FROM ev
    WHERE recorded_at > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 MINUTE), 9223372036854775807)""")
oracle("exported_minutes", "SELECT * FROM mi WHERE minute < TIMESTAMP '2024-01-25 10:29:00'")
oracle("streamed_absence", """SELECT flow, make_timestamp(due // 1000 * 1000) AS due_at, state, since FROM (
    SELECT flow, epoch_us(at) + (every_seconds + 1800) * 1000000 AS due, 'late' AS state, at AS since, next FROM (
        SELECT flow, at, lead(at) OVER (PARTITION BY flow ORDER BY at) AS next FROM ev WHERE outcome = 'ok') JOIN fl USING (flow)
    UNION ALL SELECT flow, epoch_us(at) + 7200000000, 'failed', at, next FROM (
        SELECT flow, at, outcome, lead(at) OVER (PARTITION BY flow ORDER BY at, id) AS next FROM ev) JOIN fl USING (flow)
        WHERE kind = 'heartbeat' AND outcome = 'start')
    WHERE CASE WHEN next IS NULL THEN due // 1000 < (SELECT epoch_us(max(ts)) // 1000 FROM events) ELSE due < epoch_us(next) END""")
oracle("streamed_file_arrivals", "SELECT flow, first_seen AS at, name AS detail, size::DOUBLE AS bytes, poll_at FROM se WHERE arrived")
oracle("streamed_alerts", f"{WALK} /* recursive */ SELECT id, flow, at, state, decision FROM dec WHERE decision IN ('alert', 'recovery')")
CHANGED = f"(SELECT flow, table_name, changed_at AS at, change FROM {CHANGES} WHERE change IS NOT NULL)"
oracle("streamed_schema_changes", f"""SELECT flow, table_name, at, change, TRUE AS shown FROM {CHANGED}
    UNION ALL SELECT flow, table_name, at + INTERVAL 1 DAY, change, FALSE FROM {CHANGED}
    WHERE at + INTERVAL 1 DAY <= (SELECT max(at) FROM {CHANGED})""")
