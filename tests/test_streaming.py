"""Streams give what the batch operators give."""

from __future__ import annotations

import datetime as dt
import random
import tracemalloc

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from checks.model import Model
from tidewatch.operators import alerts, calls, files
from tidewatch.sinks import export
from tidewatch.streaming import stateful, windows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def model(spark):
    return Model(spark, FOLDER)


def stream_of(spark, frame, folder, pieces=1, by="at"):
    """Writes a frame as a few files in order and reads it back as a stream."""
    ranked = frame.withColumn("_piece", F.expr(f"ntile({pieces}) OVER (ORDER BY {by})"))
    for n in range(1, pieces + 1):
        ranked.where(f"_piece = {n}").drop("_piece").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, tmp_path, spark, mode="append"):
    out = str(tmp_path / "out")
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "marks"))
        .outputMode(mode)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.schema(stream.schema).parquet(out)


def rows(frame):
    return sorted(tuple(r) for r in frame.select(*sorted(frame.columns)).collect())


def test_minutes_are_emitted_once_they_have_closed(spark, model, tmp_path):
    stream = stream_of(spark, model.calls, str(tmp_path / "in"), 3)
    got = run(windows.minute_counts(stream), tmp_path, spark)
    last = model.calls.agg(F.date_trunc("minute", F.max("at"))).first()[0]
    wanted = calls.per_minute(model.calls).where(F.col("minute") < F.lit(last))
    assert rows(got) == rows(wanted)


def test_partial_counts_of_batches_add_up(spark, model, tmp_path):
    stream = stream_of(spark, model.calls, str(tmp_path / "in"), 3)
    target = str(tmp_path / "counts")
    counted = stream.select("*")
    sink = windows.additive_sink(target)

    def write(batch, number):
        # a batch that is run twice replaces itself
        sink(calls.per_minute(batch), number)
        sink(calls.per_minute(batch), number)

    query = (
        counted.writeStream.foreachBatch(write)
        .option("checkpointLocation", str(tmp_path / "marks"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(240)
    stored = spark.read.parquet(target)
    total = calls.merged(stored, stored.limit(0))
    assert rows(total) == rows(calls.per_minute(model.calls))


def test_only_settled_rows_leave_and_none_is_lost(spark, model, tmp_path):
    target, end = str(tmp_path / "settled"), model.events.agg(F.max("recorded_at")).first()[0]
    now = [end]
    write = windows.settled_sink(target, lambda _: model.events, lambda: F.lit(now[0]))
    write(model.events.where("id % 3 = 0"), 0)
    young = model.events.where(F.col("recorded_at") > F.lit(end - dt.timedelta(minutes=1)))
    first = young.agg(F.min("id")).first()[0]
    assert spark.read.parquet(target).count() == model.events.where(F.col("id") < first).count()
    # what was young comes with a later batch, also when that runs twice
    now[0] = end + dt.timedelta(minutes=2)
    for number in (1, 1, 2):
        write(model.events.limit(0), number)
    ids = sorted(r.id for r in spark.read.parquet(target).select("id").collect())
    assert ids == sorted(r.id for r in model.events.select("id").collect())


def test_repeated_batches_are_read_once(spark, model, tmp_path):
    twice = model.events.select("id", "at").unionByName(model.events.select("id", "at"))
    stream = stream_of(spark, twice, str(tmp_path / "in"), 2, by="id")
    got = run(windows.without_repeats(stream, ["id"], "at", "60 days"), tmp_path, spark)
    assert got.count() == model.events.count()


def test_files_settle_in_a_stream_as_in_a_batch(spark, model, tmp_path):
    numbered = model.polls.withColumn(
        "poll", F.expr("row_number() OVER (PARTITION BY flow ORDER BY poll_at)").cast("long")
    )
    listings = (
        model.listings.where("name LIKE '%.xml'")
        .join(numbered, ["flow", "poll_at"])
        .join(model.rules.select("flow", "baseline"), "flow")
    )
    stream = stream_of(spark, listings, str(tmp_path / "in"), 3, by="poll_at")
    got = run(stateful.settled_files(stream), tmp_path, spark)
    wanted = files.arrivals(files.observations(model.listings, model.polls, model.rules))
    assert rows(got) == rows(wanted)


def test_alerts_in_a_stream_as_in_a_batch(spark, model, tmp_path):
    decided = alerts.alert_decisions(model.evaluations, model.silences)
    wanted = decided.where("decision IN ('alert', 'recovery')").select(
        "id", "flow", "at", "state", "decision"
    )
    none = F.lit(None)
    stream = model.evaluations.select(
        F.lit("evaluation").alias("kind"), "id", "flow", "at", "state", "delivered",
        none.cast("timestamp").alias("until"),
    ).unionByName(
        model.silences.select(
            F.lit("silence").alias("kind"), F.lit(-1).cast("long").alias("id"), "flow",
            F.col("set_at").alias("at"), none.cast("string").alias("state"),
            F.lit(True).alias("delivered"), "until",
        )
    )
    got = run(stateful.alerting(stream_of(spark, stream, str(tmp_path / "in"), 3)), tmp_path, spark)
    assert rows(got) == rows(wanted)


def at(hour, minute=0):
    return dt.datetime(2026, 9, 1, 0, 0) + dt.timedelta(hours=hour, minutes=minute)


def test_absence_is_raised_by_time_alone(spark, tmp_path):
    made = spark.createDataFrame(
        [
            ("a", 1, at(0), "ok", 3600, 1800),
            ("b", 2, at(0, 10), "start", 3600, 1800),
            ("c", 3, at(0, 30), "ok", 36000, 1800),
            # only moves the clock
            ("z", 4, at(5), "ok", 360000, None),
            ("z", 5, at(5, 1), "ok", 360000, None),
            ("z", 6, at(5, 2), "ok", 360000, None),
            ("a", 7, at(5, 3), "ok", 3600, 1800),
            ("z", 8, at(5, 30), "ok", 360000, None),
        ],
        "flow string, id long, at timestamp, outcome string, expected_seconds long, max_runtime_s long",
    )
    stream = stream_of(spark, made, str(tmp_path / "in"), 4).withWatermark("at", "0 seconds")
    got = run(stateful.absence(stream, "EventTime"), tmp_path, spark)
    assert rows(got.select("flow", "state", "due_at")) == rows(
        spark.createDataFrame(
            [("a", "late", at(1)), ("b", "failed", at(0, 40))],
            "flow string, state string, due_at timestamp",
        )
    )


def test_a_schema_change_shows_for_a_day(spark, tmp_path):
    made = spark.createDataFrame(
        [
            ("f", "t", at(0), "+a"),
            ("f", "u", at(1), "+b"),
            ("f", "z", at(20), "-c"),
            ("f", "t", at(21), "+d"),
            ("f", "z", at(26), "+e"),
            ("f", "z", at(26, 5), "+f"),
        ],
        "flow string, table_name string, changed_at timestamp, change string",
    )
    stream = stream_of(spark, made, str(tmp_path / "in"), 3, by="changed_at")
    stream = stream.withWatermark("changed_at", "0 seconds")
    got = run(stateful.fresh_changes(stream, time_mode="EventTime"), tmp_path, spark)
    ended = [(r.table_name, r.change) for r in got.where("NOT shown").collect()]
    assert sorted(ended) == [("t", "+a"), ("u", "+b")]


def test_streams_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(7)
    reports = [(f"f{i % 3}", i, at(0, 7 * i), rng.choice(["ok", "start", "fail"]), 3600, 1800) for i in range(90)]
    changes = [(f"f{i % 3}", "t", at(0, 50 * i), f"+c{i}") for i in range(60)]
    frames = {
        "absence": (spark.createDataFrame(reports, "flow string, id long, at timestamp, outcome string, expected_seconds long, max_runtime_s long"), "at"),
        "fresh_changes": (spark.createDataFrame(changes, "flow string, table_name string, changed_at timestamp, change string"), "changed_at"),
    }
    for name, (frame, time) in frames.items():
        found = {}
        for pieces in (1, 3):
            folder = tmp_path / f"{name}-{pieces}"
            folder.mkdir()
            stream = stream_of(spark, frame, str(folder / "in"), pieces, by=time).withWatermark(time, "0 seconds")
            found[pieces] = rows(run(getattr(stateful, name)(stream, time_mode="EventTime"), folder, spark))
        assert found[1] == found[3] and len(found[1]) > 10


def test_a_crash_between_rows_and_mark_exports_no_minute_twice(spark, model, tmp_path, monkeypatch):
    target, marks = str(tmp_path / "rows"), str(tmp_path / "marks")
    at = lambda text: F.lit(text).cast("timestamp")
    export.export_minutes(spark, model.minutes, target, marks, at("2024-01-08 00:00:30"))

    def lost(*_):
        raise RuntimeError("the driver went away")

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lost)
        with pytest.raises(RuntimeError):
            export.export_minutes(spark, model.minutes, target, marks, at("2024-01-15 00:00:30"))
    for now in ("2024-01-20 00:00:30", "2024-01-20 00:00:50", "2024-01-22 00:00:30"):
        export.export_minutes(spark, model.minutes, target, marks, at(now))
    got = spark.read.parquet(target).drop("batch")
    assert rows(got) == rows(export.closed_minutes(model.minutes, at("1970-01-01"), at("2024-01-22 00:00:30")))


class Held:
    """State of one key that counts how often it is asked."""

    def __init__(self):
        self.value, self.asked = None, 0

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value

    def listTimers(self):
        return iter([])

    def registerTimer(self, _):
        pass


def test_a_files_state_is_asked_once_a_trigger():
    held, settle = Held(), stateful.Settle()
    settle.init(held)
    polls = [
        Row(name="f.xml", poll=n, poll_at_us=n, size=5 + (n > 100), modified_us=1, baseline=False) for n in range(1, 201)
    ]
    random.Random(3).shuffle(polls)
    found = [r.poll_at for half in (range(1, 101), range(101, 201)) for r in settle.handleInputRows(
        ("f", "k"), iter([p for p in polls if p.poll in half]), None
    )]
    assert found == [2, 102]
    assert held.asked <= 4


@pytest.mark.parametrize("processor", [stateful.Alerting, stateful.Absence])
def test_rows_of_a_busy_flow_take_few_bytes(processor):
    n, made = 30_000, processor()
    made.init(Held())

    def rows():
        for i in range(n):
            at = (i * 7919) % n
            yield Row(
                kind="evaluation", rank=2, id=at, at=dt.datetime(2026, 9, 1), at_us=at * 10**6, until_us=None, delivered=True,
                state="failed" if at % 1000 == 0 else "ok", outcome="start" if at % 1000 else "ok",
                expected_seconds=500, max_runtime_s=None,
            )

    tracemalloc.start()
    found = [tuple(r) for r in made.handleInputRows(("f",), rows(), None)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    wanted = range(0, n, 1000)
    if processor is stateful.Alerting:
        assert [r[0] for r in found] == [i for k in wanted for i in (k, k + 1)]
    else:
        assert [r[1] for r in found] == [(k + 500) * 10**6 for k in wanted]
    assert peak < 150 * n
