"""Splitting hot keys changes nothing but where the work is done."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks.model import AS_OF, MONTH, ZONE, Model
from tidewatch.functions import ordered
from tidewatch.functions.ordered import SLOT, neighbours, recent, slotted
from tidewatch.operators import alerts, files, maintenance, reliability, runs, tables
from tidewatch.plans import monthly

FOLDER = "/root/testdata/sf0.001"
ROWS = 15


@pytest.fixture(scope="module")
def hot(spark):
    """The model with one flow holding more than a third of all rows."""

    class Hot(Model):
        @property
        def _events(self):
            rows = super()._events
            return rows.withColumn("user_id", F.expr("if(event_id % 5 < 2, 7, user_id)"))

    return Hot(spark, FOLDER)


def bag(frame):
    flat = [
        F.array_sort(F.map_entries(n)).alias(n) if t.startswith("map") else F.col(n)
        for n, t in frame.dtypes
    ]
    return sorted(map(str, frame.select(*flat).collect()))


def test_hot_keys_are_split_and_small_ones_are_not(spark, hot):
    assert SLOT not in slotted(hot.events, ["flow"], "at").columns
    sizes = {
        r.flow: (r.slots, r.largest)
        for r in slotted(hot.events, ["flow"], "at", 100)
        .groupBy("flow", SLOT)
        .count()
        .groupBy("flow")
        .agg(F.count("*").alias("slots"), F.max("count").alias("largest"))
        .collect()
    }
    assert sizes["flow-7"][0] > 2 and sizes["flow-7"][1] < 300
    assert all(slots == 1 for flow, (slots, _) in sizes.items() if flow != "flow-7")


def test_any_number_of_hot_keys_is_split(hot, monkeypatch):
    placed = slotted(hot.events, ["flow"], "at", 3)
    keys = placed.groupBy("flow").agg(F.count_distinct(SLOT).alias("n")).where("n > 1").count()
    rows = bag(placed)
    # beyond the bound slots are joined by a shuffle, and are the same
    assert keys > 5
    monkeypatch.setattr(ordered, "MAX_BROADCAST_KEYS", 5)
    assert bag(slotted(hot.events, ["flow"], "at", 3)) == rows


def test_runs(hot):
    tolerances = hot.flows.select("flow", "tolerance")
    for build in (runs.run_marks, runs.with_seconds):
        assert bag(build(hot.events, ROWS)) == bag(build(hot.events))
    split = runs.run_anomalies(hot.events, tolerances, ROWS)
    assert bag(split) == bag(runs.run_anomalies(hot.events, tolerances))


def test_alerts(hot):
    split = alerts.alert_decisions(hot.evaluations, hot.silences, ROWS)
    assert bag(split) == bag(alerts.alert_decisions(hot.evaluations, hot.silences))
    assert bag(alerts.recorded_changes(hot.changes, ROWS)) == bag(alerts.recorded_changes(hot.changes))


def test_reports(hot):
    def report(rows):
        return monthly.monthly_report(
            hot.flows, hot.changes, hot.events, hot.costs, *MONTH, AS_OF, ZONE, rows
        ).select("flow", F.round("uptime", 9), "incidents", "longest_outage_seconds", "mean_recovery_seconds")

    assert bag(report(ROWS)) == bag(report(10**6))


def test_files_and_tables(hot):
    given = (hot.listings, hot.polls, hot.rules)
    assert bag(files.observations(*given, 8)) == bag(files.observations(*given))
    assert bag(tables.schema_changes(hot.schemas, 8)) == bag(tables.schema_changes(hot.schemas))


def test_days_add_up_to_the_period(hot):
    until = F.lit(MONTH[1]).cast("timestamp")
    changes = reliability.period_changes(hot.changes, F.lit(MONTH[0]).cast("timestamp"), until)
    rows = reliability.intervals(changes, until, ROWS)
    measured = F.sum(F.when(reliability.is_measured(F.col("state")), reliability.lasted(F.col("at"), F.col("ends"))))
    total = {r[0]: r[1] for r in rows.groupBy("flow").agg(measured).collect()}
    first = F.to_date("at")
    pieces = rows.where("at < ends").withColumn("day", F.explode(F.sequence(first, F.to_date("ends"))))
    cut = reliability.lasted(
        F.greatest("at", F.col("day").cast("timestamp")),
        F.least("ends", F.date_add("day", 1).cast("timestamp")),
    )
    by_day = pieces.where(reliability.is_measured(F.col("state"))).groupBy("flow").agg(F.sum(cut))
    assert {r[0]: r[1] for r in by_day.collect()} == {f: t for f, t in total.items() if t}


def test_patterns_are_joined_by_their_stems(spark, hot):
    patterns = spark.createDataFrame(
        [("a", "flow-*"), ("b", "*7"), ("c", "flow-[0-2]"), ("d", "api-1"), ("e", "?low-1?")],
        "name string, pattern string",
    )
    got = maintenance.covered(hot.flows.select("flow"), patterns)
    import fnmatch

    wanted = [
        (f.flow, p.name)
        for f in hot.flows.collect()
        for p in patterns.collect()
        if fnmatch.fnmatchcase(f.flow, p.pattern)
    ]
    assert sorted((r.flow, r.name) for r in got.collect()) == sorted(wanted)


@pytest.mark.parametrize("size", [4, 2_000_000])
def test_null_keys_and_null_values_count_like_any_other(spark, size):
    rows = spark.range(60).select(
        F.expr("if(id % 3 = 0, null, 'k')").alias("key"),
        F.timestamp_seconds(F.col("id") * 600).alias("at"),
        "id",
        F.expr("if(id % 5 = 0, null, cast(id as double))").alias("v"),
    )
    given = slotted(rows, ["key"], "at", size)
    assert (SLOT in given.columns) == (size == 4)
    got = {r.id: r for r in neighbours(given, ["key"], ["at"], {"before": F.col("id")}, {"after": F.col("id")}, {"last": F.col("v")}).collect()}
    history = {r.id: r.h for r in recent(given, ["key"], ["at"], F.col("v"), 4, "h").collect()}
    assert len(got) == len(history) == 60
    for keys in ([i for i in range(60) if i % 3 == 0], [i for i in range(60) if i % 3]):
        for n, i in enumerate(keys):
            assert got[i].before == (keys[n - 1] if n else None)
            assert got[i].after == (keys[n + 1] if n + 1 < len(keys) else None)
            earlier = [float(j) for j in keys[:n] if j % 5]
            assert got[i].last == (earlier[-1] if earlier else None)
            assert history[i] == [float(j) for j in keys[max(0, n - 4) : n] if j % 5]
