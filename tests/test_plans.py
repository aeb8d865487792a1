"""What reaches the scan, and what the plans do not do."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks.model import Model
from tidewatch.functions.ordered import neighbours, slotted
from tidewatch.operators import costs, lists, reliability, runs
from tidewatch.sinks import export

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "events")
    Model(spark, FOLDER).events.write.parquet(path)
    return spark.read.parquet(path)


def planned(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_period_and_columns_reach_the_scan(events):
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-05", "2024-01-10"))
    plan = planned(reliability.run_counts(events, start, end))
    assert "GreaterThanOrEqual(at," in plan and "LessThan(at," in plan
    assert "ReadSchema: struct<flow:string,at:timestamp,outcome:string>" in plan


def test_retention_and_watermark_reach_the_scan(events):
    now = F.lit("2024-01-31").cast("timestamp")
    assert "GreaterThanOrEqual(at," in planned(export.pruned(events, "at", now, 10))
    assert "GreaterThan(id,1000)" in planned(export.settled(events, 1000, now))


def test_limits_apply_before_the_shuffle(events):
    assert "WindowGroupLimit" in planned(runs.recent_rows(events, 50, ["at", "id"]))
    names = events.select("flow", "detail").distinct()
    assert "WindowGroupLimit" in planned(lists.first_with_remainder(names, "flow", "detail"))
    assert "TakeOrderedAndProject" in planned(lists.newest(events, 200))


def test_small_keys_take_one_exchange(events):
    rows = neighbours(
        slotted(events, ["flow"], "at"), ["flow"], ["at", "id"], previous={"p": F.col("at")}
    )
    assert planned(rows).count("Exchange hashpartitioning") == 1


def test_split_keys_read_their_exchange_twice(events):
    rows = neighbours(
        slotted(events, ["flow"], "at", 20), ["flow"], ["at", "id"], previous={"p": F.col("at")}
    )
    rows.write.format("noop").mode("overwrite").save()
    total = rows.agg(F.sum(F.hash("p", "id")))
    total.collect()
    final = planned(total).split("Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("REPARTITION_BY_COL") <= 2
    assert "CartesianProduct" not in final and "BroadcastNestedLoopJoin" not in final


def test_carried_in_states_are_not_sorted(events):
    start, until = (F.lit(t).cast("timestamp") for t in ("2024-01-15", "2024-01-20"))
    plan = planned(reliability.period_changes(events.withColumnRenamed("outcome", "state"), start, until))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_prices_are_not_sent_through_the_driver(spark):
    model = Model(spark, FOLDER)
    # a few rows of parts become six times as many prices, which Spark's size check does not see
    for rows in (model.costs, costs.priced_usage(model.usage, model.prices)):
        plan = planned(rows)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
