"""Arrival of files seen in repeated folder listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.ordered import ROWS_PER_SLOT, SLOT, neighbours, slotted
from tidewatch.functions.scalars import glob_match, human_duration


def observations(
    listings: DataFrame,
    polls: DataFrame,
    rules: DataFrame,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """What each poll makes of each matching file.

    ``listings(flow, poll_at, key, name, size, modified)``; ``polls(flow, poll_at)`` are the
    successful ones, also those that saw no file; ``rules(flow, pattern, pickup_seconds,
    baseline)``, with ``baseline`` set for flows that ran before files were remembered.

    A file is settled when its previous sighting, one poll earlier, had the same size and
    modified time. Then the first settled sighting of a version is an arrival.
    """
    numbered = polls.distinct().withColumn(
        "poll", F.row_number().over(Window.partitionBy("flow").orderBy("poll_at"))
    )
    seen = (
        listings.join(rules, "flow")
        .where(glob_match(F.col("name"), F.col("pattern")))
        .join(numbered, ["flow", "poll_at"])
    )
    keys, order = ["flow", "key"], ["poll_at"]
    version = F.struct("size", "modified")
    rows = slotted(seen, keys, "poll_at", rows_per_slot)
    rows = neighbours(
        rows,
        keys,
        order,
        previous={"_poll": F.col("poll"), "_version": version},
    )
    again = F.coalesce(F.col("_poll") == F.col("poll") - 1, F.lit(False))
    inherited = F.col("baseline") & (F.col("poll") == 1)
    rows = rows.withColumns(
        {
            "settled": inherited | (again & (F.col("_version") == version)),
            "_appeared": F.when(~again, F.col("poll_at")),
            "_again": again,
        }
    ).drop("_poll", "_version")
    rows = neighbours(
        rows,
        keys,
        order,
        previous={"_settled": F.col("settled")},
        carried={"_since": F.col("_appeared")},
    )
    # settled before means counted before, unless the sightings are not consecutive
    before = F.coalesce(F.col("_again") & F.col("_settled"), F.lit(False))
    empty = F.col("settled") & (F.col("size") == 0)
    arrived = F.col("settled") & ~before & ~inherited & (F.col("size") > 0)
    first_seen = F.coalesce("_appeared", "_since")
    return rows.select(
        "flow",
        "poll_at",
        "key",
        "name",
        "size",
        "modified",
        first_seen.alias("first_seen"),
        "settled",
        F.col("settled").alias("counted"),
        empty.alias("empty"),
        arrived.alias("arrived"),
        F.coalesce(
            F.unix_micros("poll_at") - F.unix_micros(first_seen)
            > F.col("pickup_seconds") * 1_000_000,
            F.lit(False),
        ).alias("uncollected"),
        "pickup_seconds",
    )


def arrivals(seen: DataFrame) -> DataFrame:
    """(flow, at, detail, bytes, poll_at): one success per version of a file."""
    return seen.where("arrived").select(
        "flow",
        F.col("first_seen").alias("at"),
        F.col("name").alias("detail"),
        F.col("size").cast("double").alias("bytes"),
        "poll_at",
    )


def poll_problems(seen: DataFrame) -> DataFrame:
    """(flow, poll_at, problem): an empty file, else one nobody collected; smallest name first."""
    late = F.struct("name", "pickup_seconds")
    found = (
        seen.where(F.col("empty") | F.col("uncollected"))
        .groupBy("flow", "poll_at")
        .agg(
            F.min(F.when(F.col("empty"), F.col("name"))).alias("_empty"),
            F.min(F.when(F.col("uncollected"), late)).alias("_late"),
        )
    )
    uncollected = F.concat(
        F.lit("not collected after "),
        human_duration(F.col("_late.pickup_seconds")),
        F.lit(": "),
        F.col("_late.name"),
    )
    problem = F.coalesce(F.concat(F.lit("empty file: "), F.col("_empty")), uncollected)
    return found.select("flow", "poll_at", problem.alias("problem"))


def previous_sightings(listings: DataFrame, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Each sighting of a file with the size and time of the one before it."""
    rows = slotted(listings, ["flow", "key"], "poll_at", rows_per_slot)
    return neighbours(
        rows,
        ["flow", "key"],
        ["poll_at"],
        previous={"size_before": F.col("size"), "modified_before": F.col("modified")},
    ).drop(SLOT)


def latest_listing(listings: DataFrame, polls: DataFrame) -> DataFrame:
    """What the last successful poll of each flow saw, and nothing when it saw nothing."""
    last = polls.groupBy("flow").agg(F.max("poll_at").alias("poll_at"))
    return listings.join(last, ["flow", "poll_at"], "left_semi")

