"""Planned maintenance over flow states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import glob_match, glob_stem, local_clock


def covered(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(flow, name, …): the flows each window's glob patterns match.

    An equi-join, not a product: a pattern can only match ids that start with its literal
    stem, so ids are joined by their prefixes (at most 65 of a 64-letter id) and the glob
    itself is checked on those pairs.
    """
    prefixes = names.select(
        "flow",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.length("flow")),
                lambda n: F.substring("flow", F.lit(1), n),
            )
        ).alias("_stem"),
    )
    stems = patterns.withColumn("_stem", glob_stem(F.col("pattern")))
    return prefixes.join(stems, "_stem").where(
        glob_match(F.col("flow"), F.col("pattern"))
    ).drop("_stem")


def overlaid(statuses: DataFrame, windows: DataFrame, zone: str) -> DataFrame:
    """Flows that are neither ok nor pending inside an open window covering them.

    ``windows`` as :func:`tidewatch.functions.schedules.open_windows` gives them. Of several
    windows the smallest name is shown.
    """
    is_open = windows.where("is_open").select(
        "name", "closes_at", F.explode("patterns").alias("pattern")
    )
    troubled = statuses.where(~F.col("state").isin("ok", "pending")).select("flow")
    chosen = (
        covered(troubled, is_open)
        .groupBy("flow")
        .agg(F.min(F.struct("name", "closes_at")).alias("_window"))
    )
    text = F.concat(
        F.lit("maintenance "),
        F.col("_window.name"),
        F.lit(" until "),
        local_clock(F.col("_window.closes_at"), zone),
        F.lit("; "),
        F.col("detail"),
    )
    inside = F.col("_window").isNotNull()
    return (
        statuses.join(chosen, "flow", "left")
        .withColumns(
            {
                "detail": F.when(inside, text).otherwise(F.col("detail")),
                "state": F.when(inside, "maintenance").otherwise(F.col("state")),
            }
        )
        .select(*statuses.columns)
    )
