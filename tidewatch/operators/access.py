"""Roles people have, and which workspace jobs are watched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import ROLES, rank_in


def all_roles(members: DataFrame, group_roles: DataFrame, user_groups: DataFrame) -> DataFrame:
    """(email, role): a person's own entry and one row per group of theirs with a role."""
    own = members.select(F.lower("email").alias("email"), "role")
    groups = user_groups.select(
        F.lower("email").alias("email"), F.explode("groups").alias("group_name")
    )
    granted = groups.join(group_roles, "group_name").select("email", "role")
    return own.unionByName(granted)


def effective_roles(
    members: DataFrame,
    group_roles: DataFrame,
    user_groups: DataFrame,
    admins: list[str],
) -> DataFrame:
    """(email, role): the highest role of each person; listed admins always are admins."""
    listed = members.sparkSession.createDataFrame(
        [(a.lower(), "admin") for a in admins], "email string, role string"
    )
    roles = all_roles(members, group_roles, user_groups).unionByName(listed)
    ranked = roles.withColumn("_rank", rank_in(F.col("role"), ROLES))
    known = ranked.where(F.col("_rank").isNotNull())
    return known.groupBy("email").agg(F.max_by("role", "_rank").alias("role"))


def coverage(jobs: DataFrame, flows: DataFrame) -> DataFrame:
    """Every workspace job with the flow watching it, null where nobody does.

    ``flows`` carries ``position``, its place in the catalogue; the first one wins.
    """
    watching = (
        flows.where((F.col("kind") == "databricks") & F.col("job_id").isNotNull())
        .groupBy("job_id")
        .agg(F.min_by("flow", "position").alias("monitored_as"))
    )
    return jobs.join(watching, "job_id", "left")
