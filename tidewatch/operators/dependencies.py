"""Flows that wait for other flows: blocking, cycles, components and depth.

The catalogue's ``after`` arrays are the edges. Each round of a fixpoint is one equi-join on
the frontier, written to the shared folder; the driver only sees whether a round found
anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import BROKEN
from tidewatch.session import cut


def links(flows: DataFrame) -> DataFrame:
    """(flow, pos, upstream) for upstreams that are flows; unknown ids are left out."""
    named = flows.select("flow", F.posexplode("after").alias("pos", "upstream"))
    known = flows.select(F.col("flow").alias("upstream"))
    return named.join(known, "upstream", "left_semi").select("flow", "pos", "upstream")


def blocked(statuses: DataFrame) -> DataFrame:
    """Turns late and pending flows with a broken upstream into blocked ones.

    ``statuses(flow, state, detail, after, …)``. Only pending flows change from whole to
    broken when they become blocked, so only they need rounds; failed and warning flows keep
    their state. The detail quotes the first broken upstream in its final state.
    """
    statuses = cut(statuses)
    edges = cut(links(statuses))
    pending = statuses.where(F.col("state") == "pending").select("flow")
    waiting = edges.join(pending, "flow", "left_semi").select("flow", "upstream")
    broken = statuses.where(F.col("state").isin(*BROKEN)).select("flow")
    frontier = broken
    while True:
        reached = (
            waiting.join(
                frontier.withColumnRenamed("flow", "upstream"), "upstream", "left_semi"
            )
            .select("flow")
            .distinct()
            .join(broken, "flow", "left_anti")
        )
        frontier = cut(reached)
        if frontier.isEmpty():
            break
        broken = cut(broken.unionByName(frontier))

    first = (
        edges.join(broken.withColumnRenamed("flow", "upstream"), "upstream", "left_semi")
        .groupBy("flow")
        .agg(F.min_by("upstream", "pos").alias("_on"))
    )
    may_block = F.col("state").isin("late", "pending")
    marked = statuses.join(first, "flow", "left").withColumns(
        {
            "_on": F.when(may_block, F.col("_on")),
            "_state": F.when(may_block & F.col("_on").isNotNull(), "blocked").otherwise(
                F.col("state")
            ),
        }
    )
    final = marked.select(F.col("flow").alias("_on"), F.col("_state").alias("_on_state"))
    waits = F.concat(F.lit("waiting on "), "_on", F.lit(" ("), "_on_state", F.lit(")"))
    return (
        marked.join(final, "_on", "left")
        .withColumns({"detail": F.coalesce(waits, "detail"), "state": F.col("_state")})
        .select(*statuses.columns)
    )


def cyclic(flows: DataFrame) -> DataFrame:
    """The flows on or behind a cycle: what is left once resolved flows are taken away.

    Unknown and repeated upstreams are catalogue violations of their own and count as
    resolved here.
    """
    left = cut(flows.select("flow").distinct())
    edges = cut(links(flows).select("flow", "upstream").distinct())
    while True:
        held = edges.join(
            left.withColumnRenamed("flow", "upstream"), "upstream", "left_semi"
        )
        still = cut(left.join(held.select("flow").distinct(), "flow", "left_semi"))
        if still.count() == left.count():
            return still
        left = still


def circling(wanted: DataFrame, flows: DataFrame) -> DataFrame:
    """(flow): those whose wanted ``after`` leads back to themselves in the catalogue.

    Each is judged alone, with the catalogue as it is. Per round every one of them moves one
    step up; a step already taken is not taken again.
    """
    edges = cut(links(flows).select("flow", "upstream").distinct())
    ahead = cut(wanted.select("flow", F.explode("after").alias("on")).distinct())
    seen = ahead
    while True:
        stepped = (
            ahead.where("on <> flow")
            .join(edges.select(F.col("flow").alias("on"), "upstream"), "on")
            .select("flow", F.col("upstream").alias("on"))
            .distinct()
            .join(seen, ["flow", "on"], "left_anti")
        )
        ahead = cut(stepped)
        if ahead.isEmpty():
            return seen.where("on = flow").select("flow").distinct()
        seen = cut(seen.unionByName(ahead))


def cycle_report(flows: DataFrame) -> DataFrame:
    """One row with the smallest flow on or behind a cycle, null when there is none."""
    return cyclic(flows).agg(F.min("flow").alias("flow"))


def components(flows: DataFrame) -> DataFrame:
    """(flow, component): linked flows, named after the smallest flow they connect to.

    Every round takes the smallest label among neighbours and then jumps to that label's own
    label, so long chains settle in few rounds.
    """
    edges = links(flows).select(F.col("flow").alias("a"), F.col("upstream").alias("b"))
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(
        both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component"))
    )
    while True:
        offered = both.join(labels.withColumnRenamed("a", "b"), "b").select("a", "component")
        nearest = (
            labels.unionByName(offered)
            .groupBy("a")
            .agg(F.min("component").alias("component"))
        )
        jump = nearest.select(F.col("a").alias("component"), F.col("component").alias("_to"))
        moved = cut(
            nearest.join(jump, "component", "left").select(
                "a", F.least("component", "_to").alias("component")
            )
        )
        changed = moved.join(labels, ["a", "component"], "left_anti")
        if changed.isEmpty():
            return moved.withColumnRenamed("a", "flow")
        labels = moved


def steps(flows: DataFrame) -> DataFrame:
    """(flow, step): the longest path from a flow without upstreams.

    Flows on a circle, or behind one, have no such path and are left out; `cyclic` has them.
    """
    circle = cyclic(flows)
    edges = cut(links(flows).select("flow", "upstream").distinct().join(circle, "flow", "left_anti"))
    level = cut(flows.select("flow").distinct().join(circle, "flow", "left_anti"))
    done = level.withColumn("step", F.lit(0))
    depth = 0
    while True:
        # what has an upstream at this level is at least one level further down
        level = cut(
            edges.join(level.withColumnRenamed("flow", "upstream"), "upstream", "left_semi")
            .select("flow")
            .distinct()
        )
        if level.isEmpty():
            break
        depth += 1
        done = done.unionByName(level.withColumn("step", F.lit(depth)))
    return done.groupBy("flow").agg(F.max("step").alias("step"))


def layout(flows: DataFrame) -> DataFrame:
    """(component, step, flow) of every linked flow."""
    return components(flows).join(steps(flows), "flow").select("component", "step", "flow")
