"""State changes, alert decisions, silences, acknowledgements and where alerts go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ordered import ROWS_PER_SLOT, SLOT, neighbours, slotted
from tidewatch.functions.scalars import ATTENTION, plus_seconds

# fixed values: the longest silence, and what a flow was alerted as before anything was said
MAX_SILENCE_HOURS = 720
INITIAL = "pending"


def needs_attention(state: Column) -> Column:
    return state.isin(*ATTENTION)


def recorded_changes(evaluations: DataFrame, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Of ``(id, flow, at, state, detail)`` the rows whose state differs from the one before."""
    rows = neighbours(
        slotted(evaluations, ["flow"], "at", rows_per_slot),
        ["flow"],
        ["at", "id"],
        previous={"_state": F.col("state")},
    ).drop(SLOT)
    return rows.where(~F.col("_state").eqNullSafe(F.col("state"))).drop("_state")


def valid_silences(requests: DataFrame) -> DataFrame:
    """(flow, set_at, until) of ``(flow, set_at, hours)``: above 0 and at most 30 days."""
    hours = F.col("hours")
    until = plus_seconds(F.col("set_at"), F.floor(hours * 3600))
    return requests.where((hours > 0) & (hours <= MAX_SILENCE_HOURS)).select(
        "flow", "set_at", until.alias("until")
    )


def alert_decisions(
    evaluations: DataFrame,
    silences: DataFrame,
    rows_per_slot: int = ROWS_PER_SLOT,
    lifts: DataFrame | None = None,
) -> DataFrame:
    """What each evaluation leads to: ``alert``, ``recovery``, ``record`` or ``none``.

    ``evaluations(id, flow, at, state, detail, delivered)``; ``silences(flow, set_at, until)``,
    a later one replacing an earlier one; ``lifts(flow, at)`` end what is in force before its time.
    Silence starts and ends travel in the same ordered
    stream as the evaluations, so no intervals are joined:

    - a start makes its end known to the rows after it,
    - an end forgets what was alerted, unless a newer silence has taken over,
    - a lift is an end that always counts, so a flow still broken alerts at its next evaluation,
    - an evaluation in maintenance or silence leaves the alerted state alone, and so does one
      whose message was not delivered.

    An undelivered ok is the one row that depends on what it follows: it is a failed recovery
    after an attention state and a silent change otherwise.
    """
    none = F.lit(None)
    actual = evaluations.select(
        "flow", "at", "id", "state", "detail", "delivered",
        F.lit(2).alias("_order"), none.cast("timestamp").alias("_until"),
    )
    marks = silences.select(
        "flow",
        F.explode(
            F.array(
                F.struct(F.col("set_at").alias("at"), F.lit(1).alias("_order")),
                F.struct(F.col("until").alias("at"), F.lit(0).alias("_order")),
            )
        ).alias("_m"),
        F.col("until").alias("_until"),
    ).select(
        "flow",
        F.col("_m.at").alias("at"),
        F.lit(-1).cast("long").alias("id"),
        none.cast("string").alias("state"),
        none.cast("string").alias("detail"),
        F.lit(True).alias("delivered"),
        F.col("_m._order").alias("_order"),
        "_until",
    )
    if lifts is not None:
        lifted = lifts.select("flow", "at", F.lit(-1).alias("_order"), F.col("at").alias("_until"))
        rows = lifted.withColumns({"id": F.lit(-1).cast("long"), "delivered": F.lit(True)})
        marks = marks.unionByName(rows, allowMissingColumns=True)
    keys, order = ["flow"], ["at", "_order", "id"]
    is_lift = F.col("_order") == -1
    is_start, is_end = F.col("_order") == 1, F.col("_order") == 0
    rows = neighbours(
        slotted(actual.unionByName(marks), keys, "at", rows_per_slot),
        keys,
        order,
        carried={"_silenced_until": F.when(is_start | is_lift, F.col("_until"))},
    )
    # an end counts when the silence in force is the one that ends
    ends = is_lift | (is_end & F.col("_silenced_until").eqNullSafe(F.col("_until")))
    silenced = F.coalesce(F.col("_silenced_until") > F.col("at"), F.lit(False))
    heard = (F.col("_order") == 2) & ~silenced & (F.col("state") != "maintenance")
    sent = needs_attention(F.col("state")) | (F.col("state") == "ok")
    spoken = heard & (F.col("delivered") | ~sent)
    position = F.struct(*order)
    said = F.struct(
        F.when(ends, F.lit(INITIAL)).otherwise(F.col("state")).alias("state"),
        position.alias("position"),
    )
    open_ok = heard & ~F.col("delivered") & (F.col("state") == "ok")
    rows = neighbours(
        rows.withColumn("_heard", heard),
        keys,
        order,
        carried={
            "_said": F.when(ends | spoken, said),
            "_open_ok": F.when(open_ok, position),
        },
    )
    last = F.coalesce(F.col("_said.state"), F.lit(INITIAL))
    ok_since = F.col("_open_ok").isNotNull() & (
        F.col("_said").isNull() | (F.col("_open_ok") > F.col("_said.position"))
    )
    alerted = F.when(ok_since & ~needs_attention(last), "ok").otherwise(last)
    state = F.col("state")
    decision = (
        F.when(~F.col("_heard") | (F.col("alerted_before") == state), "none")
        .when(needs_attention(state), "alert")
        .when((state == "ok") & needs_attention(F.col("alerted_before")), "recovery")
        .otherwise("record")
    )
    return (
        rows.where(F.col("_order") == 2)
        .withColumn("alerted_before", alerted)
        .select(
            "id", "flow", "at", "state", "detail", "delivered", "alerted_before",
            decision.alias("decision"),
        )
    )


def acknowledged(acks: DataFrame, evaluations: DataFrame, as_of: str) -> DataFrame:
    """(flow, note, by, at) of acknowledgements still standing: no ok evaluation after them."""
    now = F.lit(as_of).cast("timestamp")
    latest = (
        acks.where(F.col("at") <= now)
        .groupBy("flow")
        .agg(F.max_by(F.struct("note", "by", "at"), "at").alias("_ack"))
    )
    ok = (
        evaluations.where((F.col("state") == "ok") & (F.col("at") <= now))
        .groupBy("flow")
        .agg(F.max("at").alias("_ok_at"))
    )
    standing = F.col("_ok_at").isNull() | (F.col("_ok_at") <= F.col("_ack.at"))
    return latest.join(ok, "flow", "left").where(standing).select("flow", "_ack.*")


def silenced_now(silences: DataFrame, as_of: str, lifts: DataFrame | None = None) -> DataFrame:
    """(flow, until) of silences in force; a later one replaces an earlier one, a lift ends it."""
    now = F.lit(as_of).cast("timestamp")
    if lifts is not None:
        ends = lifts.select("flow", F.col("at").alias("set_at"), F.col("at").alias("until"))
        silences = silences.select("flow", "set_at", "until").unionByName(ends)
    latest = (
        silences.where(F.col("set_at") <= now)
        .groupBy("flow")
        .agg(F.max_by("until", F.struct("set_at", "until")).alias("until"))
    )
    return latest.where(F.col("until") > now)


def alert_rows(
    decided: DataFrame, flows: DataFrame, last_ok: DataFrame, failures: DataFrame
) -> DataFrame:
    """One row per alert or recovery, with its text and, for failures, when it last failed.

    ``last_ok(flow, last_ok)`` and ``failures(flow, failed_at)`` have one row per flow.
    """
    owner = F.coalesce(F.concat(F.lit(", owner "), F.col("owner")), F.lit(""))
    text = F.concat(
        "flow", F.lit(" is "), "state", F.lit(" ("), "detail", F.lit(")"), owner
    )
    return (
        decided.where(F.col("decision").isin("alert", "recovery"))
        .join(flows.select("flow", "owner"), "flow", "left")
        .join(last_ok, "flow", "left")
        .join(failures, "flow", "left")
        .select(
            "id",
            "flow",
            "at",
            text.alias("text"),
            "state",
            "detail",
            "owner",
            "last_ok",
            F.when(F.col("state") == "failed", F.col("failed_at")).alias("failed_at"),
        )
    )


def as_json(alerts: DataFrame) -> DataFrame:
    body = F.struct("text", "flow", "state", "detail", "owner", "last_ok", "failed_at")
    return alerts.select("id", F.to_json(body).alias("body"))


def routed(
    alerts: DataFrame, owners: DataFrame, webhook: str | None, email: list[str]
) -> DataFrame:
    """Adds ``webhook`` and ``email``: the owner's own, each falling back to the shared one."""
    shared = F.array(*[F.lit(e) for e in email]).cast("array<string>")
    own = F.when(F.size("_email") > 0, F.col("_email"))
    sides = owners.select(
        "owner", F.col("webhook").alias("_webhook"), F.col("email").alias("_email")
    )
    return (
        alerts.join(sides, "owner", "left")
        .withColumns(
            {
                "webhook": F.coalesce("_webhook", F.lit(webhook).cast("string")),
                "email": F.coalesce(own, shared),
            }
        )
        .drop("_webhook", "_email")
    )
