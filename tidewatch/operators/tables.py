"""Table loads and schema changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ordered import ROWS_PER_SLOT, SLOT, neighbours, slotted
from tidewatch.operators.lists import first_with_remainder, with_remainder

# fixed values: how far apart one load's tables may be, names shown, how long a change shows
LOAD_SPREAD_SECONDS = 6 * 3600
SHOWN = 5
CHANGE_SHOWN_SECONDS = 24 * 3600


def shown(name: Column) -> Column:
    return F.when(name == "", F.lit("the table")).otherwise(name)


def load_summary(tables: DataFrame) -> DataFrame:
    """One row per flow over ``tables(flow, table_name, version, committed_at, rows, files, bytes)``.

    Totals, the newest table and the text of a success; ``rows`` is null when any table has
    no count, ``tables`` only given for more than one.
    """
    newest = F.struct("table_name", "version", "committed_at")
    totals = tables.groupBy("flow").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("files").alias("files"),
        F.sum("bytes").alias("bytes"),
        F.when(F.count("rows") == F.count(F.lit(1)), F.sum("rows")).alias("rows"),
        F.max_by(newest, F.struct("committed_at", "table_name")).alias("newest"),
    )
    several = F.concat(
        F.col("n").cast("string"),
        F.lit(" tables, newest "),
        shown(F.col("newest.table_name")),
        F.lit(" at version "),
        F.col("newest.version").cast("string"),
    )
    one = F.concat(F.lit("version "), F.col("newest.version").cast("string"))
    return totals.select(
        "flow",
        F.col("newest.committed_at").alias("at"),
        F.when(F.col("n") == 1, one).otherwise(several).alias("detail"),
        "files",
        "bytes",
        "rows",
        F.when(F.col("n") > 1, F.col("n")).alias("tables"),
    )


def load_metrics() -> Column:
    """The summary's numbers as a metric map, without those that are missing."""
    names = ["files", "bytes", "rows", "tables"]
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def left_out(tables: DataFrame) -> DataFrame:
    """(flow, warning): tables committed well before the newest one of their flow.

    The newest commit is aggregated first, so no flow's tables gather in one task; of the
    names only the first few are kept.
    """
    newest = tables.groupBy("flow").agg(F.max("committed_at").alias("_newest"))
    old = tables.join(newest, "flow").where(
        F.unix_micros("_newest") - F.unix_micros("committed_at")
        > LOAD_SPREAD_SECONDS * 1_000_000
    )
    listed = first_with_remainder(old.select("flow", "table_name"), "flow", "table_name", SHOWN)
    text = with_remainder(F.transform("first", shown), F.col("more"))
    return listed.select(
        "flow", F.concat(F.lit("not in the latest load: "), text).alias("warning")
    )


def _as_map(fields: Column) -> Column:
    def entry(field: Column) -> Column:
        cut = F.instr(field, ":")
        return F.struct(
            F.when(cut > 0, F.substring(field, F.lit(1), cut - 1)).otherwise(field).alias("k"),
            F.when(cut > 0, F.substring(field, cut + 1, F.length(field)))
            .otherwise(F.lit(""))
            .alias("v"),
        )

    return F.map_from_entries(F.transform(fields, entry))


def schema_change(before: Column, after: Column) -> Column:
    """``+new, -dropped, name was to now``, each part by name; null when nothing changed.

    One schema's fields stay together in an array, so this is column work on one row.
    """
    old, new = _as_map(before), _as_map(after)
    old_names, new_names = F.map_keys(old), F.map_keys(new)

    def listed(names: Column, text) -> Column:
        return F.transform(F.sort_array(names), text)

    added = listed(F.array_except(new_names, old_names), lambda n: F.concat(F.lit("+"), n))
    dropped = listed(F.array_except(old_names, new_names), lambda n: F.concat(F.lit("-"), n))
    both = F.filter(
        F.array_intersect(new_names, old_names),
        lambda n: F.element_at(old, n) != F.element_at(new, n),
    )
    retyped = listed(
        both,
        lambda n: F.concat(
            n, F.lit(" "), F.element_at(old, n), F.lit(" to "), F.element_at(new, n)
        ),
    )
    return F.nullif(F.array_join(F.concat(added, dropped, retyped), ", "), F.lit(""))


def schema_changes(observed: DataFrame, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """(flow, table_name, changed_at, change) over ``observed(flow, table_name, poll_at, fields)``.

    The first sighting is no change, nor is a new order of the same fields.
    """
    keys = ["flow", "table_name"]
    rows = neighbours(
        slotted(observed, keys, "poll_at", rows_per_slot),
        keys,
        ["poll_at"],
        previous={"_before": F.col("fields")},
    ).drop(SLOT)
    changed = rows.where(
        F.col("_before").isNotNull() & (F.col("_before") != F.col("fields"))
    ).withColumn("change", schema_change(F.col("_before"), F.col("fields")))
    return changed.where(F.col("change").isNotNull()).select(
        *keys, F.col("poll_at").alias("changed_at"), "change"
    )


def recent_schema_warnings(changes: DataFrame, as_of: str) -> DataFrame:
    """(flow, table_name, warning) of each table's latest change while it is under a day old."""
    now = F.unix_micros(F.lit(as_of).cast("timestamp"))
    latest = changes.groupBy("flow", "table_name").agg(
        F.max_by("change", "changed_at").alias("change"),
        F.max("changed_at").alias("changed_at"),
    )
    fresh = latest.where(
        F.unix_micros("changed_at") > now - CHANGE_SHOWN_SECONDS * 1_000_000
    )
    text = F.concat(
        F.lit("schema of "), shown(F.col("table_name")), F.lit(" changed: "), F.col("change")
    )
    return fresh.select("flow", "table_name", text.alias("warning"))


def trusted_keys(
    seen: DataFrame, confirmed: DataFrame, pinned: DataFrame
) -> DataFrame:
    """(flow, trusted, pending) over ``seen(flow, seen_at, fingerprint)``.

    The first fingerprint is trusted; a confirmation ``(flow, at)`` trusts the one last seen
    before it; a pinned one ``(flow, fingerprint)`` always wins. Pending is a different one
    seen last. All three are plain aggregates.
    """
    last_confirmed = confirmed.groupBy("flow").agg(F.max("at").alias("_confirmed_at"))
    rows = seen.join(last_confirmed, "flow", "left")
    before = F.col("seen_at") <= F.col("_confirmed_at")
    state = rows.groupBy("flow").agg(
        F.min_by("fingerprint", "seen_at").alias("_first"),
        F.max_by("fingerprint", F.when(before, F.col("seen_at"))).alias("_confirmed"),
        F.max_by("fingerprint", "seen_at").alias("_last"),
    )
    pins = pinned.select("flow", F.col("fingerprint").alias("_pinned"))
    trusted = F.coalesce("_pinned", "_confirmed", "_first")
    return state.join(pins, "flow", "left").select(
        "flow",
        trusted.alias("trusted"),
        F.when(F.col("_last") != trusted, F.col("_last")).alias("pending"),
    )
