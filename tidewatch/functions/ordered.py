"""Ordered neighbours (lag, lead, carry-forward, recent history) that survive a hot key.

A plain window over one key puts all of that key's rows into one task. That is fine while
every key is small, so the sizes are measured first. Where a key is too large, it is cut into
time slots: a window runs inside (key, slot), and the little that crosses a slot border
travels through a table with one row per slot. The slots only decide where the work is done:
any slot assignment, or none, gives the same result, for null keys and null values as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = "_slot"
ROWS_PER_SLOT = 2_000_000
# the most keys whose slots are broadcast; the slots of more keys are joined by a shuffle
MAX_BROADCAST_KEYS = 20_000


def _matching(one: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join on keys of which a null equals a null; the other side's keys are left out."""
    renamed = other.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return one.join(renamed, same, how).drop(*[f"_key_{k}" for k in keys])


def slotted(
    rows: DataFrame, keys: Sequence[str], at: str, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """Adds ``_slot`` where some key has more than ``rows_per_slot`` rows, else nothing.

    One count per key, combined before its shuffle, decides. The width of a slot is chosen per
    hot key, so that its busiest hour fills about ``rows_per_slot`` rows per slot. Every such key
    is split. Up to ``MAX_BROADCAST_KEYS`` of them are broadcast, more are left to joins by
    shuffle; the driver only learns how many there are, up to that number.
    """
    keys = list(keys)
    large = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_slot)
    )
    found = large.limit(MAX_BROADCAST_KEYS + 1).count()
    if found == 0:
        return rows
    sent = F.broadcast if found <= MAX_BROADCAST_KEYS else lambda table: table
    epoch = F.unix_seconds(F.col(at))
    hour = F.floor(epoch / F.lit(3600)).alias("_hour")
    hourly = (
        _matching(rows.select(*keys, at), sent(large.select(*keys)), keys, "inner")
        .groupBy(*keys, hour)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    per_peak = F.floor(F.lit(3600.0 * rows_per_slot) / F.max("_n"))
    width = F.greatest(F.lit(1), per_peak).cast("long").alias("_width")
    widths = hourly.groupBy(*keys).agg(width)
    slot = F.coalesce(F.floor(epoch / F.col("_width")), F.lit(0).cast("long"))
    return _matching(rows, sent(widths), keys, "left").select(*rows.columns, slot.alias(SLOT))


def _spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    # one explicit exchange, read by both the window branch and the border branch
    return rows.repartition(*keys, SLOT)


def _whole_keys(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous: Mapping[str, Column],
    following: Mapping[str, Column],
    carried: Mapping[str, Column],
) -> DataFrame:
    """One window over whole keys: a single exchange and sort."""
    window = Window.partitionBy(*keys).orderBy(*order)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    found = {n: F.lag(v).over(window) for n, v in previous.items()}
    found |= {n: F.lead(v).over(window) for n, v in following.items()}
    found |= {n: F.last(v, ignorenulls=True).over(earlier) for n, v in carried.items()}
    return rows.withColumns(found)


def neighbours(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    carried: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Adds columns taken from other rows of the same key, in ``order``.

    ``previous``/``following``: the value on the row just before/after, null when there is
    none. ``carried``: the last non-null value on any earlier row. Rows as :func:`slotted`
    gives them.
    """
    previous, following, carried = previous or {}, following or {}, carried or {}
    keys, by_slot = list(keys), [*keys, SLOT]
    if SLOT not in rows.columns:
        return _whole_keys(rows, keys, order, previous, following, carried)
    base = _spread(rows, keys)
    ordering = F.struct(*order)
    # border rows carry every column, so both branches read the same exchange
    whole = F.struct(*rows.columns)

    inside = Window.partitionBy(*by_slot).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = base
    back = F.struct(*[v.alias(n) for n, v in previous.items()]) if previous else None
    ahead = F.struct(*[v.alias(n) for n, v in following.items()]) if following else None
    columns = {}
    borders = [F.max_by(whole, ordering).alias("_whole")]
    if previous:
        columns["_back"] = F.lag(back).over(inside)
        borders.append(F.max_by(back, ordering).alias("_last"))
    if following:
        columns["_ahead"] = F.lead(ahead).over(inside)
        borders.append(F.min_by(ahead, ordering).alias("_first"))
    for name, value in carried.items():
        columns[f"_in_{name}"] = F.last(value, ignorenulls=True).over(earlier)
        borders.append(
            F.max_by(value, F.when(value.isNotNull(), ordering)).alias(f"_out_{name}")
        )
    out = out.withColumns(columns)

    across = Window.partitionBy(*keys).orderBy(SLOT)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    crossing = {}
    if previous:
        crossing["_before"] = F.lag("_last").over(across)
    if following:
        crossing["_after"] = F.lead("_first").over(across)
    for name in carried:
        crossing[f"_before_{name}"] = F.last(f"_out_{name}", ignorenulls=True).over(
            before
        )
    edges = (
        base.groupBy(*by_slot)
        .agg(*borders)
        .withColumns({**crossing, "_slots": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
        # keys in a single slot have nothing to hand over
        .where((F.col("_slots") > 1) & F.col("_whole").isNotNull())
        .select(*by_slot, *crossing)
    )
    out = _matching(out, edges, by_slot, "left")

    found = {}
    for name in previous:
        found[name] = F.coalesce("_back", "_before")[name]
    for name in following:
        found[name] = F.coalesce("_ahead", "_after")[name]
    for name in carried:
        found[name] = F.coalesce(f"_in_{name}", f"_before_{name}")
    return out.select(*rows.columns, *[v.alias(n) for n, v in found.items()])


def recent(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    n: int,
    name: str,
) -> DataFrame:
    """Adds the values of the up to ``n`` rows before each row, oldest first, without null ones."""
    keys, by_slot = list(keys), [*keys, SLOT]
    if SLOT not in rows.columns:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
        return rows.withColumn(name, F.collect_list(value).over(window))
    base = _spread(rows, keys)
    inside = Window.partitionBy(*by_slot).orderBy(*order)
    # wrapped, a null value keeps its place until the rows are counted off
    wrapped = F.struct(value.alias("v"))
    near = base.withColumn(
        "_near", F.collect_list(wrapped).over(inside.rowsBetween(-n, -1))
    )

    # the last n rows of a slot are all that later slots can need from it
    newest = Window.partitionBy(*by_slot).orderBy(*[F.desc(c) for c in order])
    tails = (
        base.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= n)
        .groupBy(*by_slot)
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct(*order, wrapped.alias("_v")))),
                lambda r: r["_v"],
            ).alias("_tail"),
            F.max(F.struct(*rows.columns)).alias("_whole"),
        )
    )
    across = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(-n, -1)
    edges = (
        tails.withColumns(
            {
                "_far": F.flatten(F.collect_list("_tail").over(across)),
                "_slots": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
            }
        )
        .where((F.col("_slots") > 1) & F.col("_whole").isNotNull())
        .select(*by_slot, "_far")
    )
    joined = F.when(F.col("_far").isNull(), F.col("_near")).otherwise(F.concat("_far", "_near"))
    newest_n = F.slice(
        joined, F.greatest(F.size(joined) - F.lit(n - 1), F.lit(1)), F.lit(n)
    )
    values = F.array_compact(F.transform(newest_n, lambda w: w["v"]))
    return _matching(near, edges, by_slot, "left").select(*rows.columns, values.alias(name))
