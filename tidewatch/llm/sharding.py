"""Sharding by Karmarkar-Karp differencing: groups that stay whole, shards of near equal size.

Differencing keeps partial partitions, begins with one for each item and again and again combines the two
with the largest spread, the larger parts of one with the smaller parts of the other, until one is left.
It runs over a number of items that doesn't grow with the corpus: groups that hold a notable share of all
bytes are items of their own, all others are taken together by their hash, most in large units and some in
ever smaller ones that level out what the large ones leave.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

#: Bits of the hash that name a unit; a unit of 0 is parted again by the next bits, at each step but the last.
STEPS = (14, 10, 10, 10)
#: A group is an item of its own from this share of all bytes on, so there are at most as many.
LARGE = 4_096
#: Rows that are numbered together.
BLOCK_ROWS = 10_000


def differenced(items: Iterable[tuple[int, int]], shards: int) -> dict[int, int]:
    """The shard of each item, of items as (size, name)."""
    waiting = []
    for order, (size, name) in enumerate(sorted(items, reverse=True)):
        parts = [(size, (name,))] + [(0, ())] * (shards - 1)
        waiting.append((-size, order, parts))
    heapq.heapify(waiting)
    order = len(waiting)
    while len(waiting) > 1:
        _, _, one = heapq.heappop(waiting)
        _, _, other = heapq.heappop(waiting)
        # both have their parts by decreasing size; members are trees that are only read at the end
        parts = [
            (a + b, (m, n) if m and n else m or n) for (a, m), (b, n) in zip(one, reversed(other))
        ]
        parts.sort(key=lambda p: -p[0])
        order += 1
        heapq.heappush(waiting, (parts[-1][0] - parts[0][0], order, parts))
    placed: dict[int, int] = {}
    for shard, (_, members) in enumerate(waiting[0][2] if waiting else ()):
        left = [members]
        while left:
            some = left.pop()
            if isinstance(some, tuple):
                left.extend(some)
            else:
                placed[some] = shard
    return placed


def _unit(name: str) -> Column:
    """The unit of a hash: a number below the sum of 2 ** s over STEPS."""
    first, shift, tests = 0, 0, []
    for step in STEPS:
        part = f"(shiftright({name}, {shift}) & {(1 << step) - 1})"
        tests.append((part, first))
        first += 1 << step
        shift += step
    part, start = tests[-1]
    found = f"{start} + {part}"
    for part, start in reversed(tests[:-1]):
        found = f"if({part} = 0, {found}, {start} + {part})"
    return F.expr(f"cast({found} as int)")


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard and slot.

    Equal texts share a shard. A text's size is its UTF-8 bytes plus 1; a null text has none and goes with
    the empty ones. Slots number the rows of a shard without gaps from 0. Repeated rows and rows without a doc_id
    have slots of their own, an empty table gives no rows, and only doc_id and text are read. Where one
    group is larger than a shard's share, it fills a shard and the others are near equal.

    Texts are read once; what follows are a few numbers per row. The driver sees the sizes of at most
    LARGE groups and of the units, whose number is fixed.
    """
    text = F.col("text").cast("string")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            # groups whose hashes happen to be equal share a shard, which keeps each of them whole too
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
        ),
        "shard-sizes",
    ).withColumn("unit", _unit("text_hash"))
    per_unit = rows.groupBy("unit").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    units = {r["unit"]: r["size"] for r in per_unit}
    total, number = sum(units.values()), sum(r["n"] for r in per_unit)
    groups = rows.groupBy("text_hash", "unit").agg(F.sum("size").alias("size"))
    # at most LARGE groups can have that share each
    large = groups.where(F.col("size") * LARGE >= total).collect()
    for group in large:
        units[group["unit"]] -= group["size"]
    items = [(size, unit) for unit, size in units.items()]
    items += [(group["size"], -1 - i) for i, group in enumerate(large)]
    placed = differenced(items, shards)

    spark = docs.sparkSession
    of_units = spark.createDataFrame([(u, placed[u]) for u in units], "unit int, unit_shard int")
    of_large = spark.createDataFrame(
        [(g["text_hash"], placed[-1 - i]) for i, g in enumerate(large)], "text_hash long, large_shard int"
    )
    # spread over blocks by hash, so that no shard is numbered in one task
    blocks = max(1, number // BLOCK_ROWS)
    rows = (
        rows.join(F.broadcast(of_units), "unit")
        .join(F.broadcast(of_large), "text_hash", "left")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.coalesce("large_shard", "unit_shard").alias("shard"),
            F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(blocks)).cast("int").alias("block"),
        )
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("shard", "block").agg(F.count("*").alias("here"))
    bases = bases.select("shard", "block", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("nth", F.row_number().over(within) - 1)
    return rows.join(bases, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth")).alias("slot")
    )
