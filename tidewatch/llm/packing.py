"""Packing documents into sequences: fixed dominating sets first, then best fit.

Lengths are at most the length of a sequence, so a histogram of them has a fixed size whatever the corpus.
Which lengths share a sequence is decided on that histogram; every piece then finds its place from its
number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import stored
from tidewatch.llm.word_ids import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PLACED = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("for_length", "first", "last", "sequence", "per_sequence", "at")]
)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of all documents: ids, then the end id, cut where they are longer than a sequence.

    A null text is empty and gives the end id alone. `task` and `nth` number the pieces of a length within
    the task that made them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        last = np.array([end_id], dtype=codec.kind).tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), codec.encode(batch.column(1).to_pylist())):
                numbers = np.frombuffer(ids + last, dtype=codec.kind).astype("<u4")
                for piece, start in enumerate(range(0, len(numbers), capacity)):
                    part = numbers[start : start + capacity]
                    n = len(part)
                    rows.append((key, piece, start, n, zlib.crc32(part.tobytes()), task, seen[n]))
                    seen[n] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, PIECE)


@dataclass
class Packing:
    """How many pieces of each length go where; `placed` has rows as in PLACED."""

    capacity: int
    counts: dict[int, int]
    placed: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0

    def __post_init__(self) -> None:
        self.left = {n: c for n, c in self.counts.items() if c}
        self.taken = dict.fromkeys(self.left, 0)

    def put(self, length: int, count: int, sequence: int, per_sequence: int, at: int) -> None:
        first = self.taken[length]
        self.placed.append((length, first, first + count, sequence, per_sequence, at))
        self.taken[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: tuple[int, ...], times: int) -> None:
        """`times` sequences of exactly these lengths."""
        at = 0
        for length in lengths:
            self.put(length, times, self.sequences, 1, at)
            at += length
        self.sequences += times
        self.fixed += times

    def reduce(self) -> None:
        """Fixes sets that no other use of their largest piece can beat.

        A set with the piece beats another one when the other's pieces can be dealt to pieces of the set
        that are at least as long. Going down the lengths, with what fits beside a piece: nothing, the
        piece stays alone; something that fills the sequence, or one piece at most, the longest that
        fits; two at most, the longest that fits if it is as long as any two together, or the longest
        with the longest beside it when no two pieces longer than the latter fit.
        """
        for length in sorted(self.left, reverse=True):
            while self.left.get(length):
                chosen = self._dominating(length)
                if chosen is None:
                    break
                times = min(self.left[n] // chosen.count(n) for n in set(chosen))
                if len(chosen) > 2:
                    times = 1  # what fits beside the next one has to be looked at again
                self.fix(chosen, times)

    def _dominating(self, length: int) -> tuple[int, ...] | None:
        room = self.capacity - length
        rest = sorted(n for n in self.left if n <= room)
        count = lambda n: self.left[n] - (n == length)  # noqa: E731  without the piece itself
        rest = [n for n in rest if count(n)]
        if not rest:
            return (length,)
        smallest = [n for n in rest[:3] for _ in range(min(3, count(n)))][:3]
        longest = rest[-1]
        if longest == room or len(smallest) < 2 or sum(smallest[:2]) > room:
            return (length, longest)
        if len(smallest) == 3 and sum(smallest) <= room:
            return None
        second = max((n for n in rest if n <= room - longest and count(n) > (n == longest)), default=None)
        best = 0
        for i, n in enumerate(rest):
            other = max((m for m in rest[i:] if n + m <= room and count(m) > (m == n)), default=None)
            best = max(best, n + other if other else 0)
        if longest >= best:
            return (length, longest)
        if second is not None:
            longer = [n for n in rest if n > second for _ in range(min(2, count(n)))]
            if len(longer) < 2 or sum(longer[:2]) > room:
                return (length, longest, second)
        return None

    def best_fit(self) -> None:
        """The rest by decreasing length, each into the fullest sequence that has room for it.

        Sequences that are alike are held together: (first sequence, how many) by the room left in them.
        """
        rooms: dict[int, list[tuple[int, int]]] = {}
        present = 0  # bit r: sequences with room r
        for length in sorted(self.left, reverse=True):
            while self.left.get(length):
                wanted = self.left[length]
                fitting = present >> length
                if fitting:
                    room = length + (fitting & -fitting).bit_length() - 1
                    sequence, alike = rooms[room].pop()
                    if not rooms[room]:
                        present &= ~(1 << room)
                else:
                    room, sequence = self.capacity, self.sequences
                    alike = -(-wanted // (room // length))
                    self.sequences += alike
                each = room // length
                full = min(alike, wanted // each)
                some = min(wanted - full * each, each - 1) if full < alike else 0
                at = self.capacity - room
                after = []
                if full:
                    self.put(length, full * each, sequence, each, at)
                    after.append((room - each * length, sequence, full))
                if some:
                    self.put(length, some, sequence + full, each, at)
                    after.append((room - some * length, sequence + full, 1))
                if alike > full + bool(some):
                    after.append((room, sequence + full + bool(some), alike - full - bool(some)))
                for r, s, n in after:
                    if r:
                        rooms.setdefault(r, []).append((s, n))
                        present |= 1 << r


def packed_counts(counts: dict[int, int], capacity: int) -> Packing:
    """Reduction, then best fit, of a histogram of lengths."""
    packing = Packing(capacity, counts)
    packing.reduce()
    packing.best_fit()
    return packing


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces fill their sequence without gaps from offset 0. Texts that are null or empty give one piece of
    length 1. Rows without a doc_id and repeated rows are packed like any other, each on its own; an empty
    table gives no rows. Columns other than doc_id and text are neither read nor returned.

    Texts are encoded once, and only numbers are kept. The driver sees the histogram of lengths, at most
    `capacity` entries; the plan made of it is of the same order and sent to the tasks.
    """
    made = stored(pieces(docs, tokenizer, end_id, capacity), "pieces")
    per_task = made.groupBy("length", "task").agg(F.count("*").alias("here"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("here").alias("n")).collect()}
    packing = packed_counts(histogram, capacity)
    plan = spark.createDataFrame(packing.placed, PLACED)

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"))
    numbered = made.join(bases, ["length", "task"]).withColumn("number", F.col("base") + F.col("nth"))
    inside = F.col("number") - F.col("first")
    placed = numbered.join(
        # a few rows for each length there is, and no more lengths than `capacity`
        F.broadcast(plan),
        (F.col("length") == F.col("for_length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last")),
    )
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.floor(inside / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("at") + (inside % F.col("per_sequence")) * F.col("length")).alias("offset"),
    )
