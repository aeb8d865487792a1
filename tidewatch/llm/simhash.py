"""SimHash near-duplicates by covering locality-sensitive hashing.

Tables look at fingerprints through bit masks that are built so that the bits in which two fingerprints
differ, up to RADIUS of them, are all hidden in some table: each bit has a non-zero vector of RADIUS + 1
bits, and the mask of a table, also such a vector, hides the bits whose vectors are orthogonal to it. For
any RADIUS vectors a non-zero one is orthogonal to all. So no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored
from tidewatch.llm.word_ids import blocks

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as an unsigned integer; 0 of a text without words.

    Words of the text, with A-Z in lower case, are taken SHINGLE at a time, repeats included; of fewer words
    all of them are the one shingle. A bit is set where it is set in over half of the shingles' hashes.
    """
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    counts, shingles = np.zeros(BITS, dtype=np.int64), 0
    before: list[bytes] = []
    for block in blocks((text or "").encode().lower()):
        words = before + block.split()
        hashes = np.fromiter(map(digest, map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))), dtype="<u8")
        if len(hashes):
            shingles += len(hashes)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        before = words[-(SHINGLE - 1) :] if len(words) >= SHINGLE - 1 else words
    if not shingles:
        return digest(b" ".join(before)) if before else 0
    return int.from_bytes(np.packbits(2 * counts > shingles, bitorder="little").tobytes(), "little")


#: Different fingerprints of one table and key that are compared with each other in one task; the pairs of
#: larger buckets are found by hiding bits one by one, see `_dealt`.
BUCKET = 4_096
#: A fingerprint with more than one of so many rows is hot; fewer than this many can be.
HOT_SHARE = 1_024


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and its fingerprint as a signed 64-bit integer."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), dtype="<u8", count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view("<i8"))], names=["doc_id", "fingerprint"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(made, "doc_id long, fingerprint long")


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table looks at, as signed 64-bit integers."""
    vectors = range(1, 1 << (radius + 1))
    own = [vectors[bit % len(vectors)] for bit in range(BITS)]
    return [_signed(sum(1 << bit for bit, v in enumerate(own) if (v & mask).bit_count() % 2)) for mask in vectors]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _linked(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join what is linked within a bucket: from each fingerprint to the least it reaches."""
    n = len(prints)
    if n == 2:
        near = int(np.bitwise_count(prints[0] ^ prints[1])) <= radius
        return [(0, 1)] if near else []
    group = np.arange(n)
    for i in range(n - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= radius)
        if len(near):
            joined = np.unique(group[np.append(near, i)])
            if len(joined) > 1:
                group[np.isin(group, joined)] = joined[0]
    return [(int(g), i) for i, g in enumerate(group) if g != i]


def _compared(rows: DataFrame, radius: int) -> DataFrame:
    """Edges within buckets of a bounded size: each bucket is compared in the task that holds it."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        edges: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                prints = np.array(held, dtype="<i8").view("<u8")
                edges.extend((held[a], held[b]) for a, b in _linked(prints, radius))

        names = ["one", "other"]
        for batch in batches:
            tables, keys, prints = (c.to_pylist() for c in batch.columns)
            for key, one in zip(zip(tables, keys), prints):
                if key != bucket:
                    close()
                    bucket, held = key, []
                held.append(one)
            one, other = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], names=names)
            edges.clear()
        close()
        one, other = zip(*edges) if edges else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], names=names)

    sorted_rows = rows.repartition("table", "key").sortWithinPartitions("table", "key")
    return sorted_rows.select("table", "key", "fingerprint").mapInArrow(compare, "one long, other long")


def _dealt(rows: DataFrame, radius: int) -> DataFrame:
    """Edges within buckets of any size, without comparing pairs.

    Two fingerprints of a bucket differ in bits that its table hides. They are within the radius when some
    `radius` of these bits, hidden alone, make them equal: so each fingerprint is dealt out under every
    choice of them, and at most 2 ** radius different ones can meet.
    """
    hidden = []
    for mask in masks(radius):
        bits = [b for b in range(BITS) if not mask >> b & 1]
        hidden.append(";".join(str(_signed(sum(1 << b for b in some))) for some in combinations(bits, radius)))
    listed = F.array(*(F.split(F.lit(h), ";").cast("array<bigint>") for h in hidden))
    rows = rows.select("fingerprint", F.explode(F.get(listed, F.col("table"))).alias("hidden"))
    met = rows.groupBy("hidden", F.expr("fingerprint & ~hidden").alias("rest")).agg(
        F.array_sort(F.collect_set("fingerprint")).alias("all")
    )
    met = met.where(F.size("all") > 1)
    return met.select(F.get("all", F.lit(0)).alias("one"), F.explode(F.slice("all", 2, 1 << radius)).alias("other"))


def edges(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b), a > b, of different fingerprints, whose links connect just what links within the radius do."""
    looked_at = F.array(*(F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks(radius)))
    keys = distinct.select("fingerprint", F.posexplode(looked_at).alias("table", "key"))
    shared = keys.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    met = stored(keys.join(shared, ["table", "key"]), "simhash-buckets")
    found = _compared(met.where(F.col("n") <= bucket), radius)
    large = met.where(F.col("n") > bucket)
    if not large.isEmpty():
        found = found.unionByName(_dealt(large, radius))
    return found.select(F.greatest("one", "other").alias("a"), F.least("one", "other").alias("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root): each node of a graph with links (a, b), a > b, and the least node it reaches; roots left out.

    Rounds of large stars (a node's larger neighbours go to its least one) and small stars (its smaller ones
    do), until every component is a star around its least node. Each round is written to the shared folder.
    """
    links = stored(links, "links")
    while True:
        repeated = links.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        chained = links.join(links.select(F.col("a").alias("b")), "b", "left_semi")
        if repeated.isEmpty() and chained.isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = stored(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "links")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Per document: doc_id, fingerprint (signed), component_id and root.

    Fingerprints that differ in at most `radius` bits are linked, and component_id is the smallest doc_id
    that a document reaches over such links, itself included; `root` is the least fingerprint it reaches.
    Texts that are null, empty or without words have fingerprint 0 and are linked like any other. A row
    without a doc_id is linked too; where no row of a component has one, component_id is null. Repeated rows
    give repeated results, an empty table none. Only doc_id and text are read, whatever other columns there are.

    Copies meet once, as one fingerprint, so no group of them is ever compared with itself. Rows of hot
    fingerprints stay where they are and get their component from a broadcast of fewer than HOT_SHARE rows.
    """
    prints = stored(fingerprints(docs), "simhash")
    counted = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    distinct = stored(counted, "simhash-distinct")
    stars = connected(edges(distinct, radius, bucket))
    members = stars.select(F.col("node").alias("fingerprint"), "root").unionByName(
        stars.select(F.col("root").alias("fingerprint"), "root").distinct()
    )
    members = members.join(distinct, "fingerprint")
    lowest = members.groupBy("root").agg(F.min("first").alias("lowest"))
    members = members.select("fingerprint", "root").join(lowest, "root")
    classes = distinct.join(members, "fingerprint", "left").select(
        "fingerprint",
        F.coalesce("lowest", "first").alias("component_id"),
        F.coalesce("root", "fingerprint").alias("root"),
        (F.col("n") * HOT_SHARE > distinct.agg(F.sum("n")).scalar()).alias("hot"),
    )
    classes = stored(classes, "simhash-classes")
    hot = F.broadcast(classes.where("hot"))
    few = prints.join(hot.select("fingerprint"), "fingerprint", "left_anti").join(classes.where("not hot"), "fingerprint")
    found = prints.join(hot, "fingerprint").unionByName(few)
    return found.select("doc_id", "fingerprint", "component_id", "root")


def as_text(fingerprint: str) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest doc_id."""
    return one_of_each_of(docs, near_duplicates(docs))


def one_of_each_of(docs: DataFrame, components: DataFrame) -> DataFrame:
    """Of each component, as `near_duplicates` has them, the document with the smallest doc_id.

    Columns stay as they are. Of rows that share that doc_id one with the least fingerprint stays, and of
    equal ones one; of a component without any doc_id one row stays.
    """
    found = stored(components, "near-duplicates")
    heads = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = heads.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("fingerprint").alias("fingerprint"))
    copies = found.groupBy("doc_id").agg(F.count("*").alias("copies"))
    heads = stored(heads.join(copies, heads["doc_id"].eqNullSafe(copies["doc_id"])).select(heads["*"], "copies"), "heads")
    alone = (F.col("copies") == 1) & F.col("doc_id").isNotNull()
    kept = docs.join(heads.where(alone).select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    others = heads.where(~alone).select(F.col("doc_id").alias("head_id"), F.col("fingerprint").alias("head_print"), "root")
    if others.isEmpty():
        return kept

    @F.pandas_udf("long")
    def printed(texts):
        import pandas as pd

        made = np.fromiter(map(fingerprint, texts), dtype="<u8", count=len(texts))
        return pd.Series(made.view("<i8"))

    # ids that came up more than once say nothing alone
    rows = docs.select(F.struct("*").alias("row"), printed(F.col("text").cast("string")).alias("own_print"))
    rows = rows.join(others, F.col("row.doc_id").eqNullSafe(F.col("head_id")) & (F.col("own_print") == F.col("head_print")))
    return kept.unionByName(rows.dropDuplicates(["root"]).select("row.*"))
