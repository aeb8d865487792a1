"""Order MinHash fingerprints: which k-mers are least, and in which order the text has them.

The letters are words, a k-mer is K words in a row, and the n-th time that one comes up in a text it counts
as another element, so a text is a set of numbered k-mers. Each of BINS signatures looks at the elements
whose hash falls into its share of the hash values (one permutation serves all signatures), takes the LEAST
with the smallest hashes, puts them back into the order of the text and hashes that tuple. Two texts agree
in a signature when the same elements are least in both and stand in the same order, so both what is
edited and what is moved lowers their likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.words import let, low_bits, packed, text_of, window_hashes, words

K = 5
BINS = 64
LEAST = 2
#: Bits of a hash that name its bin; bins run from -BINS/2 as hashes are signed.
SHIFT = 64 - (BINS - 1).bit_length()
#: Documents of one block of the order by doc_id, and blocks at most: beyond, blocks grow.
BLOCK_ROWS = 1_000
MOST_BLOCKS = 1 << 16
EMPTY = "--------"


def signatures(rows: DataFrame, text: str, result: str) -> DataFrame:
    """Adds `result`, an array of BINS ints, null where the text has no element for the signature.

    Texts of fewer than K words are one k-mer of all their words; texts without words have none, and all
    of their signatures are null. Equal texts have equal signatures.
    """
    rows = rows.withColumn("_w", words(F.col(text)))
    elements = let(
        "h",
        "transform(_w, w -> xxhash64(w))",
        let(
            "k",
            f"if(size(h) = 0, cast(array() as array<bigint>), if(size(h) < {K}, array(xxhash64(h)), {window_hashes('h', K)}))",
            f"if(size(array_distinct(k)) = size(k), transform(k, x -> xxhash64(x, 0)), {_numbered('k')})",
        ),
    )
    rows = rows.withColumn(result, F.expr(let("e", elements, let("low", low_bits("e"), _least("e", "low")))))
    return rows.drop("_w")


def _numbered(kmers: str) -> str:
    """Hashes of k-mers with the number of their occurrence, in the order of the text."""
    # sorted by hash: runs of equal k-mers, each in the order of the text
    by_hash = f"transform({packed(kmers, 'low')}, x -> cast(x & low as int))"
    first = f"filter(sequence(0, size(s) - 1), j -> j = 0 or get({kmers}, get(s, j)) <> get({kmers}, get(s, j - 1)))"
    numbers = "flatten(transform(f, (a, j) -> sequence(0, coalesce(get(f, j + 1), size(s)) - a - 1)))"
    # back to the order of the text: place in the upper half, number in the lower
    in_order = "sort_array(transform(s, (x, j) -> shiftleft(cast(x as bigint), 32) | get(n, j)))"
    hashed = f"transform({kmers}, (x, i) -> xxhash64(x, cast(get(o, i) & 4294967295 as int)))"
    inner = let("s", by_hash, let("f", first, let("n", numbers, let("o", in_order, hashed))))
    return let("low", low_bits(kmers), inner)


def _least(elements: str, low: str) -> str:
    """The signatures of hashed elements."""
    share = lambda x: f"shiftright({x}, {SHIFT})"
    # sorted, the first LEAST of each bin are its least
    least = f"filter(p, (x, j) -> j < {LEAST} or {share(f'get(p, j - {LEAST})')} <> {share('x')})"
    placed = f"sort_array(transform({least}, x -> struct(cast({share('x')} as int) as b, cast(x & {low} as int) as i)))"
    first = "filter(sequence(0, greatest(size(q), 1) - 1), j -> size(q) > 0 and (j = 0 or get(q, j).b <> get(q, j - 1).b))"
    own = f"transform(slice(q, a + 1, coalesce(get(f, j + 1), size(q)) - a), x -> get({elements}, x.i))"
    values = f"transform(f, (a, j) -> xxhash64({own}) & 4294967295)"
    bins = "transform(f, a -> get(q, a).b)"
    signature = "cast(get(v, cast(array_position(n, b) as int) - 1) - 2147483648 as int)"
    every = f"transform(sequence({-BINS // 2}, {BINS // 2 - 1}), b -> {signature})"
    inner = let("f", first, let("v", values, let("n", bins, every)))
    return let("p", packed(elements, low), let("q", placed, inner))


def likeness(one: str, other: str) -> Column:
    """The share of signatures that agree, of those that either text has; 1 where neither has any."""
    at = f"sequence(0, {BINS - 1})"
    same = f"size(filter({at}, i -> get({one}, i) = get({other}, i)))"
    neither = f"size(filter({at}, i -> get({one}, i) is null and get({other}, i) is null))"
    return F.expr(f"if({neither} = {BINS}, 1D, {same} / ({BINS} - {neither}))")


def as_text(column: str) -> Column:
    """Signatures as 8 hexadecimal digits each, or 8 dashes for none."""
    one = f"coalesce(lpad(lower(hex(x + 2147483648L)), 8, '0'), '{EMPTY}')"
    return F.expr(f"array_join(transform({column}, x -> {one}), '')")


def blocks(docs: DataFrame, key: str) -> Column:
    """A block of neighbours in the order of `key` for each row; rows without a key are in the first.

    Bounds are quantiles of all keys, found by one aggregate with a sketch of bounded size.
    """
    [[rows]] = docs.agg(F.count("*")).collect()
    number = min(MOST_BLOCKS, rows // BLOCK_ROWS)
    if number < 2:
        return F.lit(0)
    shares = ",".join(f"{i / number}D" for i in range(1, number))
    [[found]] = docs.agg(F.expr(f"percentile_approx({key}, array({shares}), {max(10_000, 10 * number)})")).collect()
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    # in two steps, so a row is held against few of many bounds
    step = max(1, int(len(bounds) ** 0.5))
    numbers = lambda values: f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)"
    part = f"size(filter({numbers(bounds[::step])}, b -> b <= {key}))"
    inner = f"size(filter(slice({numbers(bounds)}, ({part} - 1) * {step} + 1, {step}), b -> b <= {key}))"
    return F.coalesce(F.expr(f"if({part} > 0, ({part} - 1) * {step} + {inner}, 0)"), F.lit(0))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness to that and the next one's.

    The edited text has the last floor(n_chars / 2) characters replaced by the first as many (or all) of the
    next document's, in descending order of doc_id, with the first after the last. Rows that share a doc_id
    follow each other by a hash of their texts, rows without one come last; a single document is its own
    next. A null text is empty. An empty table gives no rows; only doc_id and text are read.

    Documents are dealt to blocks of neighbours, so order needs one exchange of the texts; the first
    document of each block is lent to the block before it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    block = blocks(rows, "doc_id")
    rows = rows.withColumn("block", block.cast("int")).withColumn("tie", F.xxhash64("text"))
    # a row per block, at most MOST_BLOCKS; the first document of a block follows on the block above it,
    # and that of the highest block on the lowest
    tops = rows.groupBy("block").agg(F.max("doc_id").alias("top")).orderBy("block").collect()
    lent = [(tops[i - 1]["block"], tops[i - 1]["top"], tops[i]["block"]) for i in range(len(tops))]
    lent = docs.sparkSession.createDataFrame(lent, "block int, top long, lent_to int")
    guests = rows.join(F.broadcast(lent), "block").where(F.col("doc_id").eqNullSafe(F.col("top")))
    guests = guests.groupBy("lent_to").agg(
        F.min("top").alias("doc_id"), F.min_by("text", "tie").alias("text"), F.min("tie").alias("tie")
    )
    every = rows.select("doc_id", "text", "tie", "block", F.lit(False).alias("guest")).unionByName(
        guests.select("doc_id", "text", "tie", F.col("lent_to").alias("block"), F.lit(True).alias("guest"))
    )
    every = signatures(every, "text", "own")
    order = Window.partitionBy("block").orderBy("guest", F.desc_nulls_last("doc_id"), "tie")
    every = every.select(
        "doc_id",
        "guest",
        "text",
        "own",
        F.lead("text").over(order).alias("next_text"),
        F.lead("own").over(order).alias("next_own"),
    ).where(~F.col("guest"))
    every = every.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    every = every.select(
        "doc_id",
        "n_chars",
        "own",
        "next_own",
        F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    every = signatures(every, "edited", "edited_own")
    return every.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("edited_own").alias("edited_fingerprint"),
        likeness("own", "edited_own").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"),
    )
