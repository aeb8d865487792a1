"""Spelling variants: words one edit apart, found by pivotal grams, and the usual form each leads to.

Bigrams are ordered by how many words hold them, rare ones first. A word's prefix are its three least
bigrams (all of the third kind); two of them that do not overlap and are rarest together, chosen by dynamic
programming, are its pivots. One edit spoils at most one of two pivots, and of two words that are one edit
apart, that whose prefix ends first has its other pivot among the prefix of the other one.

The positions of that bigram are limited: the edit is on one side of it, so the other side is the same in
both words, at the same distance from that end of the word. Index keys are the bigram with its untouched
side. Where that side is short, the touched one is cut in two: the edit is in one half, so the key also holds
the other one, which again is at the same distance from its end.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

RUN = "[A-Za-zÀ-ÿ]"
#: Fixed value: one of so many occurrences is misspelt on purpose.
SPOILT = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form has at least so many times the occurrences.
USUAL = 10
#: A side of so many characters is a key by itself; a shorter one gets parts of the other side.
LONG_SIDE, PARTS = 6, 2
#: Bits for the place of a bigram, of which there are at most 90 * 90.
GRAM_BITS = 13
#: Words that a task counts before it passes their counts on.
COUNTED = 250_000
#: Texts of more characters are not split at once.
AT_ONCE = 1 << 20
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def occurrences(doc_id: int | None, text: str, least: int = LEAST_LENGTH) -> Iterator[tuple[str, int]]:
    """The words of a text, some spoilt, and how often each stands there."""
    runs = re.compile(f"{RUN}{{{least},}}")
    text = text.translate(LOWER)
    found = runs.findall(text) if len(text) <= AT_ONCE else (m.group() for m in runs.finditer(text))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(found).items():
        h = zlib.crc32(run.encode(), start)
        if h % SPOILT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run, n


def counted_words(docs: DataFrame, least: int = LEAST_LENGTH, often: int = LEAST_COUNT) -> DataFrame:
    """word and n, the occurrences in all documents, of words that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
            )
            counts.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text := text.as_py():
                    for word, n in occurrences(doc_id, text, least):
                        counts[word] += n
                if len(counts) > COUNTED:
                    yield rows()
        yield rows()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = texts.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """In how many words each bigram stands. There are at most 90 * 90, as words have 90 different letters."""
    grams = F.expr("array_distinct(transform(sequence(1, length(word) - 1), i -> substring(word, i, 2)))")
    return {r.gram: r.n for r in words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()}


def order_of(counts: dict[str, int]) -> dict[str, int]:
    """The place of each bigram, rare ones first."""
    return {g: i for i, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0])))}


def chosen(word: str, counts: dict[str, int], order: dict[str, int]) -> tuple[list[int], tuple[int, int], int]:
    """The positions of a word's prefix, those of its two pivots, and the place of the prefix' last bigram."""
    grams = [(order[word[i : i + 2]], i) for i in range(len(word) - 1)]
    last = sorted(grams)[2][0]
    prefix = [i for place, i in grams if place <= last]
    # best[i]: the cheapest single pivot that ends before the position at hand
    pivots, cost = None, None
    single: tuple[int, int] | None = None
    waiting: list[tuple[int, int]] = []
    for i in prefix:
        own = counts[word[i : i + 2]]
        while waiting and waiting[0][1] <= i - 2:
            single = min(single, waiting.pop(0)) if single else waiting.pop(0)
        if single and (cost is None or single[0] + own < cost):
            cost, pivots = single[0] + own, (single[1], i)
        waiting.append((own, i))
    return prefix, pivots, last


def keys(word: str, position: int) -> Iterator[str]:
    """The keys of a bigram: each side that may be untouched, with parts of the other one where it is short."""
    size = len(word)
    for side, read, end in (("<", word, position + 2), (">", word[::-1], size - position)):
        if end >= LONG_SIDE:
            yield f"{side}{read[:end]}"
            continue
        # the longer one of the two words has `most` characters
        for most in (size, size + 1):
            cuts = [end + (most - end) * i // PARTS for i in range(PARTS + 1)]
            for a, b in zip(cuts, cuts[1:]):
                yield f"{side}{end},{most},{read[:a]},{read[size - (most - b) :] if most > b else ''}"


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other and other_n: each pair of words (word, n) that is one edit apart, in both orders.

    Words need three bigrams, so four characters or more. Each word is met as often as it has keys; a pair is
    only made where a whole key is shared, and is then verified.
    """
    words = stored(words.select("word", "n"), "spelling-words")
    counts = gram_counts(words)
    order = order_of(counts)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        kinds = (pa.uint64(), pa.bool_(), pa.string(), pa.int64())
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix, pivots, last = chosen(word, counts, order)
                # the count and the place of the prefix' last bigram in one number
                n = n << GRAM_BITS | last
                rows.extend((digest(key), i in pivots, word, n) for i in prefix for key in keys(word, i))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([columns[0].view(pa.int64()), *columns[1:]], names=["key", "pivot", "word", "n"])

    made = stored(words.mapInArrow(keyed, "key long, pivot boolean, word string, n long"), "spelling-keys")
    index = made.where("pivot").select("key", "word", "n")
    probe = made.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    last = lambda n: F.col(n).bitwiseAND(F.lit((1 << GRAM_BITS) - 1))
    met = index.join(probe, "key").where(
        (last("n") <= last("other_n"))
        & (F.abs(F.length("word") - F.length("other")) <= 1)
        & (F.levenshtein("word", "other", 1) == 1)
    )
    own = F.struct("word", F.shiftright("n", GRAM_BITS).alias("n"))
    its = F.struct(F.col("other").alias("word"), F.shiftright("other_n", GRAM_BITS).alias("n"))
    pairs = met.select(F.least(own, its).alias("a"), F.greatest(own, its).alias("b")).distinct()
    turned = [F.struct(F.col(x).alias("one"), F.col(y).alias("two")) for x, y in ("ab", "ba")]
    both = pairs.select(F.explode(F.array(*turned)).alias("p"))
    return both.select("p.one.*", F.col("p.two.word").alias("other"), F.col("p.two.n").alias("other_n"))


def followed(forms: DataFrame) -> DataFrame:
    """word and root of each (word, form): the last word that forms lead to.

    A form is USUAL times as frequent as its word, so a chain of forms has no circle and at most as many
    words as the greatest count has digits; each round doubles how far roots have come.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(onward, "root", "left_semi").isEmpty():
            return roots
        roots = stored(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def variants(docs: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near and form_n.

    A form is the near word with the most occurrences (ties: the least one) if it has USUAL times as many as
    the word; else it is null, with form_n, and the root is the word. Null and empty texts have no words;
    repeated rows count each; words of rows without a doc_id are spoilt as by an empty one. An empty table
    gives no words. Only doc_id and text are read, whatever other columns there are; texts are read whole.
    """
    words = stored(counted_words(docs), "spelling-counts")
    near = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("most")
    )
    rows = words.join(near, "word", "left")
    usual = -F.col("most.n") >= USUAL * F.col("n")
    rows = rows.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(usual, F.col("most.form")).alias("form"),
        F.when(usual, -F.col("most.n")).alias("form_n"),
    )
    rows = stored(rows, "spelling-forms")
    roots = followed(rows.where(F.col("form").isNotNull()))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
