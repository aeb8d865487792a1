"""Quality rules: word and line counts, and how far a document's histograms are from its language's.

Two histograms of a document, of character classes and of common words, are held against those of its
language by Jensen-Shannon distance (the root of the divergence, base 2: 0 alike, 1 nothing in common).
The language's are the medians over all its different texts that pass the counts. Documents that are too
short for a histogram to say anything are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored
from tidewatch.llm.words import WHITE, let, settled, text_of, window_hashes, words

#: Signs that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Characters of each class, taken out of the text in this order; what is left is the last class.
CLASSES = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "white": WHITE,
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "symbol": SYMBOLS,
    "point": ".,;:!?'\"()-",
}
#: Common words of each language, as they stand in running text.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf",
    "en": "the of and to in a is that for it was on",
    "es": "de la que el en y a los se del las un",
    "fr": "de la le et les des en un du une que est",
}
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the rules."""

    least_words: int = 20
    repeat_percent: int = 30
    #: Fewer words than this and the histograms are not looked at.
    least_words_compared: int = 80
    #: Jensen-Shannon distances beyond which a document is not of its language.
    class_distance: float = 0.30
    word_distance: float = 0.265
    common: dict[str, str] = field(default_factory=lambda: dict(COMMON))


def _class_counts(rows: DataFrame) -> DataFrame:
    """Adds `classes`, how many characters of each class `t` has, and word_chars and n_symbols."""
    rest, counts = "t", []
    for i, signs in enumerate(CLASSES.values()):
        rows = rows.withColumn(f"t{i}", F.translate(rest, signs, ""))
        counts.append(F.length(rest) - F.length(f"t{i}"))
        rest = f"t{i}"
    names = list(CLASSES)
    return rows.select(
        "row",
        "t",
        F.array(*counts, F.length(rest)).alias("classes"),
        (F.length("t") - counts[names.index("white")]).cast("long").alias("word_chars"),
        counts[names.index("symbol")].cast("long").alias("n_symbols"),
    )


def _histograms(docs: DataFrame, rules: Rules) -> DataFrame:
    """Adds to the wrapped rows: words, `classes` and `commons`, how often each common word stands there.

    `row` holds the document as it came, so no column of it can clash with those made here.
    """
    rows = docs.select(F.struct("*").alias("row")).select("row", text_of("row.text").alias("t"))
    rows = _class_counts(rows).withColumn("words", words(F.col("t")))
    listed = F.lit(None).cast("array<string>")
    for lang, common in sorted(rules.common.items()):
        listed = F.when(F.col("row.lang") == lang, F.split(F.lit(common), " ")).otherwise(listed)
    rows = rows.withColumn("listed", listed)
    rows = rows.withColumn("found", F.expr(let("l", "listed", "filter(words, w -> array_contains(l, w))")))
    counts = "transform(listed, c -> size(found) - size(array_remove(found, c)))"
    return rows.withColumn("commons", F.expr(f"concat({counts}, array(size(words) - size(found)))"))


def distance(own: str, reference: str) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null where either is null or empty."""
    part = (
        "if({0} > 0, ({0} / {1}) * log2(2 * ({0} / {1}) / ({0} / {1} + {2} / {3})), 0D)"
    )
    own_part = part.format("c", f"{own}_n", "r", f"{reference}_n")
    other_part = part.format("r", f"{reference}_n", "c", f"{own}_n")
    terms = f"zip_with({own}, {reference}, (c, r) -> ({own_part} + {other_part}) / 2)"
    return F.expr(
        f"if({own}_n > 0 and {reference}_n > 0,"
        f" sqrt(greatest(0D, aggregate({terms}, 0D, (s, x) -> s + x))), cast(null as double))"
    )


def _counted(docs: DataFrame, rules: Rules) -> DataFrame:
    """Adds to `_histograms` the counts of words, lines and repeats, and base_failed."""
    rows = _histograms(docs, rules).withColumn("n_words", F.size("words").cast("long"))
    white = "concat(' ', char(9), char(10), char(11), char(12), char(13))"
    rows = rows.withColumn("lines", F.expr(f"filter(split(t, char(10)), x -> btrim(x, {white}) <> '')"))
    rows = rows.withColumn("n_dup_lines", F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)"))
    rows = rows.withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
    rows = rows.withColumn("windows", F.expr(window_hashes("hashes", WINDOW)))
    # only where a window repeats are they put in order: places next to an equal hash
    rows = rows.withColumn(
        "sorted",
        F.expr(
            "if(size(array_distinct(windows)) = size(windows), cast(array() as array<struct<h: bigint, i: int>>),"
            " sort_array(transform(windows, (h, i) -> struct(h, i))))"
        ),
    )
    rows = rows.withColumn(
        "places",
        F.expr(
            "sort_array(transform(filter(sorted, (x, k) -> get(sorted, k - 1).h = x.h or get(sorted, k + 1).h = x.h),"
            " x -> x.i))"
        ),
    )
    covered = f"transform(places, (p, k) -> least({WINDOW}, coalesce(get(places, k + 1) - p, {WINDOW})))"
    rows = rows.withColumn("n_repeat_words", F.expr(f"aggregate({covered}, 0L, (s, x) -> s + x)"))
    return rows.withColumn(
        "base_failed",
        settled(
            (F.col("n_words") < rules.least_words)
            | (F.lit(100) * F.col("n_repeat_words") > F.lit(rules.repeat_percent) * F.col("n_words"))
        ),
    )


#: Shares of a histogram are taken in steps of one in so many, which bounds what a median is looked for in.
STEPS = 10_000

#: What the verdict on a document is made of, beside its own columns.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def profiles(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents' columns without the texts as `row`, with their counts, histograms and the text's digest."""
    rest = F.struct(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "text"))
    digest = F.md5(F.col("t").cast("binary")).alias("digest")
    return _counted(docs, rules).select(rest.alias("row"), digest, *COUNTS, "classes", "commons")


def _references(profiled: DataFrame, rules: Rules) -> DataFrame:
    rows = profiled.where(~F.col("base_failed") & (F.col("n_words") >= rules.least_words_compared))
    rows = rows.where(F.col("row.lang").isin(*rules.common))
    share = f"transform({{0}}, c -> c * {STEPS}L div aggregate({{0}}, 0L, (s, x) -> s + x))"
    shares = F.concat(*(F.expr(share.format(name)) for name in ("classes", "commons")))
    rows = rows.select(F.col("row.lang").alias("ref_lang"), "digest", shares.alias("shares"))
    rows = rows.groupBy("ref_lang", "digest").agg(F.min("shares").alias("shares"))
    bins = rows.select("ref_lang", F.posexplode("shares").alias("bin", "share"))
    counted = bins.groupBy("ref_lang", "bin", "share").agg(F.count(F.lit(1)).alias("n"))
    # STEPS + 1 rows a bin at most
    one = Window.partitionBy("ref_lang", "bin")
    passed = F.sum("n").over(one.orderBy("share")) * 2 >= F.sum("n").over(one)
    medians = counted.withColumn("passed", passed).where("passed").groupBy("ref_lang", "bin").agg(F.min("share").alias("share"))
    listed = F.sort_array(F.collect_list(F.struct("bin", "share")))["share"]
    ends = len(CLASSES) + 1
    return medians.groupBy("ref_lang").agg(listed.alias("medians")).select(
        "ref_lang",
        F.slice("medians", 1, ends).alias("ref_classes"),
        F.slice("medians", F.lit(ends + 1), F.size("medians")).alias("ref_commons"),
    )


def references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per language with common words, the median share of each bin of its texts' histograms; a row for each at most.

    Each different text that passes the base rules and is long enough counts once. So neither repeats of a
    text nor its length make it count for more, junk that the counts already reject does not count, and other
    junk does not move the medians while most texts are none. Of two middle shares the smaller one is taken.
    """
    return _references(profiles(docs, rules), rules)


def _verdicts(rows: DataFrame, reference: DataFrame, rules: Rules) -> DataFrame:
    # a row for each language that has a list of common words, no more
    rows = rows.join(F.broadcast(reference), F.col("row.lang") == F.col("ref_lang"), "left")
    for name in ("classes", "commons", "ref_classes", "ref_commons"):
        rows = rows.withColumn(f"{name}_n", F.expr(f"aggregate({name}, 0L, (s, x) -> s + x)"))
    rows = rows.withColumn("class_distance", distance("classes", "ref_classes"))
    rows = rows.withColumn("word_distance", distance("commons", "ref_commons"))
    far = (F.col("n_words") >= rules.least_words_compared) & (
        (F.col("class_distance") > rules.class_distance) | (F.col("word_distance") > rules.word_distance)
    )
    return rows.withColumn("kept", settled(~F.col("base_failed") & ~F.coalesce(far, F.lit(False))))


def measured(docs: DataFrame, reference: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents as `row`, with the counts, the two distances, base_failed and kept.

    A null text has no words. A document without a language, or of one without a reference, is judged by
    its counts alone. Every row is judged by itself: repeated rows give equal results, and an empty table
    gives none. Very long texts are taken whole; repeated windows are found by sorting their hashes.
    """
    return _verdicts(_counted(docs, rules), reference, rules)


def judged(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """`measured` against `references` of the same documents; `row` holds all columns but the text.

    The texts are read once: their profiles are written to the shared folder, and references and verdicts
    are made of those.
    """
    profiled = stored(profiles(docs, rules), "quality")
    return _verdicts(profiled, _references(profiled, rules), rules)


def passing(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept against their own `references`, with their columns as they came."""
    return measured(docs, references(docs, rules), rules).where("kept").select("row.*")
