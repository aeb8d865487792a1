"""Words and shingles of texts as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters between words, those of [\x20\x09-\x0D].
WHITE = " \t\n\x0b\f\r"


def text_of(column: str = "text") -> Column:
    """A text; a null one is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters other than WHITE, in order; none for an empty text."""
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def let(name: str, value: str, body: str) -> str:
    """`body` with `name` for `value`, computed once.

    A column that a lambda refers to may be moved into it by the optimizer, to be computed again for each
    element; what a lambda binds stays where it is.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def settled(condition: Column) -> Column:
    """A condition to filter by that is computed where it stands.

    The optimizer would move the filter down and repeat in it all that the condition is made of; what
    depends on the place of a row stays.
    """
    return condition & (F.monotonically_increasing_id() >= 0)


def window_hashes(hashes: str, size: int) -> str:
    """A 64-bit hash of each `size` neighbours in an array of word hashes; none where there are fewer.

    `hashes` names something bound, or a column that is used elsewhere too.
    """
    parts = ", ".join(f"get({hashes}, i + {k})" for k in range(size))
    return (
        f"if(size({hashes}) < {size}, cast(array() as array<bigint>),"
        f" transform(sequence(0, size({hashes}) - {size}), i -> xxhash64({parts})))"
    )


def packed(values: str, low: str) -> str:
    """Values with their places in the lowest bits that a place needs, ascending.

    `low` names a number with those bits set. Sorting long integers needs no comparison of pairs.
    """
    return f"sort_array(transform({values}, (x, i) -> (x & ~{low}) | i))"


def low_bits(values: str) -> str:
    """As many low bits as the places of an array need."""
    return f"(shiftleft(1L, length(bin(size({values})))) - 1)"
