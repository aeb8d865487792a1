from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def given(spark, folder):
    """The documents of the smallest tables, as rows."""
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


ODD = [
    (5, None, "en"),
    (3, "", None),
    (3, "", None),
    (None, "no id at all", "de"),
    (None, None, None),
    (9, "one", "xx"),
    (9, "one", "xx"),
    (7, " \n\t ", "fr"),
    (8, "the same words " * 40, "en"),
    (1, "the same words " * 40, "en"),
    (2, "Ünï　cödé 日本語 é \x1c 😀 <|endoftext|> it's", "en"),
    (4, "x" * 40_000, "en"),
    (6, "and so on, " * 1_500, "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    clash = "fingerprint shard slot unit block row t words found kept length piece task n_tokens root ids".split()
    rows = [(k, t, g, None, None, *("x" for _ in clash)) for k, t, g in ODD]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in clash))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
