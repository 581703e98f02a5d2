from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of all the awkward kinds, with columns beyond the usual ones."""
    long = "word and another " * 30_000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "s", 1),
        (2, "The quick brown fox jumps over the lazy dog.", "en", "s", 1),
        (2, "The quick brown fox jumps over the lazy dog.", "en", "s", 1),
        (3, None, "en", None, None), (4, "", None, "s", 0), (5, " \n\t ", "fr", "s", 3), (6, long, "en", "s", len(long)),
        (7, "1234 5678 ... !!!", "de", "s", 5), (8, "日本語 テキスト 🙂", "ja", "s", 9), (9, "<|endoftext|> special <|endoftext|>", "en", "s", 30),
        (None, "no id here at all", "en", "s", 17), (None, None, None, None, None), (10, "a", "en", "s", 1), (11, "one two", "en", "s", 7),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    # names that the operators use inside
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).withColumns({"score": F.lit("clash"), "fp": F.lit(1), "id": F.lit("x"), "length": F.lit(2.5), "piece": F.lit(None).cast("string")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def rows(df):
    return [tuple(r) for r in df.collect()]
