import pytest

ROWS = [
    (1, "The quick brown fox, jumps over the lazy dog.", "en", "a"),
    (2, "The quick  brown fox,\tjumps over the lazy dog.", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \n\t ", "en", "b"),
    (None, "A text without an id, under the MIT License.", "en", "b"),
    (6, "Repeated row é ñ 上海", "de", "c"),
    (6, "Repeated row é ñ 上海", "de", "c"),
    (7, "word " * 5000, "en", "c"),
    (8, "licensed under the Apache  License, Version 2.0 and CC BY-NC; under the mit licence", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns whose names clash with results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(None).cast("string") for c in ("shard", "slot", "size", "score", "row", "node", "part", "kept", "label", "id", "block", "kind", "t", "d", "length", "tie", "leaf", "position", "fp")}
    return df.withColumns(clash)
