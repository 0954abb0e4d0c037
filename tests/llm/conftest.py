import pytest

LONG = "Zebra crossing, Über alles; " * 6000


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, "The Cat sat", "a"), (2, "the cat SAT", "a"), (3, None, None), (4, "", "b"), (5, LONG, "b"), (6, LONG.upper().lower(), "b"), (7, "Ünï Code", "a"),
        (8, "ünï code", "a"), (9, "one two three four five six seven", "c"), (9, "one two three four five six seven", "c"), (None, "no id", "a"), (None, None, "c"),
        (10, "  \n\t ", "a"), (11, "one two three four five six seven eight", "c"), (12, "x", None),
    ]
    own = ("_id", "_text", "key", "size", "shard", "fp", "rep", "block", "position", "score", "recipe", "text_sha256", "_y", "_kept_id", "_gone_id", "_mix_id", "n")
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(7).alias(c) for c in own])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, quality int, toxic int")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, None, None), (9, 1, 0), (9, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
