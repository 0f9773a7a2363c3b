import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank long, blob string"


def frame(spark, rows, schema=SCHEMA):
    """Rows (doc_id, text, source) as documents with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, None, s, None, -1, None, "x") for i, t, s in rows], schema)


def clashing(spark):
    """Two texts whose 32-bit hashes are equal."""
    from pyspark.sql import functions as F

    texts = spark.range(400_000).select(F.concat(F.lit("some words of a text with the number "), F.col("id").cast("string")).alias("text"))
    pairs = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("texts")).where("size(texts) > 1")
    return sorted(pairs.first().texts)[:2]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "délta", "token", "=", "epsilon.", "x" * 90, "\U0001f600", "secret:abcdef", "deadbeef" * 4]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["a", "b", "é", None])) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (None, "alpha beta", None), (None, None, None), (102, "  \n\t ", "a")]
    rows += [(103, "word " * 60_000, "b"), (104, "y" * 200_000, "c"), (105, "alpha\n\n beta\tgamma  ", "a")]
    rows += [rows[3], rows[3], (200, rows[3][1], "z"), (201, rows[4][1], "a")]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
