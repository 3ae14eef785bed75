import random

import pytest
from pyspark.sql import functions as F

#: Names that operators use inside; a table may have columns of those names.
CLASHING = ("w", "lines", "grams", "places", "doc_text", "row_key", "blocks", "score", "label", "held_out", "node", "fps", "fp", "root", "component_id", "anchors", "anchor", "shard", "family", "hashes", "kept", "n_words", "digest", "size", "keeper", "payload", "spans", "token_ids", "decoded", "hash", "units", "content", "doc_row")


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])


def prose(n, seed, words=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in each column, empty and white texts, repeated rows, one doc_id twice, a very long text, and copies."""
    long = prose(60_000, 1)
    copy = prose(120, 2)
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one two three"), (6, copy), (7, copy), (7, copy), (8, "z " * 40 + "\n" + copy + "\nend"), (8, "other text of the same id"),
        (None, copy), (None, None), (9, long), (10, "é漢\U0001f600 \x85\xa0 nbsp"), (11, "a\n" * 30), (12, prose(300, 3)),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return clashing(spark.createDataFrame(odd_rows, "doc_id long, text string")).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return clashing(spark.createDataFrame([], "doc_id long, text string"))
