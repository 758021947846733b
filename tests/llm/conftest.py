import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ta", "ri", "mon", "sel", "ka", "ou", "ben"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(words))


def edge_rows() -> list[tuple]:
    base = prose(1, 120)
    return [
        (1, base, "en", "a", 1), (2, None, "en", None, None), (3, "", None, "a", 0), (4, " \t\n  ", "fr", "b", 4), (None, prose(2, 50), "en", "a", 5), (None, None, None, None, None),
        (5, base, "en", "a", 1), (5, base, "en", "a", 1), (6, base + " extra", "fr", "a", 2), (7, prose(3, 9000), "fr", "c", 9), (8, "a b", "en", "c", 3), (9, "éß \U0001f600 ١", "fr", "c", 5), (10, "!!! 123", "en", "c", 7),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, blank and long texts, repeated rows, and columns whose names clash with internal ones."""
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    for c in ("key", "row", "n", "sid", "bucket", "ghost", "order", "label", "score", "predicted", "held_out", "host", "part", "ids", "_id", "tkey"):
        df = df.selectExpr("*", f"'x' AS {c}")
    return df.cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 11)] + [(None, 1, 0), (5, None, None), (5, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'y' AS text", "1 AS label")
