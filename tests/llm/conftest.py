from __future__ import annotations

import pytest
from planted_texts import prose

#: Names that the operators use inside, as columns of the caller.
CLASHING = ["row", "id", "fp", "size", "score", "s", "body", "spans", "words", "host", "k_id", "key", "label", "found"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    same = (7, prose(7), "en", "src1", 100)
    return [
        (1, None, None, None, None),
        (None, "some words of a row without an id", "en", None, 5),
        (None, None, None, "src1", None),
        (2, "", "en", "src1", 0),
        (3, " \n\t ", "en", "src1", 4),
        (4, "word", "de", "src2", 4),
        (5, prose(5, 30000), "en", "src2", None),
        (6, "é🙂 ñandú 漢字 " * 40, "es", "src2", 1),
        same, same, same,
        (8, same[1], "en", "src3", 100),
        (9, "a line\n" * 30 + "\0 end", "en", "src3", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, SCHEMA)
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(12)] + [(3, 0, 1), (None, 1, 0), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
