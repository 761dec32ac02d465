from __future__ import annotations

import os

import pytest

SF_DIR = os.environ.get("VOLTFRAME_TEST_SF", "/root/testdata/sf0.001")

# Null in every column, empty and blank texts, ties, a repeated row, a very long line, letters beyond ASCII.
ODD_ROWS = [
    (1, "The cat sat on the mat and said nothing at all.", "en", "a", 47),
    (2, "The cat sat on the mat and said nothing at all.", "en", "b", 47),
    (2, "The cat sat on the mat and said nothing at all.", "en", "b", 47),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n\t \n", "en", None, 5),
    (6, "Ünïcode é中 ▁ x\x00y  two  spaces\n", "de", "c", 30),
    (None, "Row without an id, but with a text of its own.", "en", "a", 46),
    (7, "word " * 30000, "en", "a", 150000),
    (8, "12345 !!! ---", "en", "a", 13),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def text_spark(spark):
    from voltframe.llm.common import prepare

    return prepare(spark)


@pytest.fixture(scope="session")
def odd(text_spark):
    """Odd rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = text_spark.createDataFrame(ODD_ROWS, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("id", "_id", "_text", "_n", "_k1", "_found", "word", "n", "fill", "_key", "_lang")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts(text_spark):
    """Documents of the smallest test tables by id."""
    path = f"{SF_DIR}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not available")
    return dict(text_spark.read.parquet(path).select("doc_id", "text").collect())
