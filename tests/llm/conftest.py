from __future__ import annotations

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) as a table of documents."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 2}", len(t or "")) for i, t in rows], COLUMNS)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, control characters, periodic text."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    period = "ab " * 400
    return [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (5, long), (6, period), (7, "one two"), (8, "one two"), (9, "\x01\x02 é日本  x"), (None, "one two three four five six")]
