from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, a long, row string"


@pytest.fixture
def documents(spark):
    """A documents table from texts, or from (id, text) pairs, with columns of clashing names."""

    def build(rows):
        pairs = [row if isinstance(row, tuple) else (i, row) for i, row in enumerate(rows)]
        full = [(i, t, "en", "src", None if t is None else len(t), 7, None, "x") for i, t in pairs]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def texts(spark, small):
    """The small documents table as (doc_id, text)."""
    return [tuple(row) for row in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
