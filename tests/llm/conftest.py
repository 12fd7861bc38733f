from __future__ import annotations

import pandas as pd
import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string"


@pytest.fixture(scope="session")
def tables(sf):
    return {name: pd.read_parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels", "pages", "embeddings")}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "the same words here in both of these rows", "en", "a", 40, 1.0, "x"),
        (1, "the same words here in both of these rows", "en", "a", 40, 1.0, "x"),
        (2, "the same words here in both of these rows", "en", "b", 40, 1.0, "x"),
        (3, None, None, None, None, None, None),
        (4, "", "de", "a", 0, 1.0, "x"),
        (5, " \n\t ", "de", None, 3, 1.0, "x"),
        (6, long, "en", "a", len(long), 1.0, "x"),
        (7, "123 456 -- !!", "en", "b", 13, 1.0, "x"),
        (None, "a text without an id", "en", "b", 20, 1.0, "x"),
        (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
