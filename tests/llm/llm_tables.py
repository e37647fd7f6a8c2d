"""Small tables for the tests of this folder, as fixtures to import; the session comes from the parent folder."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and an extra column with a clashing name."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    rows = [(1, "a b c d e f g h", 0), (1, "a b c d e f g h", 0), (2, None, 1), (3, "", 2), (None, "A B C D E F G H", 3),
            (4, " \n\t ", 4), (5, long, 5), (6, "one two", 6), (7, "one two", 7), (8, None, 8), (None, None, 9), (9, "über straße é", 10)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, n long")
