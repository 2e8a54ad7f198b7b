import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """Texts by id on the driver, for brute-force versions."""
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows and copies, and clashing extra columns."""
    rows = [
        (1, "the first text has seven words here", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "en"), (None, "a text without any id at all", "en"),
        (5, "the first text has seven words here", "en"), (6, "word " * 60_000, "en"), (7, "1234 5678 !!", None), (7, "1234 5678 !!", None),
        (8, "einzwei drei vier, fünf sechs sieben", "de"), (9, "short", "de"), (10, "çà été là\nété\x00", "fr"),
    ]
    extra = ["'x' AS score", *(f"{i} AS {c}" for i, c in enumerate(["n_lines", "held_out", "rep", "key", "kept", "t", "first", "lang_pred", "part", "label"]))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", *extra)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
