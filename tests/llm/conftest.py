import duckdb
import pytest

from tests.conftest import SF_SMALL

EXTRA = "id long, n long, g long, k int, extra boolean, score double, piece int, digest string, segment int, length long, w long"


@pytest.fixture(scope="session")
def small_docs():
    """(doc_id, text) of the smallest documents table."""
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs, empty and very long texts, ties, repeated rows, odd characters."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    return [(1, ""), (2, None), (None, "a text without an id but with words"), (3, "Word and another. " * 6000), (4, base), (4, base),
            (5, base), (6, base + " x"), (7, "one two"), (8, "one two"), (9, "ONE\ttwo\n"), (10, " \n\t "), (11, "日本語 ﬁ ▁ \x00 é <|endoftext|> <s>"),
            (12, "a" * 3000), (13, "    " * 40 + "b"), (None, None), (-7, base)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with extra columns whose names clash with operators' own."""
    rows = [(d, t, 1, 2, 3, 4, True, 0.5, 6, "d", 7, 8, 9) for d, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, " + EXTRA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, " + EXTRA)
