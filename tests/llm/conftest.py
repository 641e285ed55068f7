import pytest
from samples import ODD_TEXTS


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with odd texts, a null id, repeated rows and extra columns named like those the operators make."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", 1, "x", 2, "y", 3, 4) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[4], (None, "one two\nthree", "en", "s1", 1, "x", 2, "y", 3, 4), (3, "other text under the same id", "en", "s1", 1, "x", 2, "y", 3, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, node long, chunk string, size long, score long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
