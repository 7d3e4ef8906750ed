import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session", autouse=True)
def modules(spark):
    from cashlens.llm.common import ship
    ship(spark)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text, lang, source) rows, with an extra column of a clashing name."""
    def make(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), 0.5) for r in rows],
                                     "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls in every column, empty and blank texts, ties and repeated rows, a very long text."""
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (None, "no key at all", "de", "b"),
            (4, "Same text here, twice.", "en", "a"), (4, "Same text here, twice.", "en", "a"), (5, "Same text here, twice.", "en", "a"),
            (6, words, "en", "a"), (7, "x" * 5000, "fr", "a"), (8, "ÀÉ  ß　\U0001f600 a\x0bb", "fr", "c")]
