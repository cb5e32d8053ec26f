import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, n long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with extra columns whose names clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t), 9.0, 9, 9) for i, t in rows], DOCS)
    return make


#: nulls, empty and blank texts, repeated rows, one very long word and text
ODD = [(None, "nobody has this id"), (1, None), (2, ""), (3, " \t\n "), (4, "same row same row"), (4, "same row same row"),
       (5, "x" * 300_000), (6, "word " * 60_000), (7, "ünïcode \x00 bytes \x0b\x0c here"), (8, "one")]
