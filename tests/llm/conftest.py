from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) as a table with the documents' other columns."""

    def make(rows, source="s"):
        rows = [(i, t, "en", s[0] if s else source, None if t is None else len(t)) for i, t, *s in rows]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make
