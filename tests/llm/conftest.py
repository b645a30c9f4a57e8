from __future__ import annotations

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Makes a documents table from texts (or (doc_id, text) pairs)."""

    def make(*texts, source="s"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in rows], DOC)

    return make
