from __future__ import annotations

import pytest

#: Every documents column, and names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int, shard int, id long, bands string"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text[, source]) as a table with further columns whose names clash."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.5, 3, 9, -1, "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build
