from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHING = ["id", "digest", "file", "row", "n", "node", "size", "rank", "salt", "text_a", "label", "_metadata", "guess", "spans", "before"]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use inside."""
    return lambda df: df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(r + ("en", "src0"))[:4] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))

    return make
