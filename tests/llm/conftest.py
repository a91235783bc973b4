from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark: SparkSession):
    """A documents table of texts, numbered from 0, or of ``(doc_id, text)`` pairs."""

    def make(rows: list, lang: str | None = "en", extra: bool = False) -> DataFrame:
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None) for i, t in pairs], DOC_SCHEMA)
        if extra:  # names that operators use inside
            for c in ("score", "fp", "k", "uid", "h", "t", "near_fp", "dedup_n", "length", "sequence_id", "g", "a.b"):
                df = df.withColumn(c, df["doc_id"] * 3)
        return df

    return make


EDGE = ["", None, " \t\n", "one", "one", "two words", "x " * 30_000, "a" * 70_000, "Übergröße 日本語 🎉 <|endoftext|> it's", "the the the the the", "two words", None]


@pytest.fixture
def edge_docs(docs_of):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    return docs_of([*enumerate(EDGE), (3, "one"), (None, "no id"), (None, "no id")], extra=True)
