"""Frames that every corpus operator has to live with."""

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=False):
    """(doc_id, text[, source]) rows as a documents table, optionally with extra, clashing columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if extra:
        from pyspark.sql import functions as F
        names = ["hash", "row", "size", "component_id", "n_tokens", "shard", "score", "block", "key", "label", "Start", "rank", "_id", "_s", "_k", "_h", "_take", "_gone", "_twice", "_meta", "_row", "_bytes", "_cell", "row_id", "runs", "whole"]
        df = df.select("*", *[F.lit(7).alias(n) for n in names])
    return df


@pytest.fixture
def docs(spark):
    return lambda rows, extra=False: documents(spark, rows, extra)


@pytest.fixture(scope="session")
def edge_rows():
    long = "alpha beta gamma delta " * 20000
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, long), (7, "Ünï cödé 漢字 😀 text"),
            (None, "no id here at all"), (8, "tie"), (8, "tie"), (9, "tie")]
