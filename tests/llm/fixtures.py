"""Awkward documents that every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, token string, node long, path string"


def awkward(spark, texts=()):
    """Null ids and texts, empty and long texts, repeated rows, and columns whose names operators use."""
    body = " ".join(f"word{i % 997} thing{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, body), (5, body), (6, "a b c d e f g"), (7, "a b c d e f g"), (None, "some text without an id"), (None, None)]
    rows += list(enumerate(texts, 100))
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0.5, 3, "x", 9, "p") for d, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
