"""Seeded, engine-independent ordering of rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash32(text: Column) -> Column:
    """First 32 bits of the md5 of a string, as a bigint in [0, 2^32)."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def seeded_order(key: Column, seed: int) -> Column:
    """Pseudo-random position of a row; equal seeds give equal positions.

    Spread evenly over 2^32 values whatever the keys look like.  Ties are
    resolved by the key itself wherever this is used.
    """
    return hash32(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def content_key(*columns: Column) -> Column:
    """Collision-safe key of a row's content (used by the feature table).

    Never null: a missing value is marked, and differs from an empty text.
    """
    if len(columns) == 1:
        value = columns[0].cast("string")
        return F.sha2(F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit("value:"), value)), 256)
    return F.sha2(F.to_json(F.struct(*columns)), 256)
