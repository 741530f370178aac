"""Rendezvous hashing: every record key ranks all shards, the best one gets it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.llm.common import stage

#: Rows that one task of the slot ranking sorts, about.
SLOT_ROWS = 50_000


def _unit(text: Column) -> Column:
    """52 bits of the MD5 of a text, above 0 and below 1; the same in any engine."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)


def shard_of(key: str | Column, weights: Sequence[float]) -> Column:
    """Number of the shard that wins a key, from 0.

    Shard ``s`` gets the cost ``-ln(u(key, s)) / weight[s]``; the lowest cost
    wins, ties go to the lower number.  A shard's share of the keys is its share
    of the weights.  Another shard changes no other cost, so it only takes keys
    to itself.  A null key counts as the empty text.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(""))
    shards = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(float(w)).alias("w")) for s, w in enumerate(weights)])
    cost = F.transform(
        shards, lambda x: F.struct((-F.ln(_unit(F.concat(key, F.lit(":"), x["s"].cast("string")))) / x["w"]).alias("c"), x["s"].alias("s"))
    )
    return F.array_min(cost)["s"]


def assign_shards(
    docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row per document: key, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus 8 and ``slot`` numbers the rows
    of a shard from 0 without gaps, by the hash of the key, the key, size and
    CRC.  ``grown_shard`` is the shard under ``grown_weights``, else null.

    Slots need no shard in one task: rows are ranked inside ranges of the key's
    hash, and each range begins where the counts of the ranges below it end.
    Rows of a repeated key share a shard by law and sort in one range.  Null
    texts count as empty, null keys as one key (the empty text); no rows give no
    rows; further columns are not carried.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        shard_of(key, weights).alias("shard"),
        (shard_of(key, grown_weights) if grown_weights else F.lit(None).cast("int")).alias("grown_shard"),
        F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long").alias("hash"),
    )
    rows = stage(rows, "shards")
    ranges = max(1, rows.count() // (SLOT_ROWS * len(weights)))
    rows = rows.withColumn("range", F.floor(F.col("hash") * ranges / F.lit(2.0**32)).cast("int"))
    below = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "range").count().select("shard", "range", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "range").orderBy("hash", "doc_id", "size", "text_crc32")
    return (
        rows.withColumn("rank", F.row_number().over(own) - 1)
        .join(first, ["shard", "range"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id") -> None:
    """Write whole rows to one folder ``shard=N`` per shard, from every task at once."""
    docs.withColumn("shard", shard_of(key, weights)).write.partitionBy("shard").parquet(path)
