"""What several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.session import stage

__all__ = ["arrow_batches", "crc32_fold", "pieces", "read", "span_digest", "stage"]

#: Texts that a Python task holds as objects at a time, in characters and rows.
PIECE_CHARS, PIECE_ROWS = 4_000_000, 1_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def crc32_fold(column: str | Column, folds: int) -> Column:
    """crc32 of a key as text, modulo ``folds``; a null key counts as empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))) % folds


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that no piece has much more than ``PIECE_CHARS`` of text.

    A row is never divided; a text longer than the limit is a piece of its own.
    """
    for batch in batches:
        at = batch.schema.get_field_index(text)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        first, held = 0, 0
        for row, size in enumerate(sizes):
            if row > first and (held + size > PIECE_CHARS or row - first >= PIECE_ROWS):
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        if len(sizes) > first:
            yield batch.slice(first)


def arrow_batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def span_digest(spans: Column) -> Column:
    """sha256 of ``kind:start:end`` texts joined by commas."""
    return F.sha2(F.array_join(spans, ","), 256)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``rows`` labelled texts, chosen by a hash of the key: doc_id, text, label.

    ``keep`` is a condition on ``doc_id`` that says which labels may be seen.
    Repeated labels of a key count by their mean, null labels not at all.  Equal
    rows of a key count once, and different texts of one key count against
    ``rows`` too: digests decide which, ``rows`` at most, and are broadcast.
    Only the chosen texts move, spread over the tasks.
    """
    chosen = (
        labels.select(F.col(key).alias("doc_id"), F.col(label).cast("double").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    digest = F.sha2("text", 256)
    known = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", digest.alias("digest")).distinct()
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(rows)
    # A list per key keeps the digest out of the join's keys: only texts of chosen keys are hashed.
    known = known.groupBy("doc_id", "label").agg(F.collect_list("digest").alias("digests"))
    found = texts.join(F.broadcast(known), "doc_id").withColumn("digest", digest).where(F.array_contains("digests", F.col("digest")))
    return found.dropDuplicates(["doc_id", "digest"]).select("doc_id", "text", "label")
