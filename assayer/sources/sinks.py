"""Writers for tables, splits and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from .readers import suffix_of

_WRITERS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write by suffix (a folder of part files); an unknown suffix raises."""
    kind = _WRITERS.get(suffix_of(path))
    if kind is None:
        raise ValueError(f"unsupported output format: {path}")
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)
    return path


def write_splits(df: DataFrame, folder: str, prefix: str = "", kind: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    """One pass over a table with a ``split`` column, one sub-folder per split.

    Readers of one split prune the others by the partition column.
    """
    base = f"{folder.rstrip('/')}/{prefix}splits"
    writer = df.write.mode(mode).partitionBy("split")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(base)
    return {name: f"{base}/split={name}" for name in ("train", "val", "test")}


def write_report(metrics: DataFrame, path: str, text: str | None = None, mode: str = "overwrite") -> str:
    """A metric table as JSON lines, or rendered text, at ``path``."""
    if text is None:
        metrics.coalesce(1).write.mode(mode).json(path)
    else:
        spark = metrics.sparkSession
        lines = spark.createDataFrame([(text,)], "value string")
        lines.coalesce(1).write.mode(mode).text(path)
    return path


def write_result(spark, result: dict, path: str, mode: str = "overwrite") -> str:
    """A nested result (a small dictionary) as one JSON document."""
    body = json.dumps(result, indent=2, sort_keys=True, default=str)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode(mode).text(path)
    return path
