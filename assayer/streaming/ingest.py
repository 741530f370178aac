"""Directory ingest: new CSV files are parsed, validated, stored and counted."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructType

from ..operators.validate import validate_structures

_ROWS = "file string, smiles string, fields map<string,string>, error string"
_BAD = "_malformed"


def first_lines(lines: DataFrame) -> dict[str, str]:
    """Header of every file of a table (file, start, value); one row per file reaches the driver."""
    at = F.monotonically_increasing_id()
    heads = lines.filter("start = 0").select("file", "value", at.alias("at")).groupBy("file").agg(F.min_by("value", "at").alias("value"))
    return {r["file"]: r["value"] for r in heads.collect()}


def layout_of(path: str, header: str, key_column: str) -> tuple[list[str], str | None]:
    """Columns of a file, or why it cannot be taken."""
    if not path.lower().endswith((".csv", ".csv.gz")):
        return [], "unsupported file format"
    names = next(csv.reader([header]), [])
    if len(set(names)) < len(names):
        return [], "repeated column name"
    if key_column not in names:
        return [], f"column '{key_column}' not found"
    return names, None


def parse_files(spark: SparkSession, headers: dict[str, str], key_column: str = "smiles", multi_line: bool = False) -> DataFrame:
    """Rows (file, smiles, fields, error) of CSV files given by their headers.

    One reader call per layout; the reader splits large files.  A record with
    more or fewer cells than columns has an error.  A file that cannot be taken
    is one row without a key, with its error.
    """
    layouts: dict[tuple[str, ...], list[str]] = {}
    refused = []
    for path, header in sorted(headers.items()):
        names, problem = layout_of(path, header, key_column)
        if problem:
            refused.append((path, None, None, f"file: {problem}"))
        else:
            layouts.setdefault(tuple(names), []).append(path)
    parts = [spark.createDataFrame(refused, _ROWS)]
    for names, paths in layouts.items():
        schema = reduce(lambda s, n: s.add(n, StringType()), [*names, _BAD], StructType())
        table = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("mode", "PERMISSIVE")
        table = table.option("columnNameOfCorruptRecord", _BAD).option("escape", '"').csv(paths)
        others = [n for n in names if n != key_column]
        cells = F.create_map(*[x for n in others for x in (F.lit(n), F.col(f"`{n}`"))]) if others else F.create_map()
        parts.append(
            table.select(
                F.col("_metadata.file_path").alias("file"),
                F.col(f"`{key_column}`").alias("smiles"),
                cells.cast("map<string,string>").alias("fields"),
                F.when(F.col(_BAD).isNotNull(), "malformed record").alias("error"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def file_status(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: status, total, valid and invalid rows, error; files without rows count too."""
    refused = F.col("error").startswith("file: ")
    is_row = F.col("file").isNotNull() & ~F.coalesce(refused, F.lit(False))
    good = F.col("valid") & F.col("error").isNull()
    counted = rows.groupBy("file").agg(
        F.count_if(is_row).alias("total_rows"),
        F.count_if(is_row & good).alias("valid_rows"),
        F.count_if(is_row & ~good).alias("invalid_rows"),
        F.max(F.when(refused, F.substring("error", 7, 1000))).alias("error"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total_rows", "valid_rows", "invalid_rows")}
    return files.join(counted, "file", "left").withColumns(zero).withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise("completed"))


def ingest_directory(
    spark: SparkSession,
    folder: str,
    results: str,
    status: str,
    checkpoint: str,
    key_column: str = "smiles",
    files_per_batch: int = 1000,
    multi_line: bool = False,
) -> StreamingQuery:
    """Process every file in ``folder`` not seen before, then stop.

    The stream finds the new files and their headers; their records are read by
    the CSV source, whatever the size of a file.  Bad files are marked and the
    stream goes on.  Each batch writes its own sub-folder, overwritten if the
    batch is run again, so a restart after a failure leaves no doubles.
    """
    lines = (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        headers = first_lines(batch)
        rows = validate_structures(parse_files(spark, headers, key_column, multi_line), "smiles")
        target = f"{results.rstrip('/')}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(target)
        stored = spark.read.schema(rows.schema).parquet(target)
        files = spark.createDataFrame([(f,) for f in sorted(headers)], "file string")
        file_status(stored, files).write.mode("overwrite").parquet(f"{status.rstrip('/')}/batch={batch_id}")

    return lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
