"""Row validity, cleaning of key columns, before / after statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.molecules import main_fragment, reject_reason
from .dedup import keep_one


def has_format(df: DataFrame, required: list[str] | None = None) -> bool:
    """True for a non-empty table with all required columns."""
    if any(c not in df.columns for c in required or []):
        return False
    return not df.isEmpty()


def validate_structures(df: DataFrame, column: str = "smiles") -> DataFrame:
    """Add ``valid``, ``canonical_smiles`` (null when invalid) and ``reject_reason``.

    Without the column every row is invalid.
    """
    if column not in df.columns:
        return df.withColumns(
            {
                "valid": F.lit(False),
                "canonical_smiles": F.lit(None).cast("string"),
                "reject_reason": F.lit("missing_column"),
            }
        )
    flagged = df.withColumn("reject_reason", reject_reason(F.col(column)))
    return flagged.withColumns(
        {
            "valid": F.col("reject_reason").isNull(),
            "canonical_smiles": F.when(F.col("reject_reason").isNull(), F.trim(column)),
        }
    )


def validity_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total, valid and invalid rows, overall or per group."""
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("valid")).alias("valid_rows"),
        F.count_if(~F.col("valid")).alias("invalid_rows"),
    )


def clean_keys(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """Drop null and blank keys, then all but the first row of each key."""
    return keep_one(df.filter(_present(key)), key, row_id)


def _present(key: str) -> Column:
    return F.coalesce(F.trim(key) != "", F.lit(False))


def clean_key_counts(df: DataFrame, key: str) -> DataFrame:
    """What ``clean_keys`` removes: blank keys and repeats of a key."""
    per_key = df.groupBy(F.when(_present(key), F.unhex(F.sha2(key, 256))).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("c"))), F.lit(0)).alias("blank_removed"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("c") - 1)), F.lit(0)).alias("duplicates_removed"),
    )


def normalise_list(df: DataFrame, value: str, position: str, trim_first: bool = False) -> DataFrame:
    """Distinct trimmed values with the position of their first appearance.

    By default repeats are found before trimming, so values that differ only
    in blanks both stay; ``trim_first`` compares trimmed values.
    """
    seen = F.trim(value) if trim_first else F.col(value)
    first = df.groupBy(seen.alias("v")).agg(F.min(position).alias("position"))
    return first.select("position", F.trim("v").alias("value"))


def split_lines(df: DataFrame, text: str, row_id: str) -> DataFrame:
    """Non-empty trimmed lines of a text column, numbered from 0 within the text."""
    lines = F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")
    return (
        df.select(F.col(row_id), lines)
        .withColumn("line", F.trim(F.regexp_replace("line", r"\r", "")))
        .filter(F.col("line") != "")
    )


def standardise_structures(df: DataFrame, column: str = "smiles", remove_salts: bool = True) -> DataFrame:
    """Add ``standardized_smiles``: the main fragment, or the input if not valid."""
    if not remove_salts:
        return df.withColumn("standardized_smiles", F.col(column))
    kept = F.when(reject_reason(F.col(column)).isNull(), main_fragment(F.trim(column))).otherwise(F.col(column))
    return df.withColumn("standardized_smiles", kept)


def retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts, retention rate in percent, columns gained and lost."""
    counts = (
        before.select(F.lit(1).alias("b"), F.lit(0).alias("a"))
        .unionAll(after.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
        .agg(F.coalesce(F.sum("b"), F.lit(0)).alias("original_count"), F.coalesce(F.sum("a"), F.lit(0)).alias("processed_count"))
    )
    gained = [c for c in after.columns if c not in before.columns]
    lost = [c for c in before.columns if c not in after.columns]
    rate = 100.0 * F.col("processed_count") / F.nullif(F.col("original_count"), F.lit(0))
    return counts.select(
        "original_count",
        "processed_count",
        (F.col("original_count") - F.col("processed_count")).alias("removed_count"),
        F.coalesce(rate, F.lit(0.0)).alias("retention_rate"),
        F.lit(",".join(gained)).alias("new_columns"),
        F.lit(",".join(lost)).alias("removed_columns"),
    )


def coerced_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of columns read as numbers; values that are none count as null."""
    out = []
    for c in columns:
        number = F.col(c).cast("string").try_cast("double")
        out += [F.avg(number).alias(f"{c}_mean"), F.count_if(F.col(c).isNotNull() & number.isNull()).alias(f"{c}_bad")]
    return df.agg(*out)
