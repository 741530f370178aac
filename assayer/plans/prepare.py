"""The six steps from a raw table to split, stored features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Settings
from ..operators import dedup, features, quality, rules, splits, validate
from ..session import stage
from ..sources import readers, sinks


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A key for tables that bring none.

    Ids follow the order of the files' parts.  The table is staged, as ids
    made on the fly may differ between two runs of the same plan.
    """
    if name in df.columns:
        return df
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "keyed")


def clean(df: DataFrame, settings: Settings) -> DataFrame:
    """Validate, keep valid rows, standardise, one row per structure."""
    valid = validate.validate_structures(df, settings.key_column).filter("valid").drop("reject_reason")
    plain = validate.standardise_structures(valid, "canonical_smiles", settings.remove_salts)
    return dedup.keep_one(plain, "canonical_smiles", settings.row_id, settings.keep, settings.seed)


def describe(df: DataFrame, settings: Settings) -> DataFrame:
    """Token counts, formula features when there is a formula, the fingerprint."""
    out = features.with_token_counts(df, "standardized_smiles")
    if "molecular_formula" in df.columns:
        out = features.with_formula_features(out)
    return features.with_fingerprint(out, "standardized_smiles", n_bits=settings.n_bits, radius=settings.radius)


def assign(df: DataFrame, settings: Settings) -> DataFrame:
    return splits.split_table(
        df, settings.row_id, settings.split_method, settings.target_column, settings.group_column, settings.date_column,
        **settings.ratios,
    )


@dataclass
class Prepared:
    """Tables of one run, and where they were written."""

    table: DataFrame
    statistics: DataFrame
    retention: DataFrame
    skipped_ranges: list[str]
    paths: dict[str, str]


def prepare(spark: SparkSession, source: str | DataFrame, output: str | None = None, settings: Settings | None = None) -> Prepared:
    """Load, clean, describe, filter, split and store.

    Filters run after the features they need exist.  Every row keeps its key
    from start to end, so as many rows leave the split as enter it.
    """
    settings = settings or Settings()
    raw = source if isinstance(source, DataFrame) else readers.read_table(spark, source, settings.key_column)
    raw = with_row_id(raw, settings.row_id)
    described = describe(clean(raw, settings), settings)
    _, skipped = rules.bounds_of(described, settings.ranges)
    usable = {k: v for k, v in settings.ranges.items() if k not in skipped}
    # Sizes, cuts and the output all read this table: compute it once.
    kept = stage(rules.within_ranges(described, usable), "features")
    table = assign(kept, settings)
    paths = {}
    if output is not None:
        paths = sinks.write_splits(table, output)
        paths["report"] = sinks.write_report(
            quality.missing_values(raw), f"{output.rstrip('/')}/report", quality.report(raw, settings.key_column)
        )
    return Prepared(table, splits.split_statistics(table, settings.target_column), validate.retention(raw, table), skipped, paths)


def document_split(documents: DataFrame, lower: int = 100, upper: int = 20_000) -> DataFrame:
    """The flagship query: clean, count, filter, split by source, statistics."""
    cleaned = validate.clean_keys(documents, "text", "doc_id")
    counted = features.with_token_counts(cleaned, "text", symbols=("N", "O"))
    kept = rules.within_ranges(counted, {"n_chars": {"min": lower, "max": upper}})
    # The text is read and cleaned once; the split works on this narrow table.
    narrow = stage(kept.select("doc_id", "source", "lang", "token_weight"), "documents")
    parted = splits.group_split(narrow, "doc_id", "source")
    return splits.split_statistics(parted, "lang")
