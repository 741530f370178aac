"""De-duplication by key, duplicate counts, and the keyed feature table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from ..functions.hashing import content_key, seeded_order


def keep_one(
    df: DataFrame, key: str | list[str], row_id: str, method: str = "first", seed: int = 42, null_keys: str = "collapse"
) -> DataFrame:
    """One row per key: the ``first`` or ``last`` by row id, or a ``random`` one.

    ``row_number() = 1`` lets Spark cut every map task's output to one row per
    key before the shuffle, so a key held by a third of the table sends one
    row per task and not its whole group.  ``null_keys='keep'`` leaves rows
    without a key alone; ``'collapse'`` treats nulls as one key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orders = {
        "first": [F.col(row_id).asc()],
        "last": [F.col(row_id).desc()],
        "random": [seeded_order(F.col(row_id), seed), F.col(row_id)],
    }
    if method not in orders:
        raise ValueError(f"unknown method '{method}'; one of {', '.join(orders)}")
    if null_keys not in ("collapse", "keep"):
        raise ValueError("null_keys must be 'collapse' or 'keep'")
    digests = {f"_key{i}": comparable(df, k) for i, k in enumerate(keys)}
    ranked = Window.partitionBy(*digests).orderBy(*orders[method])

    def first_rows(part: DataFrame) -> DataFrame:
        """Text keys are compared by digest: a text is shuffled only if the output keeps it."""
        return part.withColumns(digests).withColumn("_rn", F.row_number().over(ranked)).filter(F.col("_rn") == 1).drop("_rn", *digests)

    if null_keys == "collapse":
        return first_rows(df)
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    return first_rows(df.filter(complete)).unionByName(df.filter(~complete))


def comparable(df: DataFrame, column: str) -> Column:
    """A short stand-in for a column's value: text by its SHA-256 digest."""
    if isinstance(df.schema[column].dataType, StringType):
        return F.unhex(F.sha2(F.col(column), 256)).alias(column)
    return F.col(column)


def duplicate_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first, over whole rows and over the key; nulls are equal.

    Text is compared by its digest, so only digests are shuffled.
    """

    def extra(columns: list[str], name: str) -> DataFrame:
        sizes = df.groupBy(*[comparable(df, c) for c in columns]).agg(F.count(F.lit(1)).alias("c"))
        return sizes.select(F.lit(name).alias("scope"), (F.col("c") - 1).alias("extra"))

    both = extra(df.columns, "row").unionAll(extra([key], "key"))
    return both.agg(
        F.coalesce(F.sum(F.when(F.col("scope") == "row", F.col("extra"))), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(F.col("scope") == "key", F.col("extra"))), F.lit(0)).alias("duplicate_keys"),
    )


def with_content_key(df: DataFrame, columns: list[str], name: str = "content_key") -> DataFrame:
    return df.withColumn(name, content_key(*[F.col(c) for c in columns]))


def unseen(df: DataFrame, known: DataFrame, key: str = "content_key") -> DataFrame:
    """Rows whose key is not in the feature table yet, one per key.

    Copies go first, in every map task, so that a hot key does not reach the
    join; the join then finds the rows already placed by key.
    """
    return df.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def attach(df: DataFrame, features: DataFrame, key: str = "content_key", hot_share: float = 1e-3) -> DataFrame:
    """Join one feature row to every row with its key, hot keys apart.

    Keys held by more than ``hot_share`` of all rows number at most
    ``1 / hot_share``; that bound makes their feature rows safe to broadcast.
    All other keys go through an ordinary shuffle join.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    hot = counts.filter(F.col("c") > total * F.lit(hot_share)).select(key)
    hot_features = features.join(F.broadcast(hot), key, "left_semi")
    in_hot = df.join(F.broadcast(hot_features), key, "inner")
    others = df.join(F.broadcast(hot), key, "left_anti").join(features, key, "inner")
    return in_hot.unionByName(others)


def refresh_features(
    df: DataFrame,
    columns: list[str],
    table_path: str,
    compute: Callable[[DataFrame], DataFrame],
    key: str = "content_key",
) -> DataFrame:
    """Compute features only for content not in the Parquet table at ``table_path``.

    New rows are appended there, then every input row gets its features.
    ``compute`` takes the distinct content and adds feature columns.  One
    changed row costs one computation, not the whole table.
    """
    spark = df.sparkSession
    keyed = with_content_key(df, columns, key)
    content = keyed.select(key, *columns)
    try:
        stored = spark.read.parquet(table_path)
        new = unseen(content, stored, key)
    except Exception as problem:  # first run: the table is not there yet
        if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER_SCHEMA" not in str(problem):
            raise
        new = content.dropDuplicates([key])
    compute(new).drop(*columns).write.mode("append").parquet(table_path)
    # Two runs at once can append the same content; a key counts once.
    return attach(keyed, spark.read.parquet(table_path).dropDuplicates([key]), key)
