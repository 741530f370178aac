"""Row numbers and running totals over a whole table or inside groups, however large a group is.

Rows are dealt by ranges of (groups, order), so a large group fills several
ranges and small ones share a range.  A row's number is its place in its range
plus the rows that its group has in earlier ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage


def number_rows(
    df: DataFrame, order: Sequence[str | Column], groups: Sequence[str] = (), number: str = "number", total: str | None = None
) -> DataFrame:
    """Number rows from 0 by ``order`` inside each group (of the whole table without ``groups``).

    ``order`` holds column names or sort expressions such as ``F.desc("x")``.
    Rows that tie in all of it are numbered in the order of the input; ties are
    cut into ranges like other rows.  Null group values form groups of their
    own.  ``total`` names a column for the group's row count, if wanted.

    The range bounds are sampled, so ``df`` is read twice: stage it first when
    it is costly.  The ranged rows are written once and joined with one row per
    (range, group): a key of that join has the rows of one range at most.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    rows = df.withColumns({n: F.col(g) for n, g in zip(names, groups)} | {"_tie": F.monotonically_increasing_id()})
    keys = [*[F.col(n).asc_nulls_first() for n in names], *order, "_tie"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    ranged = stage(ranged.withColumn("_range", F.shiftright("_at", 33)), "ranges")
    parts = ranged.groupBy("_range", *names).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_start"))
    # A group has a row per range here, and without groups there are as many rows as ranges.
    of_group = Window.partitionBy(*names)
    earlier = of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_total": F.sum("_n").over(of_group)})
    right = parts.select(F.col("_range").alias("_range2"), *[F.col(n).alias(f"{n}b") for n in names], "_start", "_before", "_total")
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}b")) for n in names], F.col("_range") == F.col("_range2"))
    numbers = {number: F.col("_before") + F.col("_at") - F.col("_start")} | ({total: F.col("_total")} if total else {})
    added = [c for c in numbers if c not in df.columns]
    return ranged.join(right, same).withColumns(numbers).select(*df.columns, *added)


def prefix_sums(df: DataFrame, by: str, values: list[str], buckets: int | None = None) -> DataFrame:
    """Sums of ``values`` per value of ``by``, and over all smaller ones: adds ``<value>_before``.

    Rows are summed per value of ``by`` before they are ordered.  Those sums are
    dealt by ranges whose bounds are sampled from themselves, so ranges have
    about as many rows each, as many ranges as the session has shuffle
    partitions or ``buckets``.  The ranges' own totals are added up before one
    another, a row per range, and a range is ordered by itself.
    """
    sums = stage(df.groupBy(by).agg(*[F.sum(v).alias(v) for v in values]), "sums")
    key = F.col(by).asc_nulls_first()
    ranged = sums.repartitionByRange(*([buckets] if buckets else []), key).withColumn("_range", F.spark_partition_id())
    ranged = stage(ranged, "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = ranged.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    offsets = totals.select("_range", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_offset") for v in values])
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = {f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"{v}_offset") for v in values}
    return ranged.join(offsets, "_range").withColumns(before).drop("_range", *[f"{v}_offset" for v in values])
