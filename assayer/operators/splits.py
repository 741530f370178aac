"""Train / val / test assignment: one table with a ``split`` column.

Splits never shuffle the rows to count them off.  They find the few rows where
one part ends and the next begins, then every row is compared with those.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, NumericType

from ..functions.hashing import hash32, seeded_order
from ..session import stage
from .numbering import prefix_sums
from .ordering import group_cuts, not_after, row_at_rank, sortable

PARTS = ("train", "val", "test")


def normalised(train: float, val: float, test: float) -> tuple[float, float, float]:
    total = train + val + test
    return train / total, val / total, test / total


def exact_sizes(n: int, train: float, val: float, test: float) -> dict[str, int]:
    """Part sizes: test and val round up, train takes the rest."""
    train, val, test = normalised(train, val, test)
    n_test = math.ceil(n * test)
    n_val = math.ceil((n - n_test) * (val / (train + val)))
    return {"train": n - n_test - n_val, "val": n_val, "test": n_test}


def _unique_order(df: DataFrame, row_id: str) -> list[Column]:
    """Numeric order columns that end in the row id."""
    if isinstance(df.schema[row_id].dataType, NumericType):
        return [F.col(row_id)]
    return [hash32(F.col(row_id).cast("string")), F.col(row_id)]


def random_split(
    df: DataFrame,
    row_id: str,
    train: float = 0.7,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
    target: str | None = None,
    mode: str = "exact",
) -> DataFrame:
    """Random split in a seeded order; stratified when ``target`` is given.

    ``mode='exact'`` gives exact sizes; ``'bernoulli'`` decides each row by its
    own hash: no extra pass, sizes right on average.
    """
    if target is not None:
        return stratified_split(df, row_id, target, train, val, test, seed)
    position = seeded_order(F.col(row_id), seed)
    if mode == "bernoulli":
        _, share_val, share_test = normalised(train, val, test)
        at = position / F.lit(float(2**32))
        return df.withColumn("split", F.when(at < share_test, "test").when(at < share_test + share_val, "val").otherwise("train"))
    if mode != "exact":
        raise ValueError("mode must be 'exact' or 'bernoulli'")
    n = df.count()
    sizes = exact_sizes(n, train, val, test)
    stops = [sizes["test"], sizes["test"] + sizes["val"]]
    cuts = row_at_rank(df, [position, F.col(row_id)], [s - 1 for s in stops if 0 < s < n], n, (0, 2**32 - 1))
    placed = df.withColumn("_at", position)
    in_test, in_both = _until(stops, n, [F.col("_at"), F.col(row_id)], cuts)
    return placed.withColumn("split", F.when(in_test, "test").when(in_both, "val").otherwise("train")).drop("_at")


def _until(stops: list[int], n: int, order: list[Column], cuts: dict) -> list[Column]:
    """For each stop, a test for the first ``stop`` of ``n`` rows in ``order``."""
    return [F.lit(False) if s <= 0 else F.lit(True) if s >= n else not_after(order, cuts[s - 1]) for s in stops]


def _before(df: DataFrame, order: list[Column], n: int, stops: list[int]) -> list[Column]:
    """The same, finding the rows at the stops first."""
    return _until(stops, n, order, row_at_rank(df, order, [s - 1 for s in stops if 0 < s < n], n))


def stratified_split(
    df: DataFrame,
    row_id: str,
    target: str,
    train: float = 0.7,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
    smallest: int = 3,
) -> DataFrame:
    """Class shares kept in every part; exact sizes per class.

    Classes with fewer than ``smallest`` rows go to train.  Nulls are a class.
    """
    train, val, test = normalised(train, val, test)
    n = F.col("n")
    n_test = F.when(n >= smallest, F.ceil(n * F.lit(test))).otherwise(0)
    n_val = F.when(n >= smallest, F.ceil((n - n_test) * F.lit(val / (train + val)))).otherwise(0)
    cuts = group_cuts(df, target, seeded_order(F.col(row_id), seed), row_id, {"_test": n_test, "_val": n_test + n_val})
    cuts = cuts.withColumnRenamed(target, "_class")
    placed = df.withColumn("_here", F.struct(seeded_order(F.col(row_id), seed).alias("h"), F.col(row_id).alias("k")))
    # One row per class: broadcast after a count.  Beyond the bound Spark
    # splits the partitions of large classes at run time.
    joined = placed.join(cuts, F.col(target).eqNullSafe(F.col("_class")), "left")
    label = F.when(F.col("_here") <= F.col("_test"), "test").when(F.col("_here") <= F.col("_val"), "val").otherwise("train")
    return joined.withColumn("split", label).drop("_class", "_test", "_val", "_here")


def balanced_split(
    df: DataFrame,
    row_id: str,
    target: str,
    train: float = 0.7,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
    drop_null_class: bool = False,
) -> DataFrame:
    """Each class split on its own with the sizes of a random split."""
    if target not in df.columns:
        raise ValueError(f"column '{target}' not found")
    rows = df.filter(F.col(target).isNotNull()) if drop_null_class else df
    return stratified_split(rows, row_id, target, train, val, test, seed, smallest=1)


def group_split(
    df: DataFrame,
    row_id: str,
    group: str,
    train: float = 0.7,
    val: float = 0.15,
    test: float = 0.15,
    drop_null_groups: bool = False,
    hot_share: float = 1e-3,
) -> DataFrame:
    """Whole groups to one part: largest first, ties by first row id.

    Train is filled until it holds ``int(n * train)`` rows, then val, the rest
    is test; ratios are not normalised.  A row without a group is a group of
    its own, or is dropped with ``drop_null_groups``.

    Groups of one size are interchangeable but for their order, so the fill is
    worked out on the number of groups per size, plus one rank among the
    groups of the size where a part fills up.
    """
    rows = df.filter(F.col(group).isNotNull())
    numeric = isinstance(df.schema[row_id].dataType, NumericType)
    groups = stage(
        rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size"), F.min(row_id).alias("_first")), "groups"
    )
    alone = df.filter(F.col(group).isNull())
    lonely = alone.count()
    everyone = groups.select("_size", "_first")
    n = lonely + (groups.agg(F.sum("_size")).first()[0] or 0)
    if lonely and not drop_null_groups:
        everyone = everyone.unionAll(alone.select(F.lit(1).cast("bigint"), F.col(row_id)))
    # Groups and rows per size, and in all larger groups.
    steps = everyone.select((-F.col("_size")).alias("_down"), F.lit(1).alias("_groups"), F.col("_size").alias("_rows"))
    ladder = stage(prefix_sums(steps, "_down", ["_groups", "_rows"]), "ladder")

    # Text ids have no cheap rank; their hash decides ties between equal sizes.
    order = [F.col("_first")] if numeric else [hash32(F.col("_first").cast("string")), F.col("_first")]

    def starts_before(goal: int) -> tuple[Column, int]:
        """Groups that start before the running total reaches ``goal``, and their rows."""
        if goal <= 0:
            return F.lit(False), 0
        last = ladder.filter(F.col("_rows_before") < goal).orderBy(F.desc("_down")).first()
        if last is None:
            return F.lit(True), 0
        size, before = -last["_down"], last["_rows_before"]
        used = -(-(goal - before) // size)
        if used >= last["_groups"]:
            return F.col("_size") >= size, before + last["_rows"]
        row = row_at_rank(everyone.filter(F.col("_size") == size), order, [used - 1], last["_groups"])[used - 1]
        cut = (F.col("_size") > size) | ((F.col("_size") == size) & not_after(order, row))
        return cut, before + used * size

    in_train, reached = starts_before(int(n * train))
    in_val = starts_before(reached + int(n * val))[0] if int(n * val) > 0 else F.lit(False)
    label = F.when(in_train, "train").when(in_val, "val").otherwise("test")

    # Groups above the share number at most 1 / hot_share: safe to broadcast.
    # The others are small, so no key of the shuffle join is hot.
    labelled = groups.withColumn("split", label)
    hot = F.col("_size") > n * hot_share
    heavy = F.broadcast(labelled.filter(hot).select(group, "split"))
    light = labelled.filter(~hot).select(group, "split")
    in_heavy = rows.join(heavy, group)
    in_light = rows.join(heavy.select(group), group, "left_anti").join(light, group)
    out = in_heavy.unionByName(in_light)
    if lonely and not drop_null_groups:
        single = alone.withColumns({"_size": F.lit(1), "_first": F.col(row_id)})
        out = out.unionByName(single.withColumn("split", label).drop("_size", "_first"))
    return out.select(*df.columns, "split")


def cluster_split(
    df: DataFrame,
    features: list[str],
    train: float = 0.7,
    val: float = 0.15,
    test: float = 0.15,
    n_clusters: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """K-means clusters dealt whole to the parts in a seeded order.

    ``features`` are numeric columns (nulls count as 0) or one array column.
    """
    if n_clusters is None:
        n_clusters = max(2, min(50, df.count() // 10))
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, ArrayType):
        ready = df.withColumn("_features", array_to_vector(F.col(features[0]).cast("array<double>")))
    else:
        filled = df.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)})
        ready = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_features").transform(filled)
    model = KMeans(k=n_clusters, seed=seed, featuresCol="_features", predictionCol="cluster").fit(ready)
    found = [r["cluster"] for r in model.summary.cluster.select("cluster").distinct().collect()]  # at most k
    dealt = df.sparkSession.createDataFrame([(c,) for c in found], "cluster int").orderBy(
        seeded_order(F.col("cluster"), seed), "cluster"
    )
    order = [r["cluster"] for r in dealt.collect()]
    n_train, n_val = int(len(order) * train), int(len(order) * val)
    parts = F.when(F.col("cluster").isin(order[:n_train]), "train")
    parts = parts.when(F.col("cluster").isin(order[n_train : n_train + n_val]), "val").otherwise("test")
    return model.transform(ready).withColumn("split", parts).select(*df.columns, "cluster", "split")


def temporal_split(
    df: DataFrame, row_id: str, date: str, train: float = 0.7, val: float = 0.15, test: float = 0.15
) -> DataFrame:
    """Oldest rows to train, then val, then test; equal dates by row id, nulls last."""
    if date not in df.columns:
        raise ValueError(f"date column '{date}' not found")
    n, dated = df.agg(F.count(F.lit(1)), F.count(date)).first()
    stops = [int(n * train), int(n * train) + int(n * val)]
    unique = _unique_order(df, row_id)
    has_date = F.col(date).isNotNull()
    early = _before(df.filter(has_date), [sortable(df, date), *unique], dated, stops)
    late = _before(df.filter(~has_date), unique, n - dated, [s - dated for s in stops])
    in_train, in_both = (F.when(has_date, e).otherwise(l) for e, l in zip(early, late))
    return df.withColumn("split", F.when(in_train, "train").when(in_both, "val").otherwise("test"))


def split_statistics(df: DataFrame, target: str | None = None) -> DataFrame:
    """Rows and share of the table per split, and per class if a target is given."""
    keys = ["split"] + ([target] if target else [])
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    sizes = counts.groupBy("split").agg(F.sum("row_count").alias("split_size"))  # three rows
    total = sizes.agg(F.sum("split_size").alias("n")).scalar()
    return counts.join(F.broadcast(sizes), "split").select(
        *keys, "row_count", "split_size", (F.col("split_size") / total).alias("split_ratio")
    )


def validate_split(df: DataFrame, original: DataFrame, row_id: str) -> DataFrame:
    """One row of checks: sizes kept, no overlaps, all rows covered, overall.

    Works on row keys: one shuffle of (key, part), nothing collected.
    """
    flags = {p: F.count_if(F.col("part") == p) for p in (*PARTS, "original")}
    tagged = df.select(F.col(row_id).alias("k"), F.col("split").alias("part")).unionAll(
        original.select(F.col(row_id).alias("k"), F.lit("original").alias("part"))
    )
    per_key = tagged.groupBy("k").agg(*[c.alias(p) for p, c in flags.items()])
    placed = F.col("train") + F.col("val") + F.col("test")

    def never(condition: Column) -> Column:
        return F.count_if(condition) == 0

    checks = per_key.agg(
        F.coalesce(F.sum(placed) == F.sum("original"), F.lit(True)).alias("size_preserved"),
        never((F.col("train") > 0) & (F.col("val") > 0)).alias("no_train_val_overlap"),
        never((F.col("train") > 0) & (F.col("test") > 0)).alias("no_train_test_overlap"),
        never((F.col("val") > 0) & (F.col("test") > 0)).alias("no_val_test_overlap"),
        never((placed > 0) != (F.col("original") > 0)).alias("all_rows_covered"),
    )
    overall = F.lit(True)
    for c in checks.columns:
        overall = overall & F.col(c)
    return checks.withColumn("valid_split", overall)


def split_table(
    df: DataFrame, row_id: str, method: str = "random", target: str | None = None, group: str = "scaffold",
    date: str = "date", features: list[str] | None = None, **ratios,
) -> DataFrame:
    """Split by method name; cluster falls back to random below two features."""
    if method == "random":
        return random_split(df, row_id, **ratios)
    if method == "stratified":
        return random_split(df, row_id, target=target, **ratios)
    if method == "scaffold":
        return group_split(df, row_id, group, **ratios)
    if method == "temporal":
        return temporal_split(df, row_id, date, **ratios)
    if method == "balanced":
        return balanced_split(df, row_id, target, **ratios)
    if method == "cluster":
        numeric = features or [
            f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in (row_id, target)
        ]
        if len(numeric) < 2:
            return random_split(df, row_id, **ratios)
        return cluster_split(df, numeric, **ratios)
    raise ValueError(f"unknown split method: {method}")


def parts_of(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables from one table with a ``split`` column, on request."""
    return tuple(df.filter(F.col("split") == p).drop("split") for p in PARTS)

