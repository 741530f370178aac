import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import ordering, splits


def sizes_of(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


@pytest.mark.parametrize("n, expected", [(100, (69, 16, 15)), (15, (9, 3, 3)), (94, (65, 14, 15))])
def test_exact_sizes(n, expected):
    sizes = splits.exact_sizes(n, 0.7, 0.15, 0.15)
    assert (sizes["train"], sizes["val"], sizes["test"]) == expected


def test_random_split_is_exact_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(ordering, "WINDOW", 30)
    df = spark.range(2000).withColumnRenamed("id", "row_id").repartition(7)
    first = splits.random_split(df, "row_id", 0.8, 0.1, 0.1)
    assert sizes_of(first) == splits.exact_sizes(2000, 0.8, 0.1, 0.1)
    again = splits.random_split(df.repartition(3), "row_id", 0.8, 0.1, 0.1)
    assert first.exceptAll(again).isEmpty()
    other = splits.random_split(df, "row_id", 0.8, 0.1, 0.1, seed=7)
    assert not first.exceptAll(other).isEmpty()


def test_text_ids(spark):
    df = spark.range(300).select(F.concat(F.lit("m"), "id").alias("row_id"))
    assert sizes_of(splits.random_split(df, "row_id")) == splits.exact_sizes(300, 0.7, 0.15, 0.15)
    dated = df.withColumn("d", F.lit(3))
    assert sizes_of(splits.temporal_split(dated, "row_id", "d")) == {"train": 210, "val": 45, "test": 45}


def greedy(rows, train, val):
    """The fill as a plain loop over groups, largest first."""
    members = {}
    for i, g in rows:
        members.setdefault(g if g is not None else ("row", i), []).append(i)
    out, counts = {}, {"train": 0, "val": 0}
    for ids in sorted(members.values(), key=lambda m: (-len(m), m[0])):
        part = "train" if counts["train"] < int(len(rows) * train) else "val" if counts["val"] < int(len(rows) * val) else "test"
        if part != "test":
            counts[part] += len(ids)
        out.update({i: part for i in ids})
    return out


@pytest.mark.parametrize("seed", range(6))
def test_group_split_equals_the_greedy_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(ordering, "WINDOW", 15)
    rng = random.Random(seed)
    n = rng.choice([40, 200, 700])
    groups = rng.choice([5, 60, 400])
    rows = []
    for i in range(n):
        shape = rng.random()
        rows.append((i, None if shape < 0.1 else "hot" if shape < 0.4 else f"g{rng.randrange(groups)}"))
    train, val = rng.choice([(0.7, 0.15), (0.5, 0.25), (0.0, 0.5), (0.9, 0.0), (0.97, 0.03)])
    df = spark.createDataFrame(rows, "row_id long, g string").repartition(5)
    parted = splits.group_split(df, "row_id", "g", train, val, hot_share=rng.choice([1e-3, 0.2]))
    assert {r["row_id"]: r["split"] for r in parted.collect()} == greedy(rows, train, val)


def test_group_split_without_lonely_rows(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"g{i % 6}") for i in range(60)], "row_id long, g string")
    parted = splits.group_split(df, "row_id", "g", drop_null_groups=True)
    assert parted.count() == 45
    assert parted.groupBy("g").agg(F.count_distinct("split").alias("c")).filter("c > 1").isEmpty()


def test_group_split_with_text_ids(spark):
    df = spark.createDataFrame([(f"m{i}", f"g{i % 40}") for i in range(400)], "row_id string, g string")
    parted = splits.group_split(df, "row_id", "g")
    assert sizes_of(parted) == {"train": 280, "val": 60, "test": 60}
    assert parted.groupBy("g").agg(F.count_distinct("split").alias("c")).filter("c > 1").isEmpty()


def test_stratified_split_small_classes_go_to_train(spark):
    rows = [(i, "big" if i >= 4 else "two" if i < 2 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_id long, y string")
    parted = splits.random_split(df, "row_id", target="y")
    assert parted.filter("y = 'two' AND split <> 'train'").isEmpty()
    assert parted.filter("y IS NULL AND split <> 'train'").isEmpty()
    assert sizes_of(parted.filter("y = 'big'")) == splits.exact_sizes(996, 0.7, 0.15, 0.15)


def test_balanced_split_null_class(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "row_id long, y int")
    assert splits.balanced_split(df, "row_id", "y").count() == 100
    assert splits.balanced_split(df, "row_id", "y", drop_null_class=True).count() == 80
    with pytest.raises(ValueError):
        splits.balanced_split(df, "row_id", "missing")


def test_temporal_split_order(spark, monkeypatch):
    monkeypatch.setattr(ordering, "WINDOW", 10)
    rows = [(i, None if i % 10 == 0 else (i * 37) % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, d int").repartition(4)
    for ratios in ((0.7, 0.15, 0.15), (0.95, 0.03, 0.02), (0.0, 0.5, 0.5)):
        parted = {r["row_id"]: r["split"] for r in splits.temporal_split(df, "row_id", "d", *ratios).collect()}
        ordered = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
        a, b = int(400 * ratios[0]), int(400 * ratios[0]) + int(400 * ratios[1])
        expected = ["train"] * a + ["val"] * (b - a) + ["test"] * (400 - b)
        assert [parted[i] for i, _ in ordered] == expected
    as_text = df.withColumn("d", F.lpad(F.col("d").cast("string"), 2, "0"))
    same = {r["row_id"]: r["split"] for r in splits.temporal_split(as_text, "row_id", "d").collect()}
    assert same == {r["row_id"]: r["split"] for r in splits.temporal_split(df, "row_id", "d").collect()}
    with pytest.raises(ValueError):
        splits.temporal_split(df, "row_id", "nope")


def test_cluster_split_keeps_clusters_whole(spark):
    rows = [(i, float(i % 5 * 100 + i % 3), None if i % 9 == 0 else float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    parted = splits.cluster_split(df, ["a", "b"])
    assert parted.count() == 200
    assert parted.groupBy("cluster").agg(F.count_distinct("split").alias("c")).filter("c > 1").isEmpty()


def test_dispatch(spark):
    df = spark.createDataFrame([(i, i % 2, f"s{i % 9}", i, float(i), float(i % 7)) for i in range(120)], "row_id long, y int, scaffold string, date int, f1 double, f2 double")
    for method in ("random", "stratified", "scaffold", "temporal", "balanced", "cluster"):
        parted = splits.split_table(df, "row_id", method, target="y")
        assert parted.count() == 120
        assert splits.validate_split(parted, df, "row_id").first()["valid_split"]
    narrow = splits.split_table(df.select("row_id", "y", "f1"), "row_id", "cluster", target="y")
    assert "cluster" not in narrow.columns  # fell back to random
    with pytest.raises(ValueError):
        splits.split_table(df, "row_id", "by_moon")


def test_validate_split_finds_loss(spark):
    df = spark.range(50).withColumnRenamed("id", "row_id")
    parted = splits.random_split(df, "row_id")
    checks = splits.validate_split(parted.filter("row_id <> 3"), df, "row_id").first()
    assert not checks["size_preserved"] and not checks["all_rows_covered"] and not checks["valid_split"]
    assert checks["no_train_val_overlap"]


def test_parts(spark):
    df = spark.range(20).withColumnRenamed("id", "row_id")
    parts = splits.parts_of(splits.random_split(df, "row_id"))
    assert [p.count() for p in parts] == [14, 3, 3]
