import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions.hashing import seeded_order
from assayer.operators import ordering


@pytest.fixture
def small_window(monkeypatch):
    """Force several narrowing rounds on small data."""
    monkeypatch.setattr(ordering, "WINDOW", 20)
    monkeypatch.setattr(ordering, "ACCURACY", 50)


def test_order_statistics_with_ties_and_nulls(spark, small_window):
    rng = random.Random(7)
    values = [rng.choice([5, 5, 5, rng.randrange(10**12), rng.randrange(100), -rng.randrange(10**6)]) for _ in range(5000)]
    floats = [rng.gauss(0, 1) ** 9 for _ in values]
    rows = [(v, f) for v, f in zip(values, floats)] + [(None, None)] * 50
    df = spark.createDataFrame(rows, "a long, b double").repartition(6)
    ranks = [0, 1, 777, 1250, 2500, 4999, 5000]
    found = ordering.order_statistics(df, {"a": (F.col("a"), ranks), "b": (F.col("b"), ranks)})
    for r in ranks:
        assert found[("a", r)] == (sorted(values)[r] if r < 5000 else None)
        assert found[("b", r)] == (sorted(floats)[r] if r < 5000 else None)


def test_one_value_holds_a_third(spark, small_window):
    values = sorted([1] * 400 + [2**40] * 400 + list(range(3, 403)))
    df = spark.createDataFrame([(v,) for v in values], "a long")
    found = ordering.order_statistics(df, {"a": (F.col("a"), list(range(0, 1200, 67)))})
    assert all(found[("a", r)] == values[r] for r in range(0, 1200, 67))


def test_row_at_rank_breaks_ties(spark, small_window):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, rng.randrange(40)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "d long, i long")
    ranks = [0, 10, 999, 1500, 1999]
    found = ordering.row_at_rank(df, [F.col("d"), F.col("i")], ranks, 2000)
    assert {r: found[r] for r in ranks} == {r: sorted(rows)[r] for r in ranks}
    inside = df.filter(ordering.not_after([F.col("d"), F.col("i")], found[999])).count()
    assert inside == 1000


def test_hashed_ranks(spark, small_window):
    df = spark.range(3000).repartition(5)
    position = seeded_order(F.col("id"), 4)
    placed = sorted((r[0], r[1]) for r in df.select(position, "id").collect())
    ranks = [0, 1, 449, 1500, 2998, 2999]
    assert ordering.row_at_rank(df, [position, F.col("id")], ranks, 3000, (0, 2**32 - 1)) == {r: placed[r] for r in ranks}
    # Far from even, as a hash never is.
    crowded = position % 50
    placed = sorted((r[0], r[1]) for r in df.select(crowded, "id").collect())
    assert ordering.row_at_rank(df, [crowded, F.col("id")], ranks, 3000, (0, 2**32 - 1)) == {r: placed[r] for r in ranks}


def test_prefix_sums_match_a_loop(spark):
    rng = np.random.default_rng(1)
    scores = np.concatenate([rng.normal(size=3000), 1e-9 * rng.normal(size=3000), np.full(3000, 0.25)])
    counts = rng.integers(0, 9, len(scores))
    df = spark.createDataFrame([(float(s), int(c)) for s, c in zip(scores, counts)], "s double, c long").repartition(5)
    found = {r["s"]: (r["c"], r["c_before"]) for r in ordering.prefix_sums(df, "s", ["c"], buckets=64).collect()}
    before = 0
    for s in np.unique(scores):
        own = int(counts[scores == s].sum())
        assert found[float(s)] == (own, before)
        before += own


def test_group_cuts_with_a_hot_group_and_null_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"g{i % 50}") for i in range(6000)]
    df = spark.createDataFrame(rows, "i long, g string")
    position = seeded_order(F.col("i"), 9)
    cuts = ordering.group_cuts(df, "g", position, "i", {"third": F.ceil(F.col("n") / 3)}, buckets_shift=28)
    placed = df.withColumn("h", position).collect()
    for row in cuts.collect():
        members = sorted((r["h"], r["i"]) for r in placed if r["g"] == row["g"])
        assert (row["third"]["h"], row["third"]["k"]) == members[-(-len(members) // 3) - 1]
    assert cuts.count() == len({r[1] for r in rows})


def test_large_integers(spark, small_window):
    values = sorted([2**62 + 1] * 300 + [2**62 + 3] * 300 + [-(2**61) - 7] * 100 + [2**62 + 2 * i for i in range(200)])
    df = spark.createDataFrame([(v,) for v in values], "a long").repartition(3)
    ranks = [0, 150, 450, 899]
    found = ordering.order_statistics(df, {"a": (F.col("a"), ranks)})
    assert [found[("a", r)] for r in ranks] == [values[r] for r in ranks]


def test_text_order(spark, small_window):
    rng = random.Random(11)
    words = ["", "a", "ab", "abc" * 9, "é", "zürich", "日本", "a\x00", "a\x01b"]
    rows = [rng.choice(words) + rng.choice(["", "-long-common-part-of-many-values-"]) + str(rng.randrange(60)) for _ in range(1500)]
    rows = sorted(rows + words, key=lambda w: w.encode())
    df = spark.createDataFrame([(w, i) for i, w in enumerate(rows)], "w string, i long").repartition(4)
    order = [ordering.sortable(df, "w")]
    for rank in (0, 700, 1508):
        row = ordering.row_at_rank(df, [*order, F.col("i")], [rank], len(rows))[rank]
        inside = df.filter(ordering.not_after([*order, F.col("i")], row))
        assert inside.count() == rank + 1 and row[-1] == rank


def test_long_texts_with_a_common_beginning(spark, small_window, monkeypatch):
    """20,000 words that differ at the end only; a third of the rows has one text."""
    monkeypatch.setattr(ordering, "GATHERED", 1 << 18)
    common = "a common word " * 6667
    texts = [common + ("same" if i % 3 == 0 else f"{i * 7919 % 1000:03d}" if i % 3 == 1 else f"{i % 5}") for i in range(120)]
    rows = [(t, i) for i, t in enumerate(texts)] + [("", 900), (common, 901), (common + "s", 902)]
    df = spark.createDataFrame(rows, "w string, i long").repartition(4)
    ranks = [0, 1, 2, 40, 79, 80, 81, 82, 100, 122, 123]
    found = ordering.row_at_rank(df, [F.col("w"), F.col("i")], ranks)
    placed = sorted(rows, key=lambda r: (r[0].encode(), r[1]))
    assert found == {r: placed[r] if r < len(placed) else None for r in ranks}


def test_ranks_by_columns_of_all_kinds(spark, small_window):
    rng = random.Random(8)
    rows = [(rng.choice([0.5, -1e300, 1e-9]), rng.choice([-(2**63), 2**63 - 1, 0, 5]), rng.choice(["", "a", "b\x00"]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "d double, n long, w string, i int").repartition(4)
    ranks = [0, 299, 300, 451, 899, 900, -1]
    found = ordering.row_at_rank(df, [F.col(c) for c in "dnwi"], ranks)
    placed = sorted(rows)
    assert found == {r: placed[r] if 0 <= r < 900 else None for r in ranks}
    assert ordering.row_at_rank(df.limit(0), [F.col("n")], [0]) == {0: None}


@pytest.mark.parametrize("n", [3000, 12000])
def test_buckets_of_a_hot_group_stay_small(spark, small_window, monkeypatch, n):
    seen = []
    kept = ordering.stage
    monkeypatch.setattr(ordering, "stage", lambda df, name: seen.append((name, kept(df, name))) or seen[-1][1])
    df = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    position = seeded_order(F.col("i"), 9)
    cuts = ordering.group_cuts(df, "g", position, "i", {"half": F.ceil(F.col("n") / 2)}, buckets_shift=29)
    members = sorted(tuple(r) for r in df.filter("g = 'hot'").select(position, "i").collect())
    row = cuts.filter("g = 'hot'").first()["half"]
    assert (row["h"], row["k"]) == members[len(members) // 2 - 1]
    buckets = [t for name, t in seen if name == "buckets"]
    assert len(buckets) == 2 and buckets[-1].agg(F.max("c")).first()[0] <= 20
