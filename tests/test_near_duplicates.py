import itertools
import random

import pytest

from assayer.operators import near_duplicates as module
from assayer.operators.near_duplicates import near_duplicates
from assayer.session import stage


def score(a, b, metric):
    c = len(a & b)
    return {"tanimoto": c / (len(a) + len(b) - c), "dice": 2 * c / (len(a) + len(b)), "cosine": c / (len(a) * len(b)) ** 0.5}[metric]


def brute(rows, metric, threshold):
    sets = {k: frozenset(b or ()) for k, b in rows}
    first = {}
    for k, s in sorted(sets.items()):
        first.setdefault(s if s else k, k)
    of = {k: first[s if s else k] for k, s in sets.items()}
    sizes = {i: sum(v == i for v in of.values()) for i in of.values()}
    kept = {i: sets[i] for i in sizes if sets[i]}
    pairs = {(a, b): score(kept[a], kept[b], metric) for a, b in itertools.combinations(sorted(kept), 2)}
    pairs = {p: s for p, s in pairs.items() if s >= threshold}
    links = {i: (sizes[i] - 1 if i in kept else 0) + sum(sizes[b if a == i else a] for a, b in pairs if i in (a, b)) for i in sizes}
    return {k: (i, sizes[i], links[i]) for k, i in of.items()}, pairs


def crowd(seed):
    """Near copies around a few texts, one group of copies with a third of the rows, common bits, empty and null sets."""
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(25):
        base = rng.sample(range(5000), rng.randrange(1, 40)) + list(range(6000, 6000 + rng.randrange(12)))
        for _ in range(rng.randrange(1, 8)):
            noise = rng.sample(range(7000), rng.randrange(4))
            rows.append((k, sorted({b for b in base if rng.random() > 0.06} | set(noise))))
            k += 1
    hot = list(range(6000, 6030))
    rows += [(k + i, hot) for i in range(k // 2)]
    rows += [(1000, []), (1001, []), (1002, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("metric,threshold", [("tanimoto", 0.75), ("jaccard", 0.4), ("dice", 0.8), ("cosine", 0.9), ("tanimoto", 1.0)])
def test_all_links_and_no_others(spark, metric, threshold):
    rows = crowd(threshold)
    found = near_duplicates(spark.createDataFrame(rows, "k long, b array<int>").repartition(5), "k", "b", metric, threshold)
    members, pairs = brute(rows, "tanimoto" if metric == "jaccard" else metric, threshold)
    got = {(r["left_id"], r["right_id"]): r["similarity"] for r in found.pairs.collect()}
    assert got.keys() == pairs.keys() and all(got[p] == pytest.approx(pairs[p]) for p in got)
    listed = found.rows.collect()
    assert len(listed) == len(rows) and {r["k"]: tuple(r)[1:] for r in listed} == members


def test_copies_are_not_multiplied_out(spark):
    """Five thousand copies of each of two near sets are one pair."""
    rows = [(i, list(range(20)) if i % 2 else list(range(1, 21))) for i in range(10_000)]
    found = near_duplicates(spark.createDataFrame(rows, "k long, b array<int>"), "k", "b")
    assert [tuple(r)[:4] for r in found.pairs.collect()] == [(0, 1, 5000, 5000)]
    assert {r["links"] for r in found.rows.select("links").distinct().collect()} == {9999}


def test_no_rows_and_wrong_threshold(spark):
    found = near_duplicates(spark.createDataFrame([], "k long, b array<int>"), "k", "b")
    assert found.pairs.count() == 0 and found.rows.count() == 0
    with pytest.raises(ValueError, match="threshold"):
        near_duplicates(spark.createDataFrame([], "k long, b array<int>"), "k", "b", threshold=0.0)


@pytest.mark.parametrize("metric,threshold,places", [("dice", 0.8, 64), ("tanimoto", 0.7, 100), ("cosine", 0.85, 30)])
def test_few_distinct_bits_are_compared_as_bitmaps(spark, monkeypatch, metric, threshold, places):
    """Sets in which half of all places are marked: nearly every pair would meet by some bit."""
    rng = random.Random(places)
    rows = [(k, [i for i in range(places) if rng.random() < 0.5]) for k in range(180)]
    rows += [(200 + k, sorted(set(b) ^ set(rng.sample(range(places), rng.randrange(5))))) for k, b in rows[:90]]
    rows += [(400, None), (401, []), (402, rows[0][1]), (403, [0])]
    monkeypatch.setattr(module, "_candidates", None)  # pairs by their bits are not even looked for
    monkeypatch.setattr(module, "CHUNK", 60)
    found = near_duplicates(spark.createDataFrame(rows, "k long, b array<int>").repartition(5), "k", "b", metric, threshold)
    members, pairs = brute(rows, metric, threshold)
    got = {(r["left_id"], r["right_id"]): r["similarity"] for r in found.pairs.collect()}
    assert got.keys() == pairs.keys() and len(got) > 50 and all(got[p] == pytest.approx(pairs[p]) for p in got)
    assert {r["k"]: tuple(r)[1:] for r in found.rows.collect()} == members


def test_bitmaps_and_meetings_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(f"k{k}", [f"w{i}" for i in range(90) if rng.random() < 0.3]) for k in range(60)]
    rows += [(f"n{k}", b[: -1 - k % 3]) for k, (_, b) in enumerate(rows)]
    table = spark.createDataFrame(rows, "k string, b array<string>")
    found = []
    for cost in (0, 1 << 20):
        monkeypatch.setattr(module, "MEETING", cost)
        found.append(sorted(map(tuple, near_duplicates(table, "k", "b").pairs.collect())))
    assert found[0] == found[1] and len(found[0]) > 40


def test_only_first_bits_are_shuffled(spark, monkeypatch):
    """Of sets that have nothing in common no bit meets another, and none is compared in full."""
    staged = {}
    monkeypatch.setattr(module, "stage", lambda df, name="stage": staged.setdefault(name, stage(df, name)))
    rows = [(k, list(range(100 * k, 100 * k + 100))) for k in range(50)] + [(50, list(range(99)))]
    found = near_duplicates(spark.createDataFrame(rows, "k long, b array<int>"), "k", "b")
    assert [tuple(r)[:2] for r in found.pairs.collect()] == [(0, 50)]
    assert staged["prefixes"].agg({"place": "max"}).first()[0] <= 26 and staged["prefixes"].count() <= 52
    assert staged["candidates"].count() == 1 and not any(c == "first" for c in staged["classes"].columns)


def test_large_neighbourhoods_are_cut(spark, monkeypatch):
    """Near copies that go to several chunks meet all the same."""
    monkeypatch.setattr(module, "TOGETHER", 5)
    rows = [(k, sorted({*range(40), 100 + k})) for k in range(40)] + [(100 + k, sorted({*range(50, 90), 200 + k})) for k in range(3)]
    found = near_duplicates(spark.createDataFrame(rows, "k long, b array<int>"), "k", "b")
    assert found.pairs.count() == 40 * 39 // 2 + 3
    assert {r["k"]: r["links"] for r in found.rows.collect()} == {k: 39 if k < 100 else 2 for k, _ in rows}
