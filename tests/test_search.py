"""Similarity, diversity, ranking, model metrics against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import scores
from assayer.operators import features, models, similarity
from assayer.plans import checks_search


def brute(a, b, metric="tanimoto"):
    a, b = set(a), set(b)
    c = len(a & b)
    below = {"tanimoto": len(a | b), "dice": (len(a) + len(b)) / 2, "cosine": (len(a) * len(b)) ** 0.5}[metric]
    return c / below if below else 0.0


def sets(n, seed, space=60):
    """Random sets, a third of them one hot copy, with some empty."""
    rng = random.Random(seed)
    hot = sorted(rng.sample(range(space), 12))
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append(hot)
        elif i % 3 == 1 and rng.random() < 0.5:
            out.append(sorted(set(hot) ^ {rng.randrange(space)}))
        else:
            out.append(sorted(rng.sample(range(space), rng.randrange(0, 15))))
    return out


def test_pair_scores(spark):
    rows = [([1, 2, 3], [2, 3, 4, 5]), ([], []), ([1], [1]), ([1], [])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    for (a, b), found in zip(rows, similarity.pair_scores(df, "a", "b").collect()):
        for metric in ("tanimoto", "dice", "cosine"):
            assert found[metric] == pytest.approx(brute(a, b, metric))
    assert scores.check_metric("Jaccard") == "tanimoto"
    with pytest.raises(ValueError):
        scores.check_metric("euclid")


def test_search_one(spark):
    data = sets(80, 1)
    df = spark.createDataFrame([(i, b, i % 10 != 4) for i, b in enumerate(data)], "id long, bits array<int>, ok boolean").repartition(4)
    query = data[0]
    for metric, threshold in (("tanimoto", 0.0), ("dice", 0.4), ("jaccard", 0.3)):
        found = similarity.search(df, "id", "bits", query, metric, threshold, 25, "ok").collect()
        name = "tanimoto" if metric == "jaccard" else metric
        expected = [(brute(query, b, name) if i % 10 != 4 else 0.0, i) for i, b in enumerate(data)]
        expected = sorted((e for e in expected if e[0] >= threshold), key=lambda e: (-e[0], e[1]))[:25]
        assert [(r["id"], r["rank"]) for r in found] == [(i, n) for n, (_, i) in enumerate(expected, 1)]
        assert all(r["total_comparisons"] == 80 and r["above_threshold"] == len(expected) for r in found)
        assert all((r["error"] is not None) == (r["id"] % 10 == 4) for r in found)
    with pytest.raises(ValueError):
        similarity.search(df, "id", "bits", query, "euclid")
    with pytest.raises(ValueError):
        similarity.query_bits(df.filter("id < 0"), "bits")


@pytest.mark.parametrize("metric, threshold", [("tanimoto", 0.3), ("tanimoto", 1.0), ("dice", 0.5), ("cosine", 0.45), ("tanimoto", 0.05)])
def test_search_many_is_exact(spark, metric, threshold):
    queries, targets = sets(25, 2), sets(150, 3)
    q = spark.createDataFrame(list(enumerate(queries)), "qid long, bits array<int>")
    t = spark.createDataFrame(list(enumerate(targets)), "tid long, bits array<int>").repartition(5)
    found = similarity.search_many(q, t, "qid", "tid", "bits", metric, threshold, 7).collect()
    expected = set()
    for i, a in enumerate(queries):
        hits = sorted(((-brute(a, b, metric), j) for j, b in enumerate(targets) if a and brute(a, b, metric) >= threshold))[:7]
        expected |= {(i, n, j) for n, (_, j) in enumerate(hits, 1)}
    assert {(r["qid"], r["rank"], r["match_tid"]) for r in found} == expected
    with pytest.raises(ValueError):
        similarity.search_many(q, t, "qid", "tid", "bits", metric, 0.0)


@pytest.mark.parametrize("metric", ["tanimoto", "dice", "cosine"])
@pytest.mark.parametrize("block", [9, 1000])
def test_diversity_counts_copies(spark, metric, block):
    data = sets(70, 4)
    df = spark.createDataFrame([(i, b) for i, b in enumerate(data)], "id long, bits array<int>")
    row = similarity.diversity(df, "bits", metric, block=block).first()
    every = np.array([brute(a, b, metric) for a, b in itertools.combinations(data, 2)])
    assert row["mean_similarity"] == pytest.approx(every.mean()) and row["std_similarity"] == pytest.approx(every.std())
    assert row["min_similarity"] == pytest.approx(every.min()) and row["max_similarity"] == pytest.approx(every.max())
    assert row["num_molecules"] == 70 and row["num_comparisons"] == len(every) and row["error"] is None


def test_diversity_of_too_few(spark):
    df = spark.createDataFrame([(1, [1, 2])], "id long, bits array<int>")
    row = similarity.diversity(df, "bits").first()
    assert row["error"] and row["mean_similarity"] is None and row["num_comparisons"] == 0
    twins = spark.createDataFrame([(1, [1, 2]), (2, [1, 2])], "id long, bits array<int>")
    assert similarity.diversity(twins, "bits").first()["mean_similarity"] == 1.0


def test_dense_diversity(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(60, 5)) + 0.5
    df = spark.createDataFrame([(v.tolist(),) for v in vectors], "v array<double>").repartition(4)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    every = (unit @ unit.T)[np.triu_indices(60, 1)]
    row = similarity.dense_diversity(df, "v").first()
    assert row["mean_similarity"] == pytest.approx(every.mean()) and row["std_similarity"] == pytest.approx(every.std())
    assert row["num_comparisons"] == len(every)


def test_rank_candidates(spark):
    df = spark.createDataFrame(
        [(1, 300.0, 2.0, 0.9), (2, 350.0, 4.0, 0.9), (3, None, 1.0, 0.9), (4, 300.0, 2.0, 0.1), (5, 900.0, 1.0, 0.9)],
        "row_id long, mw double, logp double, sim double",
    )
    goals = [{"property": "molecular_weight", "value": 300, "tolerance": 10}, {"property": "logp", "value": 3, "direction": "minimize", "weight": 2}]
    best = similarity.rank_candidates(df, "row_id", goals, {"mw": {"max": 500}}, "sim").collect()
    assert [(r["row_id"], r["violations"]) for r in best] == [(1, []), (2, ["molecular_weight", "logp"])]
    assert best[1]["fitness"] == pytest.approx((1 / (1 + 40 / 300) + 2 / (1 + 1 / 3)) / 3)
    free = similarity.rank_candidates(df, "row_id", goals).collect()
    assert [r["row_id"] for r in free][:2] == [1, 4]
    with pytest.raises(ValueError):
        similarity.rank_candidates(df, "row_id", [{"property": "mw", "value": 1, "direction": "up"}])


def test_regression(spark):
    y, p = [1.0, 2.0, 0.0, 4.0], [1.5, 1.0, 0.5, 4.0]
    row = models.regression_metrics(spark.createDataFrame(list(zip(y, p)), "y double, p double"), "y", "p").first()
    e = np.array(y) - np.array(p)
    assert row["mse"] == pytest.approx((e**2).mean()) and row["max_error"] == 1.0
    assert row["r2"] == pytest.approx(1 - (e**2).sum() / ((np.array(y) - np.mean(y)) ** 2).sum())
    assert row["mape"] == pytest.approx(100 * (0.5 + 0.5 + 0) / 3)


def test_classification(spark):
    perfect = spark.createDataFrame([(v, v) for v in (0, 1, 1, 0, 1)], "y int, p int")
    assert set(models.classification_metrics(perfect, "y", "p").first()) == {1.0}
    rows = [(0, 0.2), (0, 0.7), (1, 0.6), (1, 0.4), (1, 0.9), (0, 0.5)]
    row = models.classification_metrics(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    assert row["accuracy"] == pytest.approx(4 / 6) and row["recall"] == pytest.approx(4 / 6) and row["f1"] == pytest.approx(4 / 6)
    labels = spark.createDataFrame([(1, 2), (2, 2), (1, 1)], "y int, p int")  # two values: not cut
    assert models.classification_metrics(labels, "y", "p").first()["accuracy"] == pytest.approx(2 / 3)


def test_auc(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.choice([0.1, 0.5, 0.5, rng.random(), rng.random() ** 8])) for _ in range(400)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    expected = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert models.auc(spark.createDataFrame(rows, "y int, s double").repartition(4), "y", "s").first()["auc"] == pytest.approx(expected)
    for classes in ([(1, 0.5), (1, 0.7)], [(0, 0.5), (1, 0.7), (2, 0.1)]):
        assert models.auc(spark.createDataFrame(classes, "y int, s double"), "y", "s").first()["auc"] is None


def test_forest(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 3) if i % 7 else None, int(i % 10 > 4)) for i in range(300)], "i long, a double, b double, y int")
    model = models.ForestModel("classification", trees=10, depth=3)
    with pytest.raises(ValueError):
        model.predict(df)
    predicted = model.fit(df, ["a", "b"], "y").predict(df)
    assert predicted.filter("prediction = y").count() > 290
    weights = model.importances(spark).collect()
    assert weights[0]["feature"] == "a" and sum(r["importance"] for r in weights) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        models.ForestModel("ranking")


def test_structures_end_to_end(spark):
    """Identical strings score 1; all scores lie between 0 and 1."""
    df = spark.createDataFrame([("CCO", "CCO"), ("CCO", "CC(=O)O"), ("c1ccccc1", "CCO")], "a string, b string")
    df = features.with_fingerprint(features.with_fingerprint(df, "a", "fa"), "b", "fb")
    rows = similarity.pair_scores(df, "fa", "fb").collect()
    assert rows[0]["tanimoto"] == rows[0]["dice"] == rows[0]["cosine"] == 1.0
    assert all(0 <= r[m] <= 1 for r in rows for m in ("tanimoto", "dice", "cosine")) and rows[2]["tanimoto"] == 0


def test_forest_classes_are_those_of_a_walk(spark, monkeypatch):
    """The query gives every document the class of the fitted trees, walked node by node."""
    fitted, fit = [], models.ForestModel.fit
    monkeypatch.setattr(models.ForestModel, "fit", lambda self, *args: fitted.append(fit(self, *args)) or fitted[-1])
    folder = "/root/testdata/sf0.001"
    got = checks_search.forest_classes(spark, folder)
    assert got.columns == ["doc_id", "prediction"]

    def read_node(node):
        if not hasattr(node, "split") or "LeafNode" in node.getClass().getName():
            return list(node.impurityStats().stats())
        return node.split().featureIndex(), node.split().threshold(), read_node(node.leftChild()), read_node(node.rightChild())

    def leaf(node, x):
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        return np.array(node) / sum(node)

    trees = [read_node(t._java_obj.rootNode()) for t in fitted[0].model.stages[-1].trees]
    docs = features.with_token_counts(spark.read.parquet(f"{folder}/documents.parquet"), "text").collect()
    votes = {r["doc_id"]: sum(leaf(t, [float(r[c] or 0) for c in fitted[0].features]) for t in trees) for r in docs}
    rows = got.collect()
    assert len(rows) == len(docs) == len(votes) and len({r["prediction"] for r in rows}) == 2
    for r in rows:
        vote = votes[r["doc_id"]]
        assert vote[int(r["prediction"])] >= vote.max() - 1e-9


def test_forest_is_stored_and_evaluated(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 10).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 10 >= 5).cast("int").alias("y"))
    model = models.ForestModel("classification", trees=5, depth=4).fit(df, ["a", "b"], "y")
    assert model.evaluate(df, "y").first()["accuracy"] == 1.0
    model.save(str(tmp_path / "forest"))
    again = models.ForestModel.load(str(tmp_path / "forest"))
    assert again.features == ["a", "b"] and again.predict(df).exceptAll(model.predict(df)).isEmpty()
    size = models.ForestModel("regression", trees=5, depth=4).fit(df, ["a"], "y")
    assert size.evaluate(df, "y").first()["r2"] > 0.9


def test_search_without_a_limit(spark):
    rng = random.Random(3)
    sets = [(i, sorted(rng.sample(range(40), 12))) for i in range(150)]
    df = spark.createDataFrame(sets, "id long, bits array<int>")
    found = similarity.search(df, "id", "bits", sets[0][1]).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 151)) and found[0]["above_threshold"] == 150
    wanted = sorted(((-brute(b, sets[0][1]), i) for i, b in sets))
    assert [r["id"] for r in found] == [i for _, i in wanted]
    some = similarity.search(df, "id", "bits", sets[0][1], threshold=0.3)
    assert some.count() == sum(-s >= 0.3 for s, _ in wanted)
    every = similarity.search_many(df.filter("id < 5"), df, "id", "id", "bits", threshold=0.3)
    assert every.count() == sum(brute(a, b) >= 0.3 for _, a in sets[:5] for _, b in sets)
