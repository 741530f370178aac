"""Quality and toxicity models: held-out accuracy, what pairs add, awkward input."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import quality_gam, toxicity_fm
from assayer.llm.common import crc32_fold, labelled_sample
from assayer.llm.queries import LLM
from llm.fixtures import awkward, empty

FOLDER = "/root/testdata/sf0.1"


def area(score, label):
    order = np.argsort(np.argsort(score, kind="stable"))
    ones = label == 1
    n1, n0 = ones.sum(), (~ones).sum()
    return (order[ones].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


@pytest.mark.parametrize(("name", "label", "folds", "out", "least"), [("op4_quality_gam", "quality", 5, 0, 0.97), ("op10_toxicity_fm", "toxic", 4, 2, 0.9)])
def test_held_out_documents(spark, name, label, folds, out, least):
    got = LLM.queries[name](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").toPandas()
    assert all((zlib.crc32(str(d).encode()) % folds == out) == h for d, h in zip(got["doc_id"], got["held_out"], strict=True))
    held = got[got["held_out"]]
    assert area(held["score"].to_numpy(), held[label].to_numpy()) >= least
    assert (got["predicted"] == (got["score"] >= 0.3)).all()


def test_gam_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    alone = quality_gam.fit(x, y, n_pairs=0)
    pairs = quality_gam.fit(x, y, n_pairs=2)
    assert area(alone.score(x), y) < 0.7 and area(pairs.score(x), y) > 0.98


def test_gam_scores_are_table_sums():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    model = quality_gam.fit(x, (x[:, 0] > 0).astype(float), rounds=20, pair_rounds=5, n_pairs=1)
    for row, score in zip(x[:20], model.score(x[:20]), strict=True):
        bins = [int((e <= v).sum()) for e, v in zip(model.edges, row, strict=True)]
        total = model.start + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        total += sum(t[bins[i], bins[j]] for (i, j), t in model.pairs.items())
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_machine_learns_a_pair():
    """Toxic only if an insult and a group are named together."""
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for _ in range(2000):
        insult, group = map(int, rng.random(2) < 0.4)
        words = [f"filler{i}" for i in rng.integers(0, 50, 8)] + ["vermin"] * insult + ["newcomers"] * group
        texts.append(" ".join(words))
        labels.append(float(insult and group))
    terms = toxicity_fm.Terms()
    ids = [terms.of_text(t) for t in texts]
    y = np.array(labels)
    model = toxicity_fm.fit(ids, y)
    wanted = toxicity_fm.Terms(model.wanted())
    score = lambda t: model.score([wanted.of_text(t)])[0]
    both = score("vermin newcomers")
    assert both > 0.8 > 0.2 > max(score("vermin"), score("newcomers"), score("filler1"))
    assert np.abs(model.vectors).max() > 0.3


def test_machine_finds_terms_that_are_neutral_alone():
    """Both terms have the base share of toxic texts by themselves, and half of the texts with both are toxic."""
    rng = np.random.default_rng(8)
    texts, labels = [], []
    for _ in range(6000):
        a, b = map(int, rng.random(2) < 0.2)
        share = 0.5 if a and b else 0.0625 if a or b else 0.15
        texts.append(" ".join([f"filler{i}" for i in rng.integers(0, 300, 20)] + ["alpha"] * a + ["omega"] * b))
        labels.append(float(rng.random() < share))
    terms, y = toxicity_fm.Terms(), np.array(labels)
    ids = [terms.of_text(t) for t in texts]
    rows, flat = np.repeat(np.arange(len(ids)), [len(t) for t in ids]), np.concatenate(ids)
    alone = set(toxicity_fm.select(rows, flat, y))
    asked = {int(t) for t in terms.of_text("alpha omega")}
    assert not asked & alone and asked <= set(toxicity_fm.select_pairs(rows, flat, y).tolist())
    model = toxicity_fm.fit(ids, y)
    wanted = toxicity_fm.Terms(model.wanted())
    score = lambda t: model.score([wanted.of_text(t)])[0]
    assert score("alpha omega") > 0.35 > 0.2 > max(score("alpha"), score("omega"), score("filler1"))


def test_memory_of_terms_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity_fm, "REMEMBERED", 100)
    terms = toxicity_fm.Terms()
    for i in range(200):
        assert len(terms.of_text(f"word{i} other{i}"))
    assert sum(map(len, terms.words)) < 130


def test_machine_product_is_that_of_all_pairs():
    rng = np.random.default_rng(4)
    weights, vectors = rng.normal(size=6), rng.normal(size=(6, 3))
    texts = [[0, 2, 5], [1], []]
    rows = np.repeat([0, 1, 2], [3, 1, 0])
    got = toxicity_fm.raw(rows, np.array([0, 2, 5, 1]), 3, weights, vectors)[0]
    for t, value in zip(texts, got, strict=True):
        assert value == pytest.approx(sum(weights[t]) + sum(vectors[a] @ vectors[b] for i, a in enumerate(t) for b in t[i + 1 :]))


@pytest.mark.parametrize(("fit", "score"), [(quality_gam.fit_quality, quality_gam.score_quality), (toxicity_fm.fit_toxicity, toxicity_fm.score_toxicity)])
def test_awkward_documents(spark, fit, score):
    docs = awkward(spark, ["good text of the day"] * 20 + ["!! BAD !!"] * 20)
    labels = docs.where("doc_id >= 100").select("doc_id", (F.col("text") != "!! BAD !!").cast("int").alias("v"), F.lit("x").alias("text"))
    labels = labels.union(spark.createDataFrame([(None, 1, "x"), (100, None, "x"), (100, 1, "x"), (100, 1, "x"), (5, 1, "x")], "doc_id long, v int, text string"))
    got = score(docs, fit(docs, labels, F.lit(True), label="v"))
    assert got.columns == ["doc_id", "score"] and got.count() == docs.count()
    assert got.where("score between 0 and 1").count() == docs.count()
    none = score(docs, fit(docs, labels.limit(0), F.lit(True), label="v"))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert score(empty(spark), fit(empty(spark), labels, F.lit(True), label="v")).count() == 0


def test_sample_is_bounded_and_keeps_out_the_fold(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("v"))
    ids = [r["doc_id"] for r in labelled_sample(docs, labels, "v", 50, crc32_fold("doc_id", 5) != 0).collect()]
    assert len(ids) == 50 and all(zlib.crc32(str(d).encode()) % 5 for d in ids)


def test_sample_is_bounded_in_rows(spark):
    """One id holds equal rows and different texts; both count against the bound."""
    docs = spark.range(3000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 30).cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, v int")
    assert labelled_sample(docs, labels, "v", 50, F.lit(True)).count() == 30
    assert labelled_sample(docs, labels, "v", 2, F.lit(True)).count() == 2


def test_low_quality_rows_go_with_all_their_columns(spark):
    docs = awkward(spark, ["good text of the day"] * 20 + ["!! BAD !!"] * 20)
    labels = docs.where("doc_id >= 100").select("doc_id", (F.col("text") != "!! BAD !!").cast("int").alias("v"))
    kept = quality_gam.drop_low_quality(docs, quality_gam.fit_quality(docs, labels, F.lit(True), label="v"))
    assert kept.columns == docs.columns
    assert kept.where("text = '!! BAD !!'").count() == 0 and kept.where("doc_id >= 100").count() == 20


def test_sample_reads_whole_texts_once_each(spark):
    """Equal rows in many partitions count once; the texts come back as they are, over several tasks."""
    docs = spark.range(4000).select((F.col("id") % 400).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 800).cast("string")).alias("text")).repartition(16)
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("v"))
    sample = labelled_sample(docs, labels, "v", 1000, F.lit(True))
    got = sorted((r["doc_id"], r["text"], r["label"]) for r in sample.collect())
    assert got == sorted({(i % 400, f"t{i}", i % 2) for i in range(800)})
    few = [(r["doc_id"], r["text"]) for r in labelled_sample(docs, labels, "v", 100, F.lit(True)).collect()]
    assert len(few) == len(set(few)) == 100 and set(few) <= {(a, b) for a, b, _ in got}
    assert labelled_sample(docs.limit(0), labels, "v", 10, F.lit(True)).isEmpty()
