"""Checked queries: similarity, diversity, ranking, model metrics, forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.molecules import TOKEN
from ..functions.scores import dense_cosine, sign_bits
from ..operators import features, models, rules, similarity, validate
from ..session import stage
from .checks_rules import WORDS_SQL, fingerprint_sql
from .checks_tables import VALID_SQL
from .derived import COMPOUNDS_SQL, compounds, read
from .registry import REGISTRY, rounded

query = REGISTRY.add

_BITS = "[i - 1 for i in range(1, len(embedding) + 1) if embedding[i] > 0]"
_COMMON = "len(list_intersect(a.bits, b.bits))"


def _signs(spark, folder):
    return read(spark, folder, "embeddings").withColumn("bits", sign_bits(F.col("embedding")))


@query(
    "pair_scores",
    f"""WITH e AS (SELECT vec_id, embedding, {_BITS} AS bits FROM embeddings), p AS (SELECT a.vec_id, {_COMMON} AS c, len(a.bits) AS na, len(b.bits) AS nb,
            list_sum([CAST(a.embedding[i] AS DOUBLE) * b.embedding[i] for i in range(1, 65)]) AS ab, list_sum([CAST(x AS DOUBLE) * x for x in a.embedding]) AS aa,
            list_sum([CAST(x AS DOUBLE) * x for x in b.embedding]) AS bb FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
        SELECT vec_id, round(c / CAST(na + nb - c AS DOUBLE), 6) AS tanimoto, round(2 * c / CAST(na + nb AS DOUBLE), 6) AS dice,
        round(c / sqrt(CAST(na * nb AS DOUBLE)), 6) AS cosine, round(ab / sqrt(aa * bb), 6) AS dense FROM p""",
)
def pair_scores(spark, folder):
    """Each vector against its successor, by set and by dense scores."""
    left = _signs(spark, folder)
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("other"), F.col("embedding").alias("other_vector"))
    scored = similarity.pair_scores(left.join(right, "vec_id"), "bits", "other")
    scored = scored.withColumn("dense", dense_cosine(F.col("embedding"), F.col("other_vector")))
    return rounded(scored.select("vec_id", "tanimoto", "dice", "cosine", "dense"), tanimoto=6, dice=6, cosine=6, dense=6)


_QUERY_TEXT = "CN1C=NC2=C1C(=O)N(C(=O)N2C)Cl"


@query(
    "search_one",
    f"""WITH f AS ({fingerprint_sql(f"(SELECT row_id, smiles FROM ({COMPOUNDS_SQL}) UNION ALL SELECT -1, '{_QUERY_TEXT}')", "row_id", "smiles", TOKEN, " % 2048")}),
        q AS (SELECT bits FROM f WHERE id = -1),
        s AS (SELECT v.row_id, CASE WHEN reject_reason IS NULL THEN len(list_intersect(f.bits, q.bits)) / CAST(len(f.bits) + len(q.bits) - len(list_intersect(f.bits, q.bits)) AS DOUBLE)
            ELSE 0 END AS score, reject_reason FROM ({VALID_SQL}) v JOIN f ON f.id = v.row_id CROSS JOIN q),
        k AS (SELECT * FROM s WHERE score >= 0.3e0 ORDER BY score DESC, row_id LIMIT 25)
        SELECT CAST(row_number() OVER (ORDER BY score DESC, row_id) AS INT) AS rank, row_id, round(score, 6) AS similarity_score, 'tanimoto' AS metric,
        CASE WHEN reject_reason IS NOT NULL THEN 'Invalid target structure' END AS error, (SELECT count(*) FROM s) AS total_comparisons, (SELECT count(*) FROM k) AS above_threshold FROM k""",
)
def search_one(spark, folder):
    targets = features.with_fingerprint(validate.validate_structures(compounds(spark, folder)), "smiles")
    asked = features.with_fingerprint(spark.createDataFrame([(_QUERY_TEXT,)], "smiles string"), "smiles")
    found = similarity.search(
        targets, "row_id", "fingerprint", similarity.query_bits(asked, "fingerprint"), threshold=0.3, top_k=25, valid="valid"
    )
    return rounded(found, similarity_score=6)


@query(
    "search_all",
    f"""WITH e AS (SELECT vec_id, {_BITS} AS bits FROM embeddings), q AS (SELECT bits FROM e WHERE vec_id = 0),
        s AS (SELECT vec_id, len(list_intersect(e.bits, q.bits)) / CAST(len(e.bits) + len(q.bits) - len(list_intersect(e.bits, q.bits)) AS DOUBLE) AS score FROM e CROSS JOIN q)
        SELECT CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, round(score, 6) AS similarity_score, (SELECT count(*) FROM s) AS above_threshold FROM s""",
)
def search_all(spark, folder):
    """Every vector ranked against one, none left out."""
    signs = _signs(spark, folder)
    asked = similarity.query_bits(signs.filter("vec_id = 0"), "bits")
    return rounded(similarity.search(signs, "vec_id", "bits", asked).select("rank", "vec_id", "similarity_score", "above_threshold"), similarity_score=6)


@query(
    "search_many",
    f"""WITH d AS ({fingerprint_sql("documents", "doc_id", "text", WORDS_SQL)}), b AS ({fingerprint_sql("benchmark", "item_id", "text", WORDS_SQL)}),
        dt AS (SELECT id, unnest(bits) AS bit FROM d), bt AS (SELECT id, unnest(bits) AS bit FROM b),
        c AS (SELECT bt.id AS q, dt.id AS t, count(*) AS c FROM bt JOIN dt USING (bit) GROUP BY ALL),
        s AS (SELECT q, t, c / CAST(len(b.bits) + len(d.bits) - c AS DOUBLE) AS score FROM c JOIN b ON b.id = q JOIN d ON d.id = t),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS rank FROM s WHERE score >= 0.15e0)
        SELECT q AS item_id, CAST(rank AS INT) AS rank, t AS match_doc_id, round(score, 6) AS similarity_score FROM r WHERE rank <= 5""",
)
def search_many(spark, folder):
    """Every benchmark text against every document, the five nearest of each."""

    def bits(table, row_id):
        made = features.with_fingerprint(read(spark, folder, table), "text", "bits", n_bits=None, tokens=features.WORDS)
        return stage(made.select(row_id, "bits"), "bits")

    found = similarity.search_many(bits("benchmark", "item_id"), bits("documents", "doc_id"), "item_id", "doc_id", "bits", threshold=0.15, top_k=5)
    return rounded(found, similarity_score=6)


def _diversity_sql(score: str) -> str:
    return f"""WITH e AS (SELECT vec_id, embedding, {_BITS} AS bits FROM embeddings), p AS (SELECT {score} AS s FROM e a JOIN e b ON a.vec_id < b.vec_id)
        SELECT round(avg(s), 6) AS mean_similarity, round(stddev_pop(s), 6) AS std_similarity, round(min(s), 6) AS min_similarity, round(max(s), 6) AS max_similarity,
        round(1 - avg(s), 6) AS diversity_score, (SELECT count(*) FROM e) AS num_molecules, count(*) AS num_comparisons FROM p"""


@query("set_diversity", _diversity_sql(f"{_COMMON} / CAST(len(a.bits) + len(b.bits) - {_COMMON} AS DOUBLE)"))
def set_diversity(spark, folder):
    out = similarity.diversity(_signs(spark, folder), "bits").drop("error")
    return rounded(out, mean_similarity=6, std_similarity=6, min_similarity=6, max_similarity=6, diversity_score=6)


@query(
    "dense_diversity",
    """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) / n for x in embedding] AS u FROM (SELECT vec_id, embedding, sqrt(list_sum([CAST(x AS DOUBLE) * x for x in embedding])) AS n FROM embeddings)),
        p AS (SELECT list_dot_product(a.u, b.u) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id)
        SELECT round(avg(s), 6) AS mean_similarity, round(stddev_pop(s), 6) AS std_similarity, round(1 - avg(s), 6) AS diversity_score,
        (SELECT count(*) FROM e) AS num_molecules, count(*) AS num_comparisons FROM p""",
)
def dense_diversity(spark, folder):
    out = similarity.dense_diversity(read(spark, folder, "embeddings"), "embedding")
    return rounded(out, mean_similarity=6, std_similarity=6, diversity_score=6)


_GOALS = [
    {"property": "molecular_weight", "value": 350.0, "weight": 2.0, "tolerance": 25.0},
    {"property": "logp", "value": 2.0, "weight": 1.0, "direction": "minimize"},
    {"property": "tpsa", "value": 60.0, "weight": 0.5, "direction": "maximize"},
]


@query(
    "rank_candidates",
    f"""WITH c AS (SELECT *, coalesce(molecular_weight, 0) > 500 AS v1, coalesce(logp, 0) > 5 AS v2, coalesce(num_hbd, 0) > 5 AS v3, coalesce(num_hba, 0) > 10 AS v4 FROM ({COMPOUNDS_SQL})),
        k AS (SELECT * FROM c WHERE v1::INT + v2::INT + v3::INT + v4::INT <= 1 AND molecular_weight BETWEEN 200 AND 600 AND (num_hbd + 1) / 8.0e0 >= 0.3e0),
        s AS (SELECT row_id, abs(molecular_weight - 350) <= 25 AS m1, coalesce(logp <= 2, false) AS m2, coalesce(tpsa >= 60, false) AS m3,
            CASE WHEN abs(molecular_weight - 350) <= 25 THEN 1 ELSE 1 / (1 + (abs(molecular_weight - 350) - 25) / 350.0e0) END AS s1,
            CASE WHEN logp <= 2 THEN 1 ELSE coalesce(1 / (1 + (logp - 2) / 2.0e0), 0) END AS s2, CASE WHEN tpsa >= 60 THEN 1 ELSE coalesce(1 / (1 + (60 - tpsa) / 60.0e0), 0) END AS s3 FROM k),
        f AS (SELECT row_id, (2 * s1 + s2 + 0.5e0 * s3) / 3.5e0 AS fitness, concat_ws(',', CASE WHEN NOT m1 THEN 'molecular_weight' END, CASE WHEN NOT m2 THEN 'logp' END, CASE WHEN NOT m3 THEN 'tpsa' END) AS violations FROM s)
        SELECT row_id, round(fitness, 6) AS fitness, violations, CAST(row_number() OVER (ORDER BY fitness DESC, row_id) AS INT) AS rank FROM f ORDER BY fitness DESC, row_id LIMIT 50""",
)
def rank_candidates(spark, folder):
    rows = rules.rule_violations(compounds(spark, folder)).withColumn("similarity_score", (F.col("num_hbd") + 1) / 8)
    best = similarity.rank_candidates(
        rows, "row_id", _GOALS, {"molecular_weight": {"min": 200, "max": 600}}, "similarity_score", only=F.col("rule_pass"), top_k=50
    )
    return rounded(best.withColumn("violations", F.array_join("violations", ",")), fitness=6)


# --- model metrics -----------------------------------------------------------------


@query(
    "regression_metrics",
    """WITH d AS (SELECT l_extendedprice AS y, l_quantity * 2100 AS p FROM lineitem), m AS (SELECT avg(y) AS mean FROM d)
        SELECT round(avg((y - p) * (y - p)), 0) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
        round(1 - sum((y - p) * (y - p)) / sum((y - mean) * (y - mean)), 6) AS r2, round(100 * avg(abs((y - p) / nullif(y, 0))), 6) AS mape,
        round(max(abs(y - p)), 4) AS max_error FROM d CROSS JOIN m""",
)
def regression_metrics(spark, folder):
    rows = read(spark, folder, "lineitem").withColumn("p", F.col("l_quantity") * 2100)
    return rounded(models.regression_metrics(rows, "l_extendedprice", "p"), mse=0, rmse=4, mae=4, r2=6, mape=6, max_error=4)


@query(
    "classification_metrics",
    """WITH d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity / 50 > 0.5e0 THEN 1 ELSE 0 END AS p FROM lineitem),
        k AS (SELECT label, count(*) FILTER (WHERE y = label) AS support, count(*) FILTER (WHERE p = label) AS guessed, count(*) FILTER (WHERE y = label AND p = label) AS hits FROM d CROSS JOIN (VALUES (0), (1)) c(label) GROUP BY label),
        m AS (SELECT *, coalesce(hits / nullif(guessed, 0)::DOUBLE, 0) AS pr, coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS re FROM k)
        SELECT round(sum(hits) / sum(support)::DOUBLE, 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision, round(sum(re * support) / sum(support), 6) AS recall,
        round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * support) / sum(support), 6) AS f1 FROM m""",
)
def classification_metrics(spark, folder):
    rows = read(spark, folder, "lineitem").selectExpr("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", "l_quantity / 50 AS s")
    return rounded(models.classification_metrics(rows, "y", "s"), accuracy=6, precision=6, recall=6, f1=6)


@query(
    "auc",
    """WITH d AS (SELECT (l_returnflag = 'R')::INT AS y, round(l_extendedprice / 10) + l_quantity AS s FROM lineitem),
        r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0e0 AS r FROM d), n AS (SELECT count(*) FILTER (WHERE y = 1)::DOUBLE AS p, count(*) FILTER (WHERE y = 0)::DOUBLE AS q FROM d)
        SELECT round((sum(r) FILTER (y = 1) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(q)), 6) AS auc FROM r CROSS JOIN n""",
)
def auc(spark, folder):
    rows = read(spark, folder, "lineitem").selectExpr("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", "round(l_extendedprice / 10) + l_quantity AS s")
    return rounded(models.auc(rows, "y", "s"), auc=6)


_FOREST_FEATURES = ["n_chars", "n_tokens", "count_C", "count_N", "count_O"]


def _labelled(spark, folder):
    described = features.with_token_counts(read(spark, folder, "documents"), "text").drop("text")
    return described.join(read(spark, folder, "labels"), "doc_id")


def _predicted(spark, folder):
    """Fitted on the labelled documents, applied to all."""
    described = features.with_token_counts(read(spark, folder, "documents"), "text").drop("text")
    model = models.ForestModel("classification", trees=20, depth=5).fit(_labelled(spark, folder), _FOREST_FEATURES, "quality")
    return model.predict(described)


@query("forest_predictions", "SELECT doc_id, true AS is_class FROM documents")
def forest_predictions(spark, folder):
    """Each document gets one of the classes; ``forest_classes`` has which."""
    return _predicted(spark, folder).select("doc_id", F.col("prediction").isin(0.0, 1.0).alias("is_class"))


@query("forest_classes")
def forest_classes(spark, folder):
    return _predicted(spark, folder).select("doc_id", "prediction")


@query(
    "forest_importance_sum",
    f"SELECT CAST({len(_FOREST_FEATURES)} AS BIGINT) AS features, CASE WHEN count(*) > 0 THEN 1.0e0 END AS total FROM labels JOIN documents USING (doc_id)",
)
def forest_importance_sum(spark, folder):
    """Importances are shares of one."""
    found = forest_importances(spark, folder)
    return found.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), 6).alias("total"))


@query("forest_importances")
def forest_importances(spark, folder):
    rows = _labelled(spark, folder)
    model = models.ForestModel("regression", trees=20, depth=5).fit(rows, _FOREST_FEATURES, "toxic")
    return model.importances(spark)
