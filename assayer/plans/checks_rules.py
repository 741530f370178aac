"""Checked queries: range rules, features, quality profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import molecules
from ..operators import features, quality, rules
from .derived import COMPOUNDS_SQL, compounds, read
from .checks_tables import VALID_SQL
from .registry import REGISTRY, rounded

query = REGISTRY.add

RANGES = {"l_quantity": {"min": 5, "max": 40}, "l_discount": {"max": 0.07}, "l_tax": {"min": 0.01}}


@query(
    "range_filter",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
        WHERE l_quantity BETWEEN 5 AND 40 AND l_discount <= 0.07e0 AND l_tax >= 0.01e0""",
)
def range_filter(spark, folder):
    rows = rules.within_ranges(read(spark, folder, "lineitem"), RANGES)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query(
    "drug_like_filter",
    f"""SELECT row_id, molecular_weight, logp FROM ({COMPOUNDS_SQL}) WHERE molecular_weight BETWEEN 150 AND 500 AND logp BETWEEN -3 AND 5
        AND num_hbd <= 5 AND num_hba <= 10 AND tpsa <= 140""",
)
def drug_like_filter(spark, folder):
    return rules.drug_like(compounds(spark, folder)).select("row_id", "molecular_weight", "logp")


@query(
    "rule_attrition",
    """WITH fate AS (SELECT CASE WHEN NOT l_quantity >= 5 THEN 0 WHEN NOT l_quantity <= 40 THEN 1 WHEN NOT l_discount <= 0.07e0 THEN 2
            WHEN NOT l_tax >= 0.01e0 THEN 3 ELSE 4 END AS rule_no FROM lineitem)
        SELECT CAST(n.rule_no AS INT) AS rule_no, n.rule, count(f.rule_no) AS row_count FROM (VALUES (0, 'l_quantity_min'), (1, 'l_quantity_max'),
            (2, 'l_discount_max'), (3, 'l_tax_min'), (4, 'kept')) n(rule_no, rule) LEFT JOIN fate f USING (rule_no) GROUP BY ALL""",
)
def rule_attrition(spark, folder):
    return rules.attrition(read(spark, folder, "lineitem"), RANGES)


@query(
    "rule_of_five",
    f"""SELECT *, CAST((NOT molecular_weight_ok)::INT + (NOT logp_ok)::INT + (NOT num_hbd_ok)::INT + (NOT num_hba_ok)::INT AS INT) AS violations,
        (NOT molecular_weight_ok)::INT + (NOT logp_ok)::INT + (NOT num_hbd_ok)::INT + (NOT num_hba_ok)::INT <= 1 AS rule_pass FROM (
        SELECT row_id, coalesce(molecular_weight, 0) <= 500 AS molecular_weight_ok, coalesce(logp, 0) <= 5 AS logp_ok,
        coalesce(num_hbd, 0) <= 5 AS num_hbd_ok, coalesce(num_hba, 0) <= 10 AS num_hba_ok FROM ({COMPOUNDS_SQL}))""",
)
def rule_of_five(spark, folder):
    judged = rules.rule_violations(compounds(spark, folder))
    return judged.select("row_id", "molecular_weight_ok", "logp_ok", "num_hbd_ok", "num_hba_ok", "violations", "rule_pass")


@query(
    "property_bands",
    f"""SELECT row_id, CASE WHEN molecular_weight < 150 THEN 'low' WHEN molecular_weight > 500 THEN 'high' ELSE 'ok' END AS molecular_weight_band,
        CASE WHEN logp < 0 THEN 'low' WHEN logp > 3 THEN 'high' ELSE 'ok' END AS logp_band,
        CASE WHEN tpsa < 20 THEN 'low' WHEN tpsa > 130 THEN 'high' WHEN tpsa IS NOT NULL THEN 'ok' END AS tpsa_band,
        CASE WHEN num_hbd / 8.0e0 > 0.7e0 THEN 'high' WHEN num_hbd / 8.0e0 > 0.5e0 THEN 'medium' ELSE 'low' END AS score_band FROM ({COMPOUNDS_SQL})""",
)
def property_bands(spark, folder):
    banded = rules.property_bands(compounds(spark, folder))
    return banded.select(
        "row_id", "molecular_weight_band", "logp_band", "tpsa_band", rules.score_band(F.col("num_hbd") / 8).alias("score_band")
    )


@query(
    "project_properties",
    f"""SELECT row_id, molecular_weight, tpsa, CAST(NULL AS DOUBLE) AS solubility, 'unknown property: solubility' AS errors FROM ({COMPOUNDS_SQL})""",
)
def project_properties(spark, folder):
    asked = ["molecular_weight", "tpsa", "solubility"]
    out = rules.project_properties(compounds(spark, folder), "row_id", asked)
    return out.select("row_id", *[F.col("properties")[p].alias(p) for p in asked], F.array_join("errors", "; ").alias("errors"))


@query("feature_matrix", f"SELECT row_id, smiles, molecular_weight, logp, tpsa, num_hbd, num_hba, target FROM ({COMPOUNDS_SQL})")
def feature_matrix(spark, folder):
    return rules.feature_matrix(compounds(spark, folder), row_id="row_id")


@query(
    "page_of_orders",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total_items, (SELECT CAST(ceil(count(*) / 25.0e0) AS BIGINT) FROM orders) AS total_pages,
        CAST(17 AS BIGINT) AS current_page, (SELECT count(*) > 425 FROM orders) AS has_next, true AS has_previous FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 400""",
)
def page_of_orders(spark, folder):
    rows = read(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return rules.page(rows, "o_orderkey", number=17, size=25)


@query(
    "page_by_name",
    """SELECT c_name, c_acctbal, (SELECT count(*) FROM customer) AS total_items, (SELECT CAST(ceil(count(*) / 10.0e0) AS BIGINT) FROM customer) AS total_pages,
        CAST(12 AS BIGINT) AS current_page, (SELECT count(*) > 120 FROM customer) AS has_next, true AS has_previous FROM customer ORDER BY c_name LIMIT 10 OFFSET 110""",
)
def page_by_name(spark, folder):
    """Pages by a text key."""
    rows = read(spark, folder, "customer").select("c_name", "c_acctbal")
    return rules.page(rows, "c_name", number=12, size=10)


@query(
    "pages_cover_all_rows",
    """SELECT CAST(ceil(place / 400.0e0) AS INT) AS page, count(*) AS row_count, CAST(sum(k) AS BIGINT) AS key_sum FROM (
        SELECT k, row_number() OVER (ORDER BY k NULLS FIRST) AS place FROM (SELECT nullif(c_custkey, 77) AS k FROM customer)) GROUP BY 1""",
)
def pages_cover_all_rows(spark, folder):
    """All pages of a table with a missing key, counted."""
    rows = read(spark, folder, "customer").selectExpr("nullif(c_custkey, 77) AS k")
    pages = rules.with_pages(rows, "k", 400)
    return pages.groupBy("page").agg(F.count(F.lit(1)).alias("row_count"), F.sum("k").alias("key_sum"))


# --- features ---------------------------------------------------------------------


@query(
    "formula_features",
    rf"""WITH f AS (SELECT row_id, regexp_replace(molecular_formula, '[+-][0-9]*$', '') AS formula FROM ({COMPOUNDS_SQL})),
        terms AS (SELECT row_id, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 1)) AS symbol,
            unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 2)) AS n FROM f),
        mass(symbol, m) AS (VALUES ('H', 1.008e0), ('C', 12.011e0), ('N', 14.007e0), ('O', 15.999e0), ('F', 18.998e0), ('S', 32.06e0), ('Cl', 35.45e0), ('Br', 79.904e0))
        SELECT row_id, CASE WHEN count(m) = count(*) THEN round(sum(m * CASE WHEN n = '' THEN 1 ELSE CAST(n AS INT) END), 4) END AS formula_weight,
            CASE WHEN count(m) = count(*) THEN CAST(sum(CASE WHEN symbol = 'H' THEN 0 WHEN n = '' THEN 1 ELSE CAST(n AS INT) END) AS DOUBLE) END AS heavy_atoms
        FROM terms LEFT JOIN mass USING (symbol) GROUP BY row_id""",
)
def formula_features(spark, folder):
    out = features.with_formula_features(compounds(spark, folder))
    return out.select("row_id", F.round("formula_weight", 4).alias("formula_weight"), F.col("formula_heavy_atoms").cast("double").alias("heavy_atoms"))


@query(
    "token_counts",
    """SELECT doc_id, CAST(length(text) AS INT) AS n_tokens, CAST(length(text) - length(replace(text, 'C', '')) AS INT) AS count_C, CAST(length(text) - length(replace(text, 'N', '')) AS INT) AS count_N,
        CAST(length(text) - length(replace(text, 'O', '')) AS INT) AS count_O,
        CAST(20 + 20 * (length(text) - length(replace(text, 'O', ''))) + 12 * (length(text) - length(replace(text, 'N', ''))) AS INT) AS token_weight FROM documents""",
)
def token_counts(spark, folder):
    return features.with_token_counts(read(spark, folder, "documents"), "text").select(
        "doc_id", "n_tokens", "count_C", "count_N", "count_O", "token_weight"
    )


def fingerprint_sql(table: str, row_id: str, text: str, tokens: str, fold: str = "") -> str:
    """(id, bits): distinct sorted n-gram values, n = 1 to 3."""
    return f"""SELECT {row_id} AS id, list_sort(list_distinct(list_concat(list_concat([x{fold} for x in g1], [x{fold} for x in g2]), [x{fold} for x in g3]))) AS bits FROM (
        SELECT *, [(g2[i] * 1000003 + g1[i + 2] + 1) % 2147483647 for i in range(1, len(g1) - 1)] AS g3 FROM (
        SELECT *, [(g1[i] * 1000003 + g1[i + 1] + 1) % 2147483647 for i in range(1, len(g1))] AS g2 FROM (
        SELECT {row_id}, [CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 2147483647 for w in regexp_extract_all(coalesce({text}, ''), '{tokens}')] AS g1 FROM {table})))"""


WORDS_SQL = r"[^ \n\r\t]+"


@query(
    "structure_fingerprints",
    f"""SELECT id AS row_id, len(bits) AS n_set, array_to_string(bits, ',') AS bits FROM ({fingerprint_sql(f"({COMPOUNDS_SQL})", "row_id", "smiles", molecules.TOKEN, " % 2048")})""",
)
def structure_fingerprints(spark, folder):
    out = features.with_fingerprint(compounds(spark, folder), "smiles")
    return out.select("row_id", F.size("fingerprint").cast("bigint").alias("n_set"), F.array_join("fingerprint", ",").alias("bits"))


@query(
    "text_fingerprints",
    f"""SELECT id AS doc_id, len(bits) AS n_set, md5(array_to_string(bits, ',')) AS bits_md5 FROM ({fingerprint_sql("documents", "doc_id", "text", WORDS_SQL)})""",
)
def text_fingerprints(spark, folder):
    out = features.with_fingerprint(read(spark, folder, "documents"), "text", n_bits=None, tokens=features.WORDS)
    return out.select("doc_id", F.size("fingerprint").cast("bigint").alias("n_set"), F.md5(F.array_join("fingerprint", ",")).alias("bits_md5"))


@query(
    "custom_descriptors",
    f"""SELECT row_id, length(smiles) AS size, CASE WHEN length(trim(smiles)) > 0 THEN round(length(smiles) / CAST(length(trim(smiles)) AS DOUBLE), 6) END AS blank_ratio FROM ({COMPOUNDS_SQL})""",
)
def custom_descriptors(spark, folder):
    """One descriptor as an expression, one as a Python function that fails on blanks."""
    ratio = features.python_descriptor(lambda s: round(len(s) / len(s.strip()), 6))
    out = features.with_descriptors(compounds(spark, folder), "smiles", [("size", F.length("smiles")), ("blank_ratio", ratio)])
    return out.select("row_id", F.col("size").cast("bigint").alias("size"), "blank_ratio")


@query(
    "standardise_columns",
    f"""WITH c AS (SELECT row_id, coalesce(tpsa, 0) AS tpsa, coalesce(logp, 0) AS logp FROM ({COMPOUNDS_SQL}))
        SELECT row_id, round((tpsa - (SELECT avg(tpsa) FROM c)) / (SELECT stddev_pop(tpsa) FROM c), 6) AS tpsa_std,
        round((logp - (SELECT avg(logp) FROM c)) / (SELECT stddev_pop(logp) FROM c), 6) AS logp_std, 0.0e0 AS constant_std FROM c""",
)
def standardise_columns(spark, folder):
    rows = compounds(spark, folder).withColumn("constant", F.lit(7))
    out = features.standardise(rows, ["tpsa", "logp", "constant"])
    return rounded(out.select("row_id", "tpsa_std", "logp_std", "constant_std"), tpsa_std=6, logp_std=6)


@query(
    "feature_importance",
    f"""WITH c AS (SELECT coalesce(molecular_weight, 0)::DOUBLE AS molecular_weight, coalesce(logp, 0)::DOUBLE AS logp, coalesce(tpsa, 0)::DOUBLE AS tpsa,
            coalesce(num_hbd, 0)::DOUBLE AS num_hbd, coalesce(num_hba, 0)::DOUBLE AS num_hba, target FROM ({COMPOUNDS_SQL}) WHERE target IS NOT NULL),
        u AS (UNPIVOT c ON molecular_weight, logp, tpsa, num_hbd, num_hba INTO NAME feature VALUE x),
        e AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM u GROUP BY feature), y AS (SELECT min(target) AS lo, max(target) AS hi FROM c),
        b AS (SELECT feature, least(9, floor((x - e.lo) / (e.hi - e.lo) * 10)) AS xb, least(9, floor((target - y.lo) / (y.hi - y.lo) * 10)) AS yb
            FROM u JOIN e USING (feature) CROSS JOIN y),
        j AS (SELECT feature, xb, yb, count(*)::DOUBLE AS c FROM b GROUP BY ALL),
        t AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, xb) AS cx, sum(c) OVER (PARTITION BY feature, yb) AS cy FROM j)
        SELECT feature, round(greatest(sum(c / n * ln(c * n / (cx * cy))), 0), 6) AS importance FROM t GROUP BY feature""",
)
def feature_importance(spark, folder):
    return rounded(features.feature_importance(compounds(spark, folder).drop("row_id"), "target"), importance=6)


_WIDE = {f"c{i}": f"l_quantity % {i + 3} + l_tax * {i}" for i in range(6)} | {"c6": "l_discount", "c7": "l_extendedprice"}


@query(
    "correlation_wide",
    f"WITH l AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _WIDE.items())} FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM l" for a in _WIDE for b in _WIDE),
)
def correlation_wide(spark, folder):
    """Eight columns, 28 pairs."""
    return rounded(features.correlations(read(spark, folder, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _WIDE.items()])), corr=6)


_PAIR_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant")
_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(CASE WHEN isnan(r) THEN NULL ELSE r END, 6) AS corr FROM (SELECT corr({a}, {b}) AS r FROM l)"
    for a in _PAIR_COLUMNS
    for b in _PAIR_COLUMNS
)


@query("correlation_matrix", f"WITH l AS (SELECT l_quantity, l_extendedprice, nullif(l_discount, 0.05e0) AS l_discount, l_tax, 1.0e0 AS constant FROM lineitem) {_PAIRS_SQL}")
def correlation_matrix(spark, folder):
    rows = read(spark, folder, "lineitem").withColumns({"l_discount": F.expr("nullif(l_discount, 0.05D)"), "constant": F.lit(1.0)})
    return rounded(features.correlations(rows, list(_PAIR_COLUMNS)), corr=6)


@query(
    "price_histogram",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
        b AS (SELECT CAST(least(49, floor((l_extendedprice - lo) / (hi - lo) * 50)) AS INT) AS bin, count(*) AS c FROM lineitem CROSS JOIN e GROUP BY 1)
        SELECT CAST(r.range AS INT) AS bin, round(lo + r.range * (hi - lo) / 50, 4) AS bin_start, round(lo + (r.range + 1) * (hi - lo) / 50, 4) AS bin_end,
        coalesce(c, 0) AS row_count FROM range(50) r CROSS JOIN e LEFT JOIN b ON b.bin = r.range""",
)
def price_histogram(spark, folder):
    return rounded(features.histogram(read(spark, folder, "lineitem"), "l_extendedprice", 50), bin_start=4, bin_end=4)


# --- quality profile ------------------------------------------------------------------

_COMPOUND_NAMES = ("row_id", "smiles", "molecular_formula", "molecular_weight", "logp", "tpsa", "num_hbd", "num_hba", "scaffold", "target")
MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, round(100.0e0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS missing_pct FROM c" for c in _COMPOUND_NAMES
)


@query("missing_values", f"WITH c AS ({COMPOUNDS_SQL}) {MISSING_SQL}")
def missing_values(spark, folder):
    return rounded(quality.missing_values(compounds(spark, folder)), missing_pct=6)


_PART_TYPES = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}
_TYPES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) - count({c}) AS missing_count FROM p" for c, t in _PART_TYPES.items()
)


@query("column_types", f"WITH p AS (SELECT * REPLACE (nullif(p_size, 7) AS p_size) FROM part) {_TYPES_SQL}")
def column_types(spark, folder):
    """Types next to the missing counts of the same columns."""
    rows = read(spark, folder, "part").withColumn("p_size", F.expr("nullif(p_size, 7)"))
    return quality.column_types(rows).join(quality.missing_values(rows), "column_name").select("column_name", "data_type", "missing_count")


RATE_SQL = f"""SELECT count(*) AS total_keys, count(*) FILTER (WHERE reject_reason IS NULL) AS valid_keys, count(*) FILTER (WHERE reject_reason IS NOT NULL) AS invalid_keys,
    100.0e0 * count(*) FILTER (WHERE reject_reason IS NULL) / count(*) AS validity_rate FROM ({VALID_SQL}) WHERE smiles IS NOT NULL"""


@query("validity_rate", f"SELECT * REPLACE (round(validity_rate, 6) AS validity_rate) FROM ({RATE_SQL})")
def validity_rate(spark, folder):
    return rounded(quality.validity_rate(compounds(spark, folder), "smiles"), validity_rate=6)


@query("invalid_examples", f"SELECT row_id, smiles FROM ({VALID_SQL}) WHERE smiles IS NOT NULL AND reject_reason IS NOT NULL ORDER BY row_id LIMIT 5")
def invalid_examples(spark, folder):
    return quality.invalid_examples(compounds(spark, folder), "smiles", "row_id")


_OUTLIER_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_IQR_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(any_value(lo), 6) AS lower_bound, round(any_value(hi), 6) AS upper_bound, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outlier_count,
    round(100.0e0 * count(*) FILTER (WHERE {c} < lo OR {c} > hi) / count({c}), 6) AS outlier_pct FROM l CROSS JOIN (SELECT q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi
    FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM l))"""
    for c in _OUTLIER_COLUMNS
)
_SKEWED_SQL = "WITH l AS (SELECT l_quantity * l_quantity * l_quantity AS l_quantity, l_extendedprice, l_discount, CASE WHEN l_linenumber = 7 THEN l_tax * 100 ELSE l_tax END AS l_tax FROM lineitem) "


def _skewed(spark, folder):
    return read(spark, folder, "lineitem").selectExpr(
        "l_quantity * l_quantity * l_quantity AS l_quantity", "l_extendedprice", "l_discount",
        "CASE WHEN l_linenumber = 7 THEN l_tax * 100 ELSE l_tax END AS l_tax",
    )


@query("iqr_outliers", _SKEWED_SQL + _IQR_SQL)
def iqr_outliers(spark, folder):
    found = quality.iqr_outliers(_skewed(spark, folder), list(_OUTLIER_COLUMNS))
    return rounded(found, lower_bound=6, upper_bound=6, outlier_pct=6)


_Z_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(any_value(m), 4) AS mean, round(any_value(s), 4) AS std, count(*) FILTER (WHERE abs({c} - m) / s > 3) AS outlier_count,
    round(100.0e0 * count(*) FILTER (WHERE abs({c} - m) / s > 3) / count({c}), 6) AS outlier_pct FROM l CROSS JOIN (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM l)"""
    for c in _OUTLIER_COLUMNS
)


@query("zscore_outliers", _SKEWED_SQL + _Z_SQL)
def zscore_outliers(spark, folder):
    found = quality.zscore_outliers(_skewed(spark, folder), list(_OUTLIER_COLUMNS))
    return rounded(found, mean=4, std=4, outlier_pct=6)


_ADVICE_COLUMNS = "row_id, CASE WHEN row_id % 3 = 0 THEN 1 END AS mostly_missing, CASE WHEN row_id % 3 > 0 THEN 1 END AS often_missing, smiles"


@query(
    "recommendations",
    f"""WITH c AS (SELECT {_ADVICE_COLUMNS}, reject_reason FROM ({VALID_SQL})),
        m AS (SELECT 100.0e0 * count(*) FILTER (WHERE mostly_missing IS NULL) / count(*) AS p1, 100.0e0 * count(*) FILTER (WHERE often_missing IS NULL) / count(*) AS p2,
            count(*) FILTER (WHERE smiles IS NOT NULL AND reject_reason IS NOT NULL) AS bad, count(*) - count(DISTINCT smiles) - max((smiles IS NULL)::INT) AS dup FROM c)
        SELECT CAST(2 AS BIGINT) AS position, format('Consider removing column ''mostly_missing'' (>{{:.1f}}% missing)', p1) AS recommendation FROM m
        UNION ALL SELECT 3, format('High missing data in ''often_missing'' ({{:.1f}}%)', p2) FROM m
        UNION ALL SELECT 1000000, format('Remove {{}} invalid SMILES', bad) FROM m UNION ALL SELECT 1000001, format('Remove {{}} duplicate SMILES', dup) FROM m""",
)
def recommendations(spark, folder):
    rows = compounds(spark, folder).selectExpr(*_ADVICE_COLUMNS.split(", "))
    return quality.recommendations(rows, "smiles")


@query(
    "quality_score",
    f"""WITH c AS ({COMPOUNDS_SQL}), m AS (SELECT avg(missing_pct) AS avg_missing_pct FROM (
            {" UNION ALL ".join(f"SELECT 100.0e0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) AS missing_pct FROM c" for c in _COMPOUND_NAMES)})), v AS ({RATE_SQL})
        SELECT round(avg_missing_pct, 6) AS avg_missing_pct, round(validity_rate, 6) AS validity_rate,
        round(greatest(0, 100 - 0.5e0 * avg_missing_pct - 0.3e0 * (100 - validity_rate)), 6) AS quality_score FROM m CROSS JOIN v""",
)
def quality_score(spark, folder):
    scored = quality.quality_score(compounds(spark, folder), "smiles")
    return rounded(scored, avg_missing_pct=6, validity_rate=6, quality_score=6)


@query("value_counts", "SELECT o_orderpriority, count(*) AS row_count FROM orders GROUP BY 1")
def value_counts(spark, folder):
    return quality.value_counts(read(spark, folder, "orders"), "o_orderpriority")


@query("quality_profile")
def quality_profile(spark, folder):
    """The whole profile as one table; its parts are checked one by one above."""
    return quality.profile(compounds(spark, folder), "smiles")
