"""Checked queries: splits and activity data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity, splits
from .derived import ACTIVITIES_SQL, COMPOUNDS_SQL, activities, compounds, read
from .prepare import document_split
from .registry import REGISTRY, rounded, stamp

query = REGISTRY.add

# --- splits -----------------------------------------------------------------------


def _hash_sql(key: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"


_SHARES = "(0.15e0 / (0.7e0 + 0.15e0 + 0.15e0)) AS ts, (0.15e0 / (0.7e0 + 0.15e0 + 0.15e0)) / ((0.7e0 / (0.7e0 + 0.15e0 + 0.15e0)) + (0.15e0 / (0.7e0 + 0.15e0 + 0.15e0))) AS vs"


def _random_sql(table: str, key: str, columns: str, target: str | None = None, smallest: int = 1) -> str:
    part = f"PARTITION BY {target}" if target else ""
    return f"""SELECT {columns}, CASE WHEN n < {smallest} THEN 'train' WHEN rn <= nt THEN 'test' WHEN rn <= nt + ceil((n - nt) * vs) THEN 'val' ELSE 'train' END AS split FROM (
        SELECT *, ceil(n * ts) AS nt FROM (SELECT *, {_SHARES}, count(*) OVER ({part}) AS n, row_number() OVER ({part} ORDER BY {_hash_sql(key)}, {key}) AS rn FROM {table}))"""


RANDOM_SQL = _random_sql("orders", "o_orderkey", "o_orderkey")


@query("random_split", RANDOM_SQL)
def random_split(spark, folder):
    return splits.random_split(read(spark, folder, "orders"), "o_orderkey").select("o_orderkey", "split")


@query(
    "bernoulli_split",
    f"""SELECT o_orderkey, CASE WHEN pos < 0.15e0 / (0.7e0 + 0.15e0 + 0.15e0) THEN 'test'
        WHEN pos < 0.15e0 / (0.7e0 + 0.15e0 + 0.15e0) + 0.15e0 / (0.7e0 + 0.15e0 + 0.15e0) THEN 'val' ELSE 'train' END AS split
        FROM (SELECT o_orderkey, {_hash_sql("o_orderkey")} / 4294967296.0e0 AS pos FROM orders)""",
)
def bernoulli_split(spark, folder):
    return splits.random_split(read(spark, folder, "orders"), "o_orderkey", mode="bernoulli").select("o_orderkey", "split")


@query("stratified_split", _random_sql("orders", "o_orderkey", "o_orderkey, o_orderstatus", "o_orderstatus", 3))
def stratified_split(spark, folder):
    parted = splits.random_split(read(spark, folder, "orders"), "o_orderkey", target="o_orderstatus")
    return parted.select("o_orderkey", "o_orderstatus", "split")


_LABELS = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality END AS quality FROM labels)"


def _labels(spark, folder):
    return read(spark, folder, "labels").selectExpr("doc_id", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality END AS quality")


@query("balanced_split", _random_sql(_LABELS, "doc_id", "doc_id, coalesce(quality, -1) AS quality", "quality", 1))
def balanced_split(spark, folder):
    parted = splits.balanced_split(_labels(spark, folder), "doc_id", "quality")
    return parted.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "split")


def _group_sql(rows: str, columns: str) -> str:
    """Closed form of the greedy fill over (row_id, grp) rows."""
    return f"""WITH r AS ({rows}), n AS (SELECT count(*) AS n, floor(count(*) * 0.7e0) AS train_size, floor(count(*) * 0.15e0) AS val_size FROM r),
        g AS (SELECT coalesce(grp, 'row:' || row_id) AS key, count(*) AS c, min(row_id) AS first FROM r GROUP BY 1),
        p AS (SELECT key, sum(c) OVER (ORDER BY c DESC, first ROWS UNBOUNDED PRECEDING) AS i, c FROM g),
        t AS (SELECT min(i) AS t FROM p CROSS JOIN n WHERE i >= train_size),
        a AS (SELECT key, CASE WHEN i - c < train_size THEN 'train' WHEN i - c - t < val_size THEN 'val' ELSE 'test' END AS split FROM p CROSS JOIN n CROSS JOIN t)
        SELECT {columns}, split FROM r JOIN a ON a.key = coalesce(grp, 'row:' || row_id)"""


@query("group_split", _group_sql("SELECT doc_id AS row_id, source AS grp FROM documents", "row_id AS doc_id"))
def group_split(spark, folder):
    return splits.group_split(read(spark, folder, "documents"), "doc_id", "source").select("doc_id", "split")


@query("scaffold_split", _group_sql(f"SELECT row_id, scaffold AS grp FROM ({COMPOUNDS_SQL})", "row_id"))
def scaffold_split(spark, folder):
    """Many small groups and rows without a group."""
    return splits.group_split(compounds(spark, folder), "row_id", "scaffold").select("row_id", "split")


@query("cluster_split")
def cluster_split(spark, folder):
    parted = splits.cluster_split(read(spark, folder, "embeddings"), ["embedding"])
    return parted.groupBy("cluster", "split").agg(F.count(F.lit(1)).alias("row_count"))


TEMPORAL_SQL = """SELECT o_orderkey, strftime(d, '%Y-%m-%d %H:%M:%S.%f') AS order_date, CASE WHEN rn <= floor(n * 0.7e0) THEN 'train'
    WHEN rn <= floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'val' ELSE 'test' END AS split FROM (
    SELECT o_orderkey, d, row_number() OVER (ORDER BY d NULLS LAST, o_orderkey) AS rn, count(*) OVER () AS n FROM (
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders))"""


@query("temporal_split", TEMPORAL_SQL)
def temporal_split(spark, folder):
    orders = read(spark, folder, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS d")
    parted = splits.temporal_split(orders, "o_orderkey", "d")
    return parted.select("o_orderkey", stamp("d").alias("order_date"), "split")


@query(
    "split_statistics",
    f"""SELECT split, o_orderstatus, count(*) AS row_count, CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS split_size,
        round(CAST(sum(count(*)) OVER (PARTITION BY split) AS DOUBLE) / (SELECT count(*) FROM orders), 6) AS split_ratio FROM (
        {_random_sql("orders", "o_orderkey", "o_orderkey, o_orderstatus")}) GROUP BY split, o_orderstatus""",
)
def split_statistics(spark, folder):
    parted = splits.random_split(read(spark, folder, "orders"), "o_orderkey")
    return rounded(splits.split_statistics(parted, "o_orderstatus"), split_ratio=6)


def _checks_sql(parted: str) -> str:
    """The checks, computed from a split table (o_orderkey, split)."""

    def apart(a: str, b: str) -> str:
        return f"(SELECT count(*) = 0 FROM p x JOIN p y USING (o_orderkey) WHERE x.split = '{a}' AND y.split = '{b}')"

    return f"""WITH p AS ({parted}), c AS (SELECT (SELECT count(*) FROM p) = (SELECT count(*) FROM orders) AS size_preserved, {apart("train", "val")} AS no_train_val_overlap,
        {apart("train", "test")} AS no_train_test_overlap, {apart("val", "test")} AS no_val_test_overlap, (SELECT count(*) = 0 FROM orders ANTI JOIN p USING (o_orderkey)) AS all_rows_covered)
        SELECT *, size_preserved AND no_train_val_overlap AND no_train_test_overlap AND no_val_test_overlap AND all_rows_covered AS valid_split FROM c"""


_BY_KEY = """SELECT o_orderkey, CASE WHEN rn <= floor(n * 0.7e0) THEN 'train' WHEN rn <= floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)"""


@query("validate_split", _checks_sql(f"{_BY_KEY} UNION ALL SELECT o_orderkey, 'val' FROM ({_BY_KEY}) WHERE split = 'train' AND o_orderkey % 10 = 0"))
def validate_split(spark, folder):
    """A split with a planted fault: some train rows appear in val as well."""
    orders = read(spark, folder, "orders").select("o_orderkey")
    parted = splits.temporal_split(orders.withColumn("d", F.col("o_orderkey")), "o_orderkey", "d").drop("d")
    doubled = parted.filter("split = 'train' AND o_orderkey % 10 = 0").withColumn("split", F.lit("val"))
    return splits.validate_split(parted.unionByName(doubled), orders, "o_orderkey")


@query("validate_good_split", _checks_sql(f"SELECT o_orderkey, split FROM ({_random_sql('orders', 'o_orderkey', 'o_orderkey', 'o_orderstatus')})"))
def validate_good_split(spark, folder):
    orders = read(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    parted = splits.split_table(orders, "o_orderkey", "balanced", target="o_orderstatus")
    return splits.validate_split(parted, orders, "o_orderkey")


_DOCUMENT_ROWS = """SELECT doc_id AS row_id, source AS grp, lang FROM (SELECT * FROM documents WHERE trim(text) <> ''
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) WHERE n_chars BETWEEN 100 AND 20000"""


@query(
    "document_split",
    f"""SELECT split, lang, count(*) AS row_count, CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS split_size,
        round(CAST(sum(count(*)) OVER (PARTITION BY split) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS split_ratio
        FROM ({_group_sql(_DOCUMENT_ROWS, "lang")}) GROUP BY split, lang""",
)
def document_split_query(spark, folder):
    return rounded(document_split(read(spark, folder, "documents")), split_ratio=6)


# --- activity data -------------------------------------------------------------------


@query(
    "select_activities",
    f"""SELECT molecule_chembl_id, standard_type, standard_value, assay_chembl_id, target_chembl_id FROM ({ACTIVITIES_SQL})
        WHERE target_chembl_id = 'T3' AND standard_type IN ('IC50', 'EC50', 'Ki', 'Kd') AND standard_value IS NOT NULL""",
)
def select_activities(spark, folder):
    return activity.select_activities(activities(spark, folder), "T3")


def _cap_sql(n: int) -> str:
    return f"""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')
        QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= {n}"""


def _capped(spark, folder, most):
    orders = read(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return activity.cap_per_type(orders, "o_orderkey", most, "o_orderpriority", ("1-URGENT", "2-HIGH", "5-LOW"))


@query("cap_per_type", _cap_sql(250))
def cap_per_type(spark, folder):
    return _capped(spark, folder, 1000)


@query("cap_per_type_large", _cap_sql(1500))
def cap_per_type_large(spark, folder):
    return _capped(spark, folder, 6000)


@query(
    "cap_per_type_ties",
    """SELECT o_orderpriority, k FROM (SELECT o_orderpriority, nullif(o_custkey % 50, 7) AS k FROM orders) WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')
        QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY k NULLS LAST) <= 1001""",
)
def cap_per_type_ties(spark, folder):
    """Ids that many rows share, some of them missing."""
    orders = read(spark, folder, "orders").selectExpr("o_orderpriority", "nullif(o_custkey % 50, 7) AS k")
    return activity.cap_per_type(orders, "k", 4004, "o_orderpriority", ("1-URGENT", "2-HIGH", "5-LOW"))


_NM = "value * CASE units WHEN 'nM' THEN 1.0e0 WHEN 'uM' THEN 1000.0e0 WHEN 'mM' THEN 1000000.0e0 END"


@query(
    "activity_values",
    f"""SELECT molecule_chembl_id, assay_chembl_id, units, round(nm, 4) AS value_nm, round(CASE WHEN nm > 0 THEN 9 - log10(nm) END, 6) AS potency,
        CASE WHEN nm <= 1000 THEN 'active' WHEN nm >= 10000 THEN 'inactive' WHEN nm IS NOT NULL THEN 'intermediate' END AS activity_class
        FROM (SELECT *, {_NM} AS nm FROM ({ACTIVITIES_SQL}))""",
)
def activity_values(spark, folder):
    out = activity.with_activity(activities(spark, folder))
    return rounded(out.select("molecule_chembl_id", "assay_chembl_id", "units", "value_nm", "potency", "activity_class"), value_nm=4, potency=6)


@query(
    "unit_summary",
    f"""SELECT units, count(*) AS row_count, count(nm) AS converted, count(*) FILTER (WHERE value IS NOT NULL AND nm IS NULL) AS unknown_unit
        FROM (SELECT *, {_NM} AS nm FROM ({ACTIVITIES_SQL})) GROUP BY units""",
)
def unit_summary(spark, folder):
    return activity.unit_summary(activities(spark, folder))


@query(
    "class_counts",
    f"""SELECT CASE WHEN nm <= 1000 THEN 'active' WHEN nm >= 10000 THEN 'inactive' WHEN nm IS NOT NULL THEN 'intermediate' ELSE 'none' END AS activity_class,
        count(*) AS row_count FROM (SELECT {_NM} AS nm FROM ({ACTIVITIES_SQL})) GROUP BY 1""",
)
def class_counts(spark, folder):
    out = activity.with_activity(activities(spark, folder))
    return out.groupBy(F.coalesce("activity_class", F.lit("none")).alias("activity_class")).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "targets_separate",
    f"SELECT molecule_chembl_id, target_chembl_id, round(avg(standard_value), 4) AS mean_value, count(standard_value) AS measurements FROM ({ACTIVITIES_SQL}) GROUP BY ALL",
)
def targets_separate(spark, folder):
    out = activity.multi_target(activities(spark, folder), "molecule_chembl_id", "target_chembl_id", "standard_value")
    return rounded(out, mean_value=4)


@query(
    "targets_average",
    f"SELECT molecule_chembl_id, round(avg(standard_value), 4) AS mean_value, count(standard_value) AS measurements FROM ({ACTIVITIES_SQL}) GROUP BY ALL",
)
def targets_average(spark, folder):
    out = activity.multi_target(activities(spark, folder), "molecule_chembl_id", "target_chembl_id", "standard_value", "average")
    return rounded(out, mean_value=4)


@query(
    "targets_as_columns",
    f"""SELECT molecule_chembl_id, {", ".join(f"round(avg(standard_value) FILTER (target_chembl_id = 'T{i}'), 4) AS T{i}" for i in range(10))}
        FROM ({ACTIVITIES_SQL}) GROUP BY molecule_chembl_id""",
)
def targets_as_columns(spark, folder):
    names = [f"T{i}" for i in range(10)]
    out = activity.multi_target(activities(spark, folder), "molecule_chembl_id", "target_chembl_id", "standard_value", "multi_task", names)
    return rounded(out, **{n: 4 for n in names})


@query(
    "targets_as_map",
    f"""SELECT molecule_chembl_id, string_agg(target_chembl_id || '=' || coalesce(CAST(CAST(round(m * 100) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY target_chembl_id) AS targets
        FROM (SELECT molecule_chembl_id, target_chembl_id, avg(standard_value) AS m FROM ({ACTIVITIES_SQL}) GROUP BY ALL) GROUP BY molecule_chembl_id""",
)
def targets_as_map(spark, folder):
    """All targets of a compound without naming them."""
    out = activity.multi_target(activities(spark, folder), "molecule_chembl_id", "target_chembl_id", "standard_value", "multi_task")
    cells = F.transform(F.map_entries("targets"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.round(e["value"] * 100).cast("bigint").cast("string"), F.lit("-"))))
    return out.select("molecule_chembl_id", F.array_join(cells, ",").alias("targets"))


_MANY = {f"NR-{i:02d}": f"CASE WHEN doc_id % {i + 2} > 0 THEN CAST(doc_id % {i + 3} = 1 AS INT) END" for i in range(12)}


@query(
    "assay_summary_many",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS assay, count(a) AS tested, count(*) FILTER (WHERE a = 1) AS active, count(*) FILTER (WHERE a = 0) AS inactive, round(100.0e0 * count(*) FILTER (WHERE a = 1) / count(a), 6) AS activity_rate,
            round(100.0e0 * count(a) / count(*), 6) AS coverage FROM (SELECT {e} AS a FROM labels)"""
        for n, e in _MANY.items()
    ),
)
def assay_summary_many(spark, folder):
    """Twelve assay columns."""
    wide = read(spark, folder, "labels").selectExpr("doc_id", *[f"{e} AS `{n}`" for n, e in _MANY.items()])
    return rounded(activity.assay_summary(wide), activity_rate=6, coverage=6)


@query(
    "assay_summary",
    """WITH l AS (SELECT CASE WHEN doc_id % 5 > 0 THEN quality END AS a, toxic AS b FROM labels)
        SELECT 'NR-quality' AS assay, count(a) AS tested, count(*) FILTER (WHERE a = 1) AS active, count(*) FILTER (WHERE a = 0) AS inactive, round(100.0e0 * count(*) FILTER (WHERE a = 1) / count(a), 6) AS activity_rate,
            round(100.0e0 * count(a) / count(*), 6) AS coverage FROM l
        UNION ALL SELECT 'SR-toxic', count(b), count(*) FILTER (WHERE b = 1), count(*) FILTER (WHERE b = 0), round(100.0e0 * count(*) FILTER (WHERE b = 1) / count(b), 6), round(100.0e0 * count(b) / count(*), 6) FROM l""",
)
def assay_summary(spark, folder):
    wide = read(spark, folder, "labels").selectExpr(
        "doc_id", "CASE WHEN doc_id % 5 > 0 THEN quality END AS `NR-quality`", "toxic AS `SR-toxic`", "CAST(NULL AS INT) AS `SR-untested`"
    )
    return rounded(activity.assay_summary(wide), activity_rate=6, coverage=6)


@query(
    "set_summary",
    f"""WITH a AS ({ACTIVITIES_SQL}) SELECT 'records' AS metric, count(*) AS value FROM a UNION ALL SELECT 'compounds', count(DISTINCT molecule_chembl_id) FROM a
        UNION ALL SELECT 'type:' || standard_type, count(*) FROM a GROUP BY standard_type""",
)
def set_summary(spark, folder):
    return activity.set_summary(activities(spark, folder), "molecule_chembl_id", "standard_type")
