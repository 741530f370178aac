"""Checked queries: sources and sinks, validation, de-duplication."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import molecules
from ..operators import dedup, validate
from ..session import shared_folder
from ..sources import readers, sinks
from .derived import COMPOUNDS_SQL, compounds, read
from .registry import REGISTRY, rounded

query = REGISTRY.add


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks --------------------------------------------------------


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, folder):
    table = read(spark, folder, "customer")
    path = sinks.write_table(table, scratch(spark, "customers") + ".csv")
    return readers.read_csv(spark, path, "c_name", schema=table.schema)


@query("gzip_csv_scan", "SELECT count(*) AS row_count, CAST(sum(p_size) AS BIGINT) AS size_sum FROM part")
def gzip_csv_scan(spark, folder):
    path = scratch(spark, "parts") + ".csv"
    table = read(spark, folder, "part").select("p_name", "p_size")
    table.write.option("header", True).option("compression", "gzip").csv(path)
    back = readers.read_csv(spark, path, "p_name", schema=table.schema)
    return back.agg(F.count(F.lit(1)).alias("row_count"), F.sum("p_size").alias("size_sum"))


@query(
    "smi_scan",
    f"SELECT smiles, row_id || '' AS id FROM ({COMPOUNDS_SQL}) WHERE smiles IS NOT NULL AND trim(smiles) <> ''",
)
def smi_scan(spark, folder):
    path = scratch(spark, "compounds") + ".smi"
    rows = compounds(spark, folder).filter(F.trim("smiles") != "")
    rows.select("smiles", F.col("row_id").cast("string").alias("id")).write.option("sep", "\t").csv(path)
    return readers.read_delimited(spark, path)


@query(
    "sdf_scan",
    f"SELECT 'compound-' || row_id AS title, molecular_formula AS \"FORMULA\", row_id || '' AS \"ID\", num_hbd || '' AS \"HBD\" FROM ({COMPOUNDS_SQL})",
)
def sdf_scan(spark, folder):
    """Writes every compound as an SDF record, then reads the files back."""
    path = scratch(spark, "records") + ".sdf"
    record = F.format_string(
        "compound-%d\n  made\n\n  0  0  0  0  0  0  0  0  0  0999 V2000\nM  END\n> <FORMULA>\n%s\n\n> <ID>\n%d\n\n>  <HBD>  (1)\n%d\n\n",
        "row_id", "molecular_formula", "row_id", "num_hbd",
    )
    compounds(spark, folder).select(record.alias("value")).write.option("lineSep", "$$$$\n").text(path)
    return readers.read_sdf(spark, path, ["FORMULA", "ID", "HBD"]).drop("molblock")


@query(
    "sdf_properties",
    f"SELECT 'compound-' || row_id AS title, 'FORMULA=' || molecular_formula || ',HBD=' || num_hbd || ',ID=' || row_id AS props FROM ({COMPOUNDS_SQL})",
)
def sdf_properties(spark, folder):
    """The same records, with all properties and no names given."""
    path = scratch(spark, "records") + ".sdf"
    record = F.format_string("compound-%d\n  made\n\n  0  0  0  0  0  0  0  0  0  0999 V2000\nM  END\n> <FORMULA>\n%s\n\n> <ID>\n%d\n\n>  <HBD>  (1)\n%d\n\n", "row_id", "molecular_formula", "row_id", "num_hbd")
    compounds(spark, folder).select(record.alias("value")).write.option("lineSep", "$$$$\n").text(path)
    cells = F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return readers.read_sdf(spark, path).select("title", F.array_join(cells, ",").alias("props"))


@query(
    "union_files",
    """SELECT source_file, count(*) AS records, round(sum(balance), 2) AS balance, count(segment) AS segments FROM (
        SELECT 'customer' AS source_file, c_acctbal AS balance, c_mktsegment AS segment FROM customer
        UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier) GROUP BY source_file""",
)
def union_files(spark, folder):
    both = readers.union_tables(
        {
            "customer": read(spark, folder, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
            "supplier": read(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance")),
        }
    )
    out = both.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("records"), F.sum("balance").alias("balance"), F.count("segment").alias("segments")
    )
    return rounded(out, balance=2)


@query(
    "batch_load",
    """SELECT CAST(2 AS INT) AS successful_loads, CAST(1 AS INT) AS failed_loads, count(*) AS total_records,
        count(c_name) AS customer_rows, count(s_name) AS supplier_rows FROM (
        SELECT c_custkey AS k, c_name, NULL AS s_name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier)""",
)
def batch_load(spark, folder):
    """Two files of different layout and one that is missing."""
    paths = [f"{folder}/customer.parquet", f"{folder}/missing.parquet"]
    suppliers = scratch(spark, "suppliers") + ".csv"
    sinks.write_table(read(spark, folder, "supplier").withColumnRenamed("s_suppkey", "c_custkey"), suppliers)
    loaded = readers.read_many(spark, [*paths, suppliers], key_column="c_custkey")
    return loaded.data.agg(
        F.lit(loaded.successful_loads).alias("successful_loads"),
        F.lit(loaded.failed_loads).alias("failed_loads"),
        F.count(F.lit(1)).alias("total_records"),
        F.count("c_name").alias("customer_rows"),
        F.count("s_name").alias("supplier_rows"),
    )


@query("split_sink", "SELECT o_orderstatus AS status, count(*) AS row_count FROM orders GROUP BY o_orderstatus")
def split_sink(spark, folder):
    """Writes by split in one pass and reads each part back with pruning."""
    names = {"train": "F", "val": "O", "test": "P"}
    table = read(spark, folder, "orders")
    label = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    paths = sinks.write_splits(table.withColumn("split", label), scratch(spark, "parts"), prefix="run_")
    parts = readers.union_tables({names[p]: spark.read.parquet(path) for p, path in paths.items()})
    return parts.groupBy(F.col("source_file").alias("status")).agg(F.count(F.lit(1)).alias("row_count"))


# --- validation and cleaning ----------------------------------------------------

REASON_SQL = rf"""CASE WHEN smiles IS NULL OR trim(smiles) = '' THEN 'empty'
    WHEN NOT regexp_full_match(trim(smiles), '({molecules.TOKEN})+') THEN 'token'
    WHEN NOT regexp_matches(smiles, '[A-Za-z*]') THEN 'no_atom'
    WHEN len(replace(smiles, '(', '')) <> len(replace(smiles, ')', '')) THEN 'parentheses'
    WHEN NOT contains(smiles, '%') AND list_bool_or([len(regexp_extract_all(regexp_replace(smiles, '\[[^\[\]]+\]', '', 'g'), d || '')) % 2 = 1
        for d in range(0, 10)]) THEN 'ring' END"""

VALID_SQL = f"SELECT *, {REASON_SQL} AS reject_reason FROM ({COMPOUNDS_SQL})"


@query(
    "validate_structures",
    f"""SELECT row_id, reject_reason IS NULL AS valid, CASE WHEN reject_reason IS NULL THEN trim(smiles) END AS canonical_smiles,
        reject_reason FROM ({VALID_SQL})""",
)
def validate_structures(spark, folder):
    rows = compounds(spark, folder).select("row_id", "smiles")
    return validate.validate_structures(rows).drop("smiles")


@query("validate_texts", f"SELECT doc_id, {REASON_SQL} AS reject_reason FROM (SELECT doc_id, text AS smiles FROM documents)")
def validate_texts(spark, folder):
    """The same rule on whole running texts: none is a structure."""
    return validate.validate_structures(read(spark, folder, "documents"), "text").select("doc_id", "reject_reason")


@query("request_characters", r"SELECT p_partkey, p_size || p_name AS code, regexp_full_match(p_size || p_name, '[A-Za-z0-9()\[\]{}=\-#@+.:]+') AS allowed FROM part")
def request_characters(spark, folder):
    code = F.concat(F.col("p_size").cast("string"), F.col("p_name"))
    return read(spark, folder, "part").select("p_partkey", code.alias("code"), molecules.allowed_characters(code).alias("allowed"))


@query(
    "validity_summary",
    f"SELECT count(*) AS total, count(*) FILTER (WHERE reject_reason IS NULL) AS valid_rows, count(*) FILTER (WHERE reject_reason IS NOT NULL) AS invalid_rows FROM ({VALID_SQL})",
)
def validity_summary(spark, folder):
    return validate.validity_counts(validate.validate_structures(compounds(spark, folder)))


@query(
    "clean_texts",
    "SELECT doc_id, source, n_chars, md5(text) AS text_md5 FROM documents WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def clean_texts(spark, folder):
    cleaned = validate.clean_keys(read(spark, folder, "documents"), "text", "doc_id")
    return cleaned.select("doc_id", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(
    "clean_text_counts",
    """SELECT count(*) AS total, count(*) FILTER (WHERE k IS NULL) AS blank_removed, count(k) - count(DISTINCT k) AS duplicates_removed FROM (
        SELECT CASE WHEN trim(smiles) <> '' THEN smiles END AS k FROM (""" + COMPOUNDS_SQL + "))",
)
def clean_text_counts(spark, folder):
    return validate.clean_key_counts(compounds(spark, folder), "smiles")


@query("normalise_list", "SELECT min(p_partkey) AS position, trim(v) AS value FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' ' ELSE p_name END AS v FROM part) GROUP BY v")
def normalise_list(spark, folder):
    padded = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" "))).otherwise(F.col("p_name"))
    return validate.normalise_list(read(spark, folder, "part").withColumn("v", padded), "v", "p_partkey")


@query("normalise_list_trim_first", "SELECT min(p_partkey) AS position, trim(v) AS value FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' ' ELSE p_name END AS v FROM part) GROUP BY trim(v)")
def normalise_list_trim_first(spark, folder):
    padded = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" "))).otherwise(F.col("p_name"))
    return validate.normalise_list(read(spark, folder, "part").withColumn("v", padded), "v", "p_partkey", trim_first=True)


@query(
    "split_lines",
    """SELECT doc_id, count(*) AS line_count, CAST(sum(len(line)) AS BIGINT) AS line_chars FROM (
        SELECT doc_id, trim(replace(unnest(string_split(text, chr(10))), chr(13), '')) AS line FROM documents) WHERE line <> '' GROUP BY doc_id""",
)
def split_lines(spark, folder):
    lines = validate.split_lines(read(spark, folder, "documents"), "text", "doc_id")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("line_count"), F.sum(F.length("line")).alias("line_chars"))


@query(
    "standardise_structures",
    f"""SELECT row_id, CASE WHEN reject_reason IS NULL THEN (SELECT f FROM (SELECT unnest(string_split(trim(smiles), '.')) AS f,
            generate_subscripts(string_split(trim(smiles), '.'), 1) AS i) ORDER BY len(f) DESC, i LIMIT 1) ELSE smiles END AS standardized_smiles
        FROM ({VALID_SQL})""",
)
def standardise_structures(spark, folder):
    rows = compounds(spark, folder).select("row_id", "smiles")
    return validate.standardise_structures(rows).drop("smiles")


@query(
    "retention",
    """SELECT count(*) AS original_count, count(*) FILTER (WHERE l_quantity >= 10) AS processed_count, count(*) FILTER (WHERE l_quantity < 10) AS removed_count,
        round(100.0e0 * count(*) FILTER (WHERE l_quantity >= 10) / count(*), 6) AS retention_rate, 'price' AS new_columns,
        'l_comment_date' AS removed_columns FROM lineitem""",
)
def retention(spark, folder):
    before = read(spark, folder, "lineitem").withColumnRenamed("l_shipdate", "l_comment_date")
    after = before.filter("l_quantity >= 10").withColumn("price", F.col("l_extendedprice")).drop("l_comment_date")
    return rounded(validate.retention(before, after), retention_rate=6)


@query(
    "coerced_mean",
    """SELECT round(avg(TRY_CAST(v AS DOUBLE)), 9) AS v_mean, count(*) FILTER (WHERE v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL) AS v_bad
        FROM (SELECT CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_size || '.5' END AS v FROM part)""",
)
def coerced_mean(spark, folder):
    mixed = read(spark, folder, "part").selectExpr("CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_size || '.5' END AS v")
    return rounded(validate.coerced_mean(mixed, ["v"]), v_mean=9)


# --- de-duplication ---------------------------------------------------------------


def _kept_sql(order: str) -> str:
    return f"SELECT doc_id, source, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY {order}) = 1"


for _method, _order in {
    "first": "doc_id",
    "last": "doc_id DESC",
    "random": "CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT), doc_id",
}.items():

    @query(f"dedup_keep_{_method}", _kept_sql(_order))
    def dedup_keep(spark, folder, method=_method):
        return dedup.keep_one(read(spark, folder, "documents"), "text", "doc_id", method).drop("text")


@query(
    "dedup_null_keys",
    f"""SELECT row_id, smiles FROM (SELECT row_id, CASE WHEN trim(smiles) <> '' THEN smiles END AS smiles FROM ({COMPOUNDS_SQL}))
        QUALIFY smiles IS NULL OR row_number() OVER (PARTITION BY smiles ORDER BY row_id) = 1""",
)
def dedup_null_keys(spark, folder):
    rows = compounds(spark, folder).select("row_id", F.when(F.trim("smiles") != "", F.col("smiles")).alias("smiles"))
    return dedup.keep_one(rows, "smiles", "row_id", null_keys="keep")


@query(
    "duplicate_counts",
    """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicate_rows,
        count(*) - count(DISTINCT text) AS duplicate_keys FROM documents""",
)
def duplicate_counts(spark, folder):
    return dedup.duplicate_counts(read(spark, folder, "documents").drop("doc_id"), "text")


@query(
    "feature_table_unseen",
    """SELECT sha256('value:' || text) AS content_key, CAST(min(length(text)) AS INT) AS text_length FROM documents WHERE lang <> 'en'
        AND text NOT IN (SELECT text FROM documents WHERE lang = 'en') GROUP BY text""",
)
def feature_table_unseen(spark, folder):
    """Content of the other languages not already among the English texts."""
    keyed = dedup.with_content_key(read(spark, folder, "documents"), ["text"])
    known = keyed.filter("lang = 'en'").select("content_key")
    new = dedup.unseen(keyed.filter("lang <> 'en'"), known)
    return new.select("content_key", F.length("text").alias("text_length"))


@query("feature_table_refresh", "SELECT doc_id, source, CAST(length(text) AS INT) AS n_tokens, CAST(20 + 20 * (length(text) - length(replace(text, 'O', ''))) + 12 * (length(text) - length(replace(text, 'N', ''))) AS INT) AS token_weight FROM documents")
def feature_table_refresh(spark, folder):
    """Features of English texts are stored first, then those of the rest added."""
    from ..operators.features import with_token_counts

    def compute(df):
        return with_token_counts(df, "text").select("content_key", "text", "n_tokens", "token_weight")

    documents = read(spark, folder, "documents")
    table = scratch(spark, "features")
    dedup.refresh_features(documents.filter("lang = 'en'"), ["text"], table, compute)
    return dedup.refresh_features(documents, ["text"], table, compute).select("doc_id", "source", "n_tokens", "token_weight")


@query(
    "feature_table_null_content",
    """SELECT doc_id, CAST(coalesce(length(t), -1) AS INT) AS text_length FROM (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN text END AS t FROM documents)""",
)
def feature_table_null_content(spark, folder):
    """A third of the rows has no text and shares one feature row."""
    documents = read(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("text")).alias("t"))

    def compute(df):
        return df.select("content_key", "t", F.coalesce(F.length("t"), F.lit(-1)).alias("text_length"))

    return dedup.refresh_features(documents, ["t"], scratch(spark, "features"), compute).select("doc_id", "text_length")
