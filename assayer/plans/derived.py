"""Compound, activity and event tables derived from the given tables.

The given tables hold no structures, so the checks build them from columns.
The expressions are plain SQL, equal in Spark and in the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


COMPOUND_COLUMNS = {
    "row_id": "p_partkey",
    "smiles": """CASE WHEN p_partkey % 13 = 5 THEN NULL WHEN p_partkey % 17 = 3 THEN ' '
        WHEN p_size % 8 = 0 THEN repeat('C', 1 + p_size % 5) || 'O'
        WHEN p_size % 8 = 1 THEN 'c1ccccc1' || repeat('C', p_size % 6)
        WHEN p_size % 8 = 2 THEN 'CC(=O)O.' || repeat('C', p_size % 12) || 'N'
        WHEN p_size % 8 = 3 THEN 'C1CC' || repeat('C', p_size % 4)
        WHEN p_size % 8 = 4 THEN 'C(' || repeat('C', p_size % 4)
        WHEN p_size % 8 = 5 THEN p_name
        WHEN p_size % 8 = 6 THEN '[Na+].[O-]' || repeat('C', 1 + CAST(p_partkey % 9 AS INT))
        ELSE 'CN1C=NC2=C1C(=O)N(C(=O)N2C)' || repeat('C', CAST(p_partkey % 3 AS INT)) || 'Cl' END""",
    "molecular_formula": """'C' || p_size || 'H' || (2 * p_size + 2) || CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'O' || (1 + p_size % 3)
        WHEN 2 THEN 'ClN' WHEN 3 THEN 'N2S+' WHEN 4 THEN 'Xx' ELSE 'Br2F-2' END""",
    "molecular_weight": "CAST(p_size AS DOUBLE) * 12.5e0 + 20",
    "logp": "CAST(p_partkey % 100 AS DOUBLE) / 10 - 4",
    "tpsa": "CASE WHEN p_partkey % 19 = 4 THEN NULL ELSE CAST(p_size % 37 AS DOUBLE) * 4.5e0 END",
    "num_hbd": "CAST(p_partkey % 8 AS INT)",
    "num_hba": "NULLIF(p_size % 14, 13)",
    "scaffold": "CASE WHEN p_partkey % 29 = 1 THEN NULL ELSE p_brand || '/' || p_type END",
    "target": "p_retailprice",
}

ACTIVITY_TABLE = {
    "molecule_chembl_id": "l_partkey",
    "assay_chembl_id": "l_orderkey",
    "target_chembl_id": "'T' || (l_suppkey % 10)",
    "standard_type": "CASE l_linenumber WHEN 1 THEN 'IC50' WHEN 2 THEN 'EC50' WHEN 3 THEN 'Ki' WHEN 4 THEN 'Kd' ELSE 'Potency' END",
    "standard_value": "NULLIF(l_quantity, 7) * 400",
    "units": "CASE WHEN l_returnflag = 'A' THEN 'nM' WHEN l_returnflag = 'N' THEN 'uM' WHEN l_linestatus = 'O' THEN 'mM' ELSE 'mg/L' END",
    "value": "l_quantity * l_discount * 100",
}

JOB_UPDATES = {
    "job_id": "user_id",
    "status": """CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'unknown'
        WHEN 'purchase' THEN 'completed' ELSE 'failed' END""",
    "done": "event_id % 50",
    "total": "event_id % 50 + event_id % 7",
    "ts": "ts",
    "event_id": "event_id",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _build(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def _select(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM {table}"


def compounds(spark: SparkSession, folder: str) -> DataFrame:
    return _build(read(spark, folder, "part"), COMPOUND_COLUMNS)


def activities(spark: SparkSession, folder: str) -> DataFrame:
    return _build(read(spark, folder, "lineitem"), ACTIVITY_TABLE)


def job_updates(spark: SparkSession, folder: str) -> DataFrame:
    return _build(read(spark, folder, "events"), JOB_UPDATES)


COMPOUNDS_SQL = _select(COMPOUND_COLUMNS, "part")
ACTIVITIES_SQL = _select(ACTIVITY_TABLE, "lineitem")
JOB_UPDATES_SQL = _select(JOB_UPDATES, "events")
