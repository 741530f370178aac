"""Readers for CSV, tab-delimited, SDF and Parquet molecule files."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Declared layout of an activity table.
ACTIVITY_SCHEMA = StructType(
    [StructField(n, StringType()) for n in ("assay_chembl_id", "canonical_smiles", "molecule_chembl_id")]
    + [StructField("pchembl_value", DoubleType())]
    + [StructField(n, StringType()) for n in ("standard_type", "standard_units")]
    + [StructField("standard_value", DoubleType())]
    + [StructField(n, StringType()) for n in ("target_chembl_id", "type", "units")]
    + [StructField("value", DoubleType())]
)

#: Declared layout of a compound table.
COMPOUND_SCHEMA = StructType(
    [
        StructField("cid", LongType()),
        StructField("canonical_smiles", StringType()),
        StructField("molecular_formula", StringType()),
        StructField("molecular_weight", DoubleType()),
        StructField("xlogp", DoubleType()),
        StructField("tpsa", DoubleType()),
        StructField("hbd", IntegerType()),
        StructField("hba", IntegerType()),
        StructField("rotatable_bonds", IntegerType()),
        StructField("heavy_atom_count", IntegerType()),
        StructField("complexity", DoubleType()),
    ]
)

FORMATS = (".csv", ".smi", ".txt", ".sdf", ".parquet")


def suffix_of(path: str) -> str:
    """Lower-case suffix; ``.csv.gz`` counts as ``.csv``."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    name = name.removesuffix(".gz")
    return "." + name.rsplit(".", 1)[1] if "." in name else ""


def require_column(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"column '{column}' not found; the table has {df.columns}")
    return df


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    key_column: str = "smiles",
    schema: StructType | None = None,
    max_records: int | None = None,
) -> DataFrame:
    """CSV with a header (gzip included).  Give a schema to avoid a typing pass."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = require_column(reader.csv(path), key_column)
    return df if max_records is None else df.limit(max_records)


def read_delimited(
    spark: SparkSession, path: str, key_column: str = "smiles", delimiter: str = "\t"
) -> DataFrame:
    """Tab-delimited molecules: ``.smi`` is (structure, id) without a header."""
    reader = spark.read.option("sep", delimiter)
    if suffix_of(path) == ".smi":
        return reader.schema(f"`{key_column}` string, id string").csv(path)
    return reader.option("header", True).option("inferSchema", True).csv(path)


# A property: its header line, then lines up to a blank one.
_PROPERTY = r"(?m)^>[^<\n]*<([^>\n]+)>[^\n]*\n((?:[^\n]+\n?)*+)"
# What is left of the separator's line.  A blank title at the start of a file
# looks the same, but then the counts line (V2000, V3000) comes two lines later.
_LINE_REST = r"\A\n(?!(?:[^\n]*\n){2}[^\n]*V[23]000)"


def read_sdf(spark: SparkSession, path: str, properties: list[str] | None = None) -> DataFrame:
    """One row per SDF record: title, molecule block, properties.

    Named ``properties`` become columns; without names all of them come as the
    map column ``props``, with no pass to find out which there are.  The
    structure block stays text.
    """
    text = (
        spark.read.option("lineSep", "$$$$").text(path)
        .select(F.regexp_replace(F.regexp_replace("value", r"\r", ""), _LINE_REST, "").alias("record"))
        .filter(F.col("record").rlike(r"\S"))
    )
    names = F.regexp_extract_all("record", F.lit(_PROPERTY), F.lit(1))
    values = F.transform(F.regexp_extract_all("record", F.lit(_PROPERTY), F.lit(2)), lambda v: F.rtrim(v, F.lit("\n")))
    # A name given twice keeps its first value, as map keys must be unique.
    first_seen = F.filter(
        F.arrays_zip(names.alias("n"), values.alias("v")),
        lambda item, at: F.array_position(names, item["n"]) == at + 1,
    )
    records = text.select(
        F.split("record", "\n")[0].alias("title"),
        F.regexp_extract("record", r"(?s)\A(.*?M  END)", 1).alias("molblock"),
        F.map_from_entries(first_seen).alias("props"),
    )
    if properties is None:
        return records
    taken = {"title", "molblock"}
    columns = [F.col("props")[p].alias(p if p not in taken else f"{p}_") for p in properties]
    return records.select("title", "molblock", *columns)


def read_table(spark: SparkSession, path: str, key_column: str = "smiles") -> DataFrame:
    """Read by suffix; an unknown suffix raises ``ValueError``."""
    suffix = suffix_of(path)
    if suffix == ".csv":
        return read_csv(spark, path, key_column)
    if suffix in (".smi", ".txt"):
        return read_delimited(spark, path, key_column)
    if suffix == ".sdf":
        return read_sdf(spark, path)
    if suffix == ".parquet":
        return require_column(spark.read.parquet(path), key_column)
    raise ValueError(f"unsupported file format: {suffix or path}")


@dataclass
class BatchLoad:
    """Several files as one table, and what happened to each of them."""

    data: DataFrame | None
    total_files: int = 0
    successful_loads: int = 0
    failed_loads: int = 0
    errors: list[str] = field(default_factory=list)

    def file_counts(self) -> DataFrame:
        """Records per source file."""
        return self.data.groupBy("source_file").agg(F.count(F.lit(1)).alias("records"))


def read_many(spark: SparkSession, paths: Iterable[str], key_column: str = "smiles") -> BatchLoad:
    """Union by column name of all files that can be read.

    Only headers are touched here; the rows are scanned once, when the result
    is used.  Files with the same layout are read together, so the plan grows
    with the number of layouts and not with the number of files.
    """
    result = BatchLoad(None)
    layouts: dict[tuple, list[tuple[str, DataFrame]]] = {}
    for path in paths:
        result.total_files += 1
        try:
            df = read_table(spark, path, key_column)
            layouts.setdefault((suffix_of(path), tuple(df.dtypes)), []).append((path, df))
            result.successful_loads += 1
        except (ValueError, PySparkException) as problem:
            result.failed_loads += 1
            result.errors.append(f"{path}: {str(problem).splitlines()[0]}")
    for (suffix, _), members in layouts.items():
        if suffix in (".csv", ".parquet") and len(members) > 1:
            files = [path for path, _ in members]
            reader = spark.read.schema(members[0][1].schema)
            parts = [reader.parquet(*files) if suffix == ".parquet" else reader.option("header", True).option("escape", '"').csv(files)]
        else:
            parts = [df for _, df in members]
        for part in parts:
            # _metadata is only offered by the file scan itself; elsewhere the
            # running file name serves.
            part = part.withColumn("source_file", F.input_file_name())
            result.data = part if result.data is None else result.data.unionByName(part, allowMissingColumns=True)
    return result


def union_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Union by name with missing columns as null; ``source_file`` names the table."""
    out = None
    for name, df in tables.items():
        part = df.withColumn("source_file", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def file_info(spark: SparkSession, path: str, sample: int = 5) -> DataFrame:
    """Path, name, size, format, supported flag, columns and sample size of files.

    Sizes come from the file listing; no content is read for them.
    """
    listing = spark.read.format("binaryFile").load(path).select("path", "length")
    suffix = suffix_of(path)
    columns, records = None, None
    if suffix in (".csv", ".parquet"):
        head = spark.read.option("header", True).csv(path) if suffix == ".csv" else spark.read.parquet(path)
        columns, records = head.columns, len(head.take(sample))
    names = F.array(*[F.lit(c) for c in columns]) if columns else F.lit(None).cast("array<string>")
    return listing.select(
        F.col("path").alias("file_path"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("file_size"),
        F.lit(suffix).alias("file_format"),
        F.lit(suffix in FORMATS).alias("supported"),
        names.alias("columns"),
        F.lit(records).cast("int").alias("sample_records"),
    )
