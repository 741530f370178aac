"""Bioactivity tables: selection, units, potency, classes, assay summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Activity types, unit factors to nM, class limits in nM, columns kept.
ACTIVITY_TYPES = ("IC50", "EC50", "Ki", "Kd")
UNIT_TO_NM = {"nM": 1.0, "uM": 1e3, "mM": 1e6}
ACTIVE_MAX, INACTIVE_MIN = 1_000.0, 10_000.0
ACTIVITY_COLUMNS = (
    "molecule_chembl_id", "canonical_smiles", "standard_type", "standard_value", "standard_units",
    "pchembl_value", "assay_chembl_id", "target_chembl_id",
)


def select_activities(
    df: DataFrame,
    target_value,
    target: str = "target_chembl_id",
    type_column: str = "standard_type",
    value: str = "standard_value",
    types: tuple[str, ...] = ACTIVITY_TYPES,
    columns: tuple[str, ...] = ACTIVITY_COLUMNS,
) -> DataFrame:
    """Rows of one target with a wanted type and a value; the kept columns."""
    wanted = (F.col(target) == target_value) & F.col(type_column).isin(*types) & F.col(value).isNotNull()
    return df.filter(wanted).select(*[c for c in columns if c in df.columns])


def cap_per_type(
    df: DataFrame, row_id: str, max_records: int, type_column: str = "standard_type", types: tuple[str, ...] = ACTIVITY_TYPES
) -> DataFrame:
    """The first ``max_records // 4`` rows of every type, by row id, nulls last.

    ``row_number`` at any cap: Spark cuts every map task to the cap before the
    shuffle.  Of rows with one id at the cap some are kept, so that the number
    of rows is exact.
    """
    order = Window.partitionBy(type_column).orderBy(F.col(row_id).asc_nulls_last())
    rows = df.filter(F.col(type_column).isin(*types)).withColumn("_rn", F.row_number().over(order))
    return rows.filter(F.col("_rn") <= max_records // 4).drop("_rn")


def to_nanomolar(value: Column, unit: Column) -> Column:
    """Value in nM; an unknown unit gives null."""
    factor = F.lit(None).cast("double")
    for name, scale in UNIT_TO_NM.items():
        factor = F.when(unit == name, F.lit(scale)).otherwise(factor)
    return value.cast("double") * factor


def with_nanomolar(df: DataFrame, value: str = "value", unit: str = "units", name: str = "value_nm") -> DataFrame:
    return df.withColumn(name, to_nanomolar(F.col(value), F.col(unit)))


def unit_summary(df: DataFrame, value: str = "value", unit: str = "units") -> DataFrame:
    """Rows, converted rows and rows with an unknown unit, per unit."""
    made = to_nanomolar(F.col(value), F.col(unit))
    return df.groupBy(unit).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(made).alias("converted"),
        F.count_if(F.col(value).isNotNull() & made.isNull()).alias("unknown_unit"),
    )


def potency(nanomolar: Column) -> Column:
    """9 − log10 of a concentration in nM; null when not positive."""
    return F.when(nanomolar > 0, 9 - F.log10(nanomolar))


def activity_class(nanomolar: Column) -> Column:
    """active up to 1000 nM, inactive from 10000 nM, else intermediate."""
    return F.when(nanomolar <= ACTIVE_MAX, "active").when(nanomolar >= INACTIVE_MIN, "inactive").when(nanomolar.isNotNull(), "intermediate")


def with_activity(df: DataFrame, value: str = "value", unit: str = "units") -> DataFrame:
    """Add nM value, log potency and class."""
    return with_nanomolar(df, value, unit).withColumns(
        {"potency": potency(to_nanomolar(F.col(value), F.col(unit))), "activity_class": activity_class(to_nanomolar(F.col(value), F.col(unit)))}
    )


def multi_target(df: DataFrame, molecule: str, target: str, value: str, strategy: str = "separate", targets: list | None = None) -> DataFrame:
    """Several targets per molecule: a row per target, one average, or all side by side.

    ``multi_task`` gives a column per name in ``targets``; without names it
    gives one map column ``targets`` from target to mean, whatever their number.
    """
    if strategy == "separate":
        return df.groupBy(molecule, target).agg(F.avg(value).alias("mean_value"), F.count(value).alias("measurements"))
    if strategy == "average":
        return df.groupBy(molecule).agg(F.avg(value).alias("mean_value"), F.count(value).alias("measurements"))
    if strategy == "multi_task":
        if targets is None:
            means = df.filter(F.col(target).isNotNull()).groupBy(molecule, target).agg(F.avg(value).alias("_mean"))
            pairs = F.array_sort(F.collect_list(F.struct(F.col(target).alias("key"), F.col("_mean").alias("value"))))
            return means.groupBy(molecule).agg(F.map_from_entries(pairs).alias("targets"))
        # Known targets become plain conditional averages in a single pass.
        return df.groupBy(molecule).agg(*[F.avg(F.when(F.col(target) == t, F.col(value))).alias(str(t)) for t in targets])
    raise ValueError(f"unknown strategy: {strategy}")


def assay_summary(df: DataFrame, marks: tuple[str, ...] = ("NR-", "SR-"), first: int | None = None, top: int | None = None) -> DataFrame:
    """Per assay column: tested, active, inactive, rate and coverage in percent.

    One aggregate over the wide table, then one row per assay; the table is
    not multiplied by its assays.  Assays nobody tested are left out.
    """
    assays = [c for c in df.columns if any(m in c for m in marks)][:first]
    if not assays:
        return df.sparkSession.createDataFrame(
            [], "assay string, tested bigint, active bigint, inactive bigint, activity_rate double, coverage double"
        )
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(assays):
        col = F.col(f"`{c}`")
        aggregates += [F.count(col).alias(f"t{i}"), F.count_if(col == 1).alias(f"a{i}"), F.count_if(col == 0).alias(f"z{i}")]
    cells = [
        F.struct(
            F.lit(c).alias("assay"), F.col(f"t{i}").alias("tested"), F.col(f"a{i}").alias("active"), F.col(f"z{i}").alias("inactive"),
            (100.0 * F.col(f"a{i}") / F.nullif(F.col(f"t{i}"), F.lit(0))).alias("activity_rate"),
            (100.0 * F.col(f"t{i}") / F.nullif(F.col("n"), F.lit(0))).alias("coverage"),
        )
        for i, c in enumerate(assays)
    ]
    out = df.agg(*aggregates).select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter(F.col("tested") > 0)
    return out if top is None else out.orderBy(F.desc("coverage"), "assay").limit(top)


def set_summary(df: DataFrame, molecule: str, type_column: str, approximate: bool = False) -> DataFrame:
    """Rows, distinct compounds and rows per type: (metric, value)."""
    distinct = F.approx_count_distinct(molecule) if approximate else F.count_distinct(molecule)
    overall = df.agg(F.count(F.lit(1)).alias("records"), distinct.alias("compounds"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("records", "compounds")])
    per_type = df.groupBy(type_column).agg(F.count(F.lit(1)).alias("value"))
    return overall.select(F.explode(cells).alias("c")).select("c.*").unionAll(
        per_type.select(F.concat(F.lit("type:"), F.col(type_column)), "value")
    )
