"""Quality profile of a table: long metric tables, a score and a text report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.molecules import reject_reason
from .dedup import duplicate_counts
from .features import numeric_columns
from .ordering import order_statistics

# Thresholds of the profile.
MISSING_REMOVE, MISSING_HIGH = 50, 20
IQR_REACH, Z_LIMIT = 1.5, 3.0


def _number(df: DataFrame, column: str) -> Column:
    """The column as double, with NaN as null."""
    value = F.col(column).cast("double")
    if isinstance(df.schema[column].dataType, (DoubleType, FloatType)):
        return F.nanvl(value, F.lit(None).cast("double"))
    return value


def _missing(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, (DoubleType, FloatType)):
        return F.col(column).isNull() | F.isnan(column)
    return F.col(column).isNull()


def _unpack(wide: DataFrame, cells: list[Column]) -> DataFrame:
    """One-row wide aggregate to one row per cell."""
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column, all columns in one aggregate."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    )
    share = lambda i: F.coalesce(100.0 * F.col(f"m{i}") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    return _unpack(
        wide,
        [
            F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"), share(i).alias("missing_pct"))
            for i, c in enumerate(df.columns)
        ],
    )


def column_types(df: DataFrame) -> DataFrame:
    """Column names and types as a table; schema only."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, data_type string")


def validity_rate(df: DataFrame, key: str) -> DataFrame:
    """Total, valid and invalid non-null keys, and the rate in percent."""
    counts = df.filter(F.col(key).isNotNull()).agg(
        F.count(F.lit(1)).alias("total_keys"), F.count_if(reject_reason(F.col(key)).isNull()).alias("valid_keys")
    )
    return counts.select(
        "total_keys",
        "valid_keys",
        (F.col("total_keys") - F.col("valid_keys")).alias("invalid_keys"),
        F.coalesce(100.0 * F.col("valid_keys") / F.nullif(F.col("total_keys"), F.lit(0)), F.lit(0.0)).alias("validity_rate"),
    )


def invalid_examples(df: DataFrame, key: str, row_id: str, limit: int = 5) -> DataFrame:
    """The first few invalid non-null keys by row id."""
    bad = df.filter(F.col(key).isNotNull() & reject_reason(F.col(key)).isNotNull())
    return bad.select(row_id, key).orderBy(row_id).limit(limit)


def quartiles(df: DataFrame, columns: list[str], approximate: bool = False) -> dict[str, tuple[float, float]]:
    """Quartiles with linear interpolation, all columns in shared passes.

    Exact by default, through ``order_statistics``: no column's values are
    gathered in one place.  ``approximate`` takes one sketch pass.
    """
    if approximate:
        row = df.agg(*[F.percentile_approx(_number(df, c), [0.25, 0.75], 10_000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        return {c: tuple(q) for c, q in zip(columns, row) if q is not None}
    counted = df.agg(*[F.count(_number(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    present = {c: n for c, n in zip(columns, counted) if n > 0}
    spots = {c: [(n - 1) * q for q in (0.25, 0.75)] for c, n in present.items()}
    ranks = {}
    for c, at in spots.items():
        around = {r for s in at for r in (int(s), min(int(s) + 1, present[c] - 1))}
        ranks[c] = (_number(df, c), sorted(around))
    values = order_statistics(df, ranks, present) if ranks else {}
    out = {}
    for c, at in spots.items():
        last = present[c] - 1
        ends = []
        for s in at:
            low, high = values[(c, int(s))], values[(c, min(int(s) + 1, last))]
            ends.append(low + (high - low) * (s - int(s)))
        out[c] = (ends[0], ends[1])
    return out


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Bounds, count and percentage of values outside the quartiles ± 1.5 IQR."""
    names = columns or numeric_columns(df)
    found = quartiles(df, names, approximate)
    limits = {c: (a - IQR_REACH * (b - a), b + IQR_REACH * (b - a)) for c, (a, b) in found.items()}
    if not limits:
        return df.sparkSession.createDataFrame([], "column_name string, lower_bound double, upper_bound double, outlier_count bigint, outlier_pct double")
    aggregates = []
    for i, (c, (low, high)) in enumerate(limits.items()):
        value = _number(df, c)
        aggregates += [F.count(value).alias(f"n{i}"), F.count_if((value < low) | (value > high)).alias(f"o{i}")]
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(float(low)).alias("lower_bound"), F.lit(float(high)).alias("upper_bound"),
            F.col(f"o{i}").alias("outlier_count"), (100.0 * F.col(f"o{i}") / F.col(f"n{i}")).alias("outlier_pct"),
        )
        for i, (c, (low, high)) in enumerate(limits.items())
    ]
    return _unpack(df.agg(*aggregates), cells)


def zscore_outliers(df: DataFrame, columns: list[str] | None = None, limit: float = Z_LIMIT) -> DataFrame:
    """Mean, population std and the count of values more than ``limit`` std away."""
    names = columns or numeric_columns(df)
    stats = df.agg(
        F.struct(*[x for i, c in enumerate(names) for x in (F.avg(_number(df, c)).alias(f"m{i}"), F.stddev_pop(_number(df, c)).alias(f"s{i}"))]).alias("s")
    ).scalar()
    aggregates = []
    for i, c in enumerate(names):
        z = F.abs(_number(df, c) - stats[f"m{i}"]) / F.nullif(stats[f"s{i}"], F.lit(0.0))
        aggregates += [F.count(_number(df, c)).alias(f"n{i}"), F.count_if(z > limit).alias(f"o{i}")]
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), stats[f"m{i}"].alias("mean"), stats[f"s{i}"].alias("std"),
            F.col(f"o{i}").alias("outlier_count"),
            F.coalesce(100.0 * F.col(f"o{i}") / F.nullif(F.col(f"n{i}"), F.lit(0)), F.lit(0.0)).alias("outlier_pct"),
        )
        for i, c in enumerate(names)
    ]
    return _unpack(df.agg(*aggregates), cells)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.orderBy(F.desc("row_count"), column)


def _facts(df: DataFrame, key: str, duplicates: bool = True) -> DataFrame:
    """The profile's counts as (section, column_name, metric, value) rows."""

    def rows(table: DataFrame, section: str, name: Column, metrics: list[str]) -> DataFrame:
        cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        return table.select(F.lit(section).alias("section"), name.alias("column_name"), F.explode(F.array(*cells)).alias("c")).select(
            "section", "column_name", "c.metric", "c.value"
        )

    nothing = F.lit(None).cast("string")
    parts = [
        rows(df.agg(F.count(F.lit(1)).alias("records")).withColumn("columns", F.lit(len(df.columns))), "dataset", nothing, ["records", "columns"]),
        rows(missing_values(df), "missing", F.col("column_name"), ["missing_count", "missing_pct"]),
    ]
    if key in df.columns:
        parts.append(rows(validity_rate(df, key), "keys", F.lit(key), ["total_keys", "valid_keys", "invalid_keys", "validity_rate"]))
    if key in df.columns and duplicates:
        parts.append(rows(duplicate_counts(df, key), "duplicates", F.lit(key), ["duplicate_rows", "duplicate_keys"]))
    return reduce(DataFrame.unionAll, parts)


def quality_score(df: DataFrame, key: str) -> DataFrame:
    """max(0, 100 − 0.5 · mean missing % − 0.3 · (100 − validity %))."""
    return score_of(_facts(df, key, duplicates=False))


def score_of(facts: DataFrame) -> DataFrame:
    scored = facts.agg(
        F.avg(F.when(F.col("metric") == "missing_pct", F.col("value"))).alias("avg_missing_pct"),
        F.max(F.when(F.col("metric") == "validity_rate", F.col("value"))).alias("validity_rate"),
    )
    lost = 0.5 * F.coalesce("avg_missing_pct", F.lit(0.0)) + 0.3 * (100 - F.coalesce("validity_rate", F.lit(100.0)))
    return scored.withColumn("quality_score", F.greatest(F.lit(0.0), 100 - lost))


def recommendations(df: DataFrame, key: str) -> DataFrame:
    """What to do about the table, in order: (position, recommendation)."""
    return advice_from(_facts(df, key), df.columns)


def advice_from(facts: DataFrame, columns: list[str]) -> DataFrame:
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column_name")), F.lit(0))
    value, metric = F.col("value"), F.col("metric")
    is_missing = metric == "missing_pct"
    text = (
        F.when(is_missing & (value > MISSING_REMOVE), F.format_string("Consider removing column '%s' (>%.1f%% missing)", "column_name", "value"))
        .when(is_missing & (value > MISSING_HIGH), F.format_string("High missing data in '%s' (%.1f%%)", "column_name", "value"))
        .when((metric == "invalid_keys") & (value > 0), F.format_string("Remove %d invalid SMILES", value.cast("bigint")))
        .when((metric == "duplicate_keys") & (value > 0), F.format_string("Remove %d duplicate SMILES", value.cast("bigint")))
    )
    position = F.when(metric == "invalid_keys", 1_000_000).when(metric == "duplicate_keys", 1_000_001).otherwise(place)
    return facts.select(position.cast("bigint").alias("position"), text.alias("recommendation")).filter(F.col("recommendation").isNotNull())


def profile(df: DataFrame, key: str = "smiles", outliers: bool = True) -> DataFrame:
    """The whole profile as one long table (section, column_name, metric, value).

    Size depends on the number of columns only.
    """
    facts = _facts(df, key)
    nothing = F.lit(None).cast("string")
    parts = [facts, score_of(facts).select(F.lit("score"), nothing, F.lit("quality_score"), "quality_score")]
    names = [c for c in numeric_columns(df)]
    if outliers and names:
        found = iqr_outliers(df, names)
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("lower_bound", "upper_bound", "outlier_count", "outlier_pct")])
        parts.append(found.select(F.lit("outliers"), "column_name", F.explode(cells).alias("c")).select(F.col("outliers"), "column_name", "c.metric", "c.value"))
    return reduce(DataFrame.unionAll, parts)


def report(df: DataFrame, key: str = "smiles") -> str:
    """The profile as text: a block per section, a line per column or measure."""
    facts = _facts(df, key).collect()  # a few rows per column
    small = df.sparkSession.createDataFrame(facts, "section string, column_name string, metric string, value double")
    lines = [f"quality score {score_of(small).first()['quality_score']:.1f} of 100"]
    lines += [f"Total records: {int(r['value'])}" for r in facts if r["metric"] == "records"]  # fixed text
    shown = None
    for r in facts:
        if r["section"] != shown:
            shown = r["section"]
            lines.append(f"[{shown}]")
        name = f"{r['column_name']}." if r["column_name"] else ""
        lines.append(f"  {name}{r['metric']} = {r['value']:,.10g}" if r["value"] is not None else f"  {name}{r['metric']} = none")
    lines.append("[types]")
    lines += [f"  {c} = {t}" for c, t in df.dtypes]
    advice = advice_from(small, df.columns).orderBy("position").collect()
    return "\n".join(lines + ["[advice]"] * bool(advice) + [f"  {a['recommendation']}" for a in advice])
