"""Feature columns, standardisation, importance, correlation and histograms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DataType, NumericType

from ..functions import molecules
from ..functions.hashing import hash32

# Which columns count as descriptors.
DESCRIPTOR_PREFIXES = ("molecular_", "logp", "tpsa", "num_", "molar_", "balaban_", "bertz_")

_PRIME = 2_147_483_647
_STEP = 1_000_003

#: Words of running text, for tables whose strings are prose.
WORDS = r"[^ \n\r\t]+"


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]


def with_formula_features(df: DataFrame, formula: str = "molecular_formula") -> DataFrame:
    """Molecular weight and heavy-atom count; null for formulas with unknown parts."""
    return df.withColumns(
        {
            "formula_weight": molecules.formula_mass(F.col(formula)),
            "formula_heavy_atoms": molecules.formula_heavy_atoms(F.col(formula)),
        }
    )


def with_token_counts(df: DataFrame, column: str, symbols: tuple[str, ...] = ("C", "N", "O")) -> DataFrame:
    """Length, count of each symbol, and the weighted sum."""
    text = F.coalesce(F.col(column), F.lit(""))
    counts = {f"count_{s}": molecules.symbol_count(text, s) for s in symbols}
    return df.withColumns({"n_tokens": F.length(text), **counts, "token_weight": molecules.counted_weight(text)})


def with_fingerprint(
    df: DataFrame,
    column: str,
    name: str = "fingerprint",
    n_bits: int | None = 2048,
    radius: int = 2,
    tokens: str = molecules.TOKEN,
) -> DataFrame:
    """Add the sorted distinct bit positions of the token n-grams of a string.

    n runs from 1 to ``radius + 1``.  Each token is hashed once; n-gram values
    follow by arithmetic.  ``n_bits=None`` keeps the unfolded 31-bit values,
    for long texts that would fill a fixed width.  Always the whole string.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    hashed = F.transform(F.regexp_extract_all(text, F.lit(tokens), F.lit(0)), lambda t: hash32(t) % _PRIME)
    # Each level is its own column, used more than once, so Spark computes it once.
    out = df.withColumn("_g1", hashed)
    for n in range(2, radius + 2):
        longer = F.zip_with(
            F.col(f"_g{n - 1}"),
            F.slice("_g1", n, F.greatest(F.size("_g1"), F.lit(1))),
            lambda head, last: (head * _STEP + last + 1) % _PRIME,
        )
        out = out.withColumn(f"_g{n}", F.array_compact(longer))
    grams = F.concat(*[F.col(f"_g{n}") for n in range(1, radius + 2)])
    if n_bits is not None:
        grams = F.transform(grams, lambda g: (g % n_bits).cast("int"))
    return out.withColumn(name, F.sort_array(F.array_distinct(grams))).drop(*[f"_g{n}" for n in range(1, radius + 2)])


def bit_string(bits: Column, n_bits: int) -> Column:
    """The fingerprint as a string of 0 and 1."""
    return F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda i: F.array_contains(bits, i).cast("int").cast("string")), ""
    )


def python_descriptor(function: Callable[[str], object], kind: DataType | str = "double") -> Callable[[Column], Column]:
    """Wrap a Python function of one value; a failing call gives null for that cell.

    Values arrive in Arrow batches.  Prefer a Column expression where one exists.
    """

    def guarded(value):
        try:
            return function(value)
        except Exception:
            return None

    @F.pandas_udf(kind)
    def batch(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else guarded(v) for v in values], index=values.index)

    return batch


def with_descriptors(df: DataFrame, column: str, descriptors: list[tuple[str, object]]) -> DataFrame:
    """Add named descriptors: each a Column, or a callable from Column to Column."""
    made = {name: d if isinstance(d, Column) else d(F.col(column)) for name, d in descriptors}
    return df.withColumns(made)


def standardise(df: DataFrame, columns: list[str], suffix: str = "_std") -> DataFrame:
    """Nulls become 0, then (x - mean) / population std; constant columns become 0.

    The means come from one aggregate, used as a scalar subquery: lazy, no join.
    """
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    stats = df.agg(
        F.struct(*[x for c in columns for x in (F.avg(filled[c]).alias(f"m_{c}"), F.stddev_pop(filled[c]).alias(f"s_{c}"))]).alias("stats")
    ).scalar()
    scaled = {
        c + suffix: F.coalesce((filled[c] - stats[f"m_{c}"]) / F.nullif(stats[f"s_{c}"], F.lit(0.0)), F.lit(0.0))
        for c in columns
    }
    return df.withColumns(scaled)


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1, the last one closed; one bin if all are equal."""
    width = F.nullif(high - low, F.lit(0.0))
    return F.coalesce(F.least(F.lit(bins - 1), F.floor((value - low) / width * bins)), F.when(value.isNotNull(), 0)).cast("int")


def feature_importance(df: DataFrame, target: str, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each descriptor with the target, best first.

    Both sides are cut into equal-width bins; null descriptors count as 0 and
    rows without a target are left out.  All columns share one grouped count.
    """
    names = columns or [c for c in numeric_columns(df, (target,)) if c.startswith(DESCRIPTOR_PREFIXES)]
    if target not in df.columns or not names:
        return df.sparkSession.createDataFrame([], "feature string, importance double")
    rows = df.filter(F.col(target).isNotNull()).select(
        F.col(target).cast("double").alias("_y"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(names)],
    )
    ends = [x for i in range(len(names)) for x in (F.min(f"x{i}").alias(f"lo{i}"), F.max(f"x{i}").alias(f"hi{i}"))]
    limits = rows.agg(F.struct(F.min("_y").alias("lo"), F.max("_y").alias("hi"), *ends).alias("s")).scalar()
    y_bin = _bin(F.col("_y"), limits["lo"], limits["hi"], bins).alias("yb")
    x_bins = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), _bin(F.col(f"x{i}"), limits[f"lo{i}"], limits[f"hi{i}"], bins).alias("xb"))
                for i, c in enumerate(names)
            ]
        )
    )
    joint = (
        rows.select(y_bin, x_bins.alias("x")).groupBy(F.col("x.feature").alias("feature"), F.col("x.xb").alias("xb"), "yb")
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
    )
    total = F.sum("c").over(Window.partitionBy("feature"))
    of_x = F.sum("c").over(Window.partitionBy("feature", "xb"))
    of_y = F.sum("c").over(Window.partitionBy("feature", "yb"))
    terms = joint.select("feature", "c", total.alias("n"), of_x.alias("cx"), of_y.alias("cy"))
    information = F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy"))))
    return terms.groupBy("feature").agg(F.greatest(information, F.lit(0.0)).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


_CELL = "i int, j int, n double, mean_i double, mean_j double, sq_i double, sq_j double, both double, odd double"


def _moments(x: np.ndarray) -> dict[str, np.ndarray]:
    """Pairwise complete moments of the columns of some rows, as matrices; null values are NaN with no ``odd`` mark.

    Products are taken of distances to the column's own middle value, so a
    constant column has none and large values lose no digits.
    """
    seen = np.isfinite(x)
    middle = np.zeros(x.shape[1])
    for c in range(x.shape[1]):
        own = x[seen[:, c], c]
        if len(own):
            middle[c] = np.partition(own, len(own) // 2)[len(own) // 2]
    away = np.where(seen, x - middle, 0.0)
    mask = seen.astype(float)
    n, total, squares, products = mask.T @ mask, away.T @ mask, (away**2).T @ mask, away.T @ away
    some = np.maximum(n, 1)
    spread = squares - total**2 / some
    spread[spread <= 1e-13 * squares] = 0  # constant among the rows of the pair
    return {"n": n, "mean": middle[:, None] + total / some, "sq": spread, "both": products - total * total.T / some}


def _merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n = a["n"] + b["n"]
    some = np.maximum(n, 1)
    step = np.where((a["n"] > 0) & (b["n"] > 0), b["mean"] - a["mean"], 0.0)
    weight = a["n"] * b["n"] / some
    mean = np.where(a["n"] > 0, a["mean"] + step * b["n"] / some, b["mean"])
    return {"n": n, "mean": mean, "sq": a["sq"] + b["sq"] + weight * step**2, "both": a["both"] + b["both"] + weight * step * step.T}


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of all column pairs, pairwise complete, long form.

    A constant column gives null, as does a pair of which a row holds NaN or an
    infinite number.  One scan: a task multiplies the matrix of its values with
    itself, a batch of rows at a time, and returns a row per pair; those rows are
    then merged by (count, means, squares, products), which loses no digits
    either.  No row of the table is copied or shuffled.
    """
    names = columns or numeric_columns(df)
    if len(names) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, odd = None, np.zeros((len(names), len(names)))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            bad = there * ~np.isfinite(x)
            if bad.any():
                odd = odd + bad.T @ there + there.T @ bad
            part = _moments(x)
            held = part if held is None else _merged(held, part)
        if held is None:
            return
        i, j = np.triu_indices(len(names))
        cells = [held["n"][i, j], held["mean"][i, j], held["mean"][j, i], held["sq"][i, j], held["sq"][j, i], held["both"][i, j], odd[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, cells)], names=[c.split()[0] for c in _CELL.split(", ")])

    # A row per task and pair.  Distances to the least mean keep a constant exact.
    pair = Window.partitionBy("i", "j")
    cells = rows.mapInArrow(gram, _CELL)
    some = F.when(F.col("n") > 0, F.col("n"))
    for side in ("i", "j"):
        low = F.min(F.when(some.isNotNull(), F.col(f"mean_{side}"))).over(pair)
        cells = cells.withColumn(f"to_{side}", F.when(some.isNotNull(), F.col(f"mean_{side}") - low).otherwise(0.0))
    for side in ("i", "j"):
        cells = cells.withColumn(f"off_{side}", F.col(f"to_{side}") - F.sum(F.col("n") * F.col(f"to_{side}")).over(pair) / F.sum(some).over(pair))
    total = cells.groupBy("i", "j").agg(
        F.sum("odd").alias("odd"),
        *[F.sum(F.col(f"sq_{s}") + F.col("n") * F.coalesce(F.col(f"off_{s}"), F.lit(0.0)) ** 2).alias(f"sq_{s}") for s in ("i", "j")],
        F.sum(F.col("both") + F.col("n") * F.coalesce(F.col("off_i") * F.col("off_j"), F.lit(0.0))).alias("both"),
    )
    between = F.when(F.col("odd") == 0, F.col("both") / F.sqrt(F.nullif(F.col("sq_i") * F.col("sq_j"), F.lit(0.0))))
    own = F.when((F.col("sq_i") > 0) | (F.col("odd") > 0), 1.0)
    found = total.select("i", "j", F.when(F.col("i") == F.col("j"), own).otherwise(between).alias("corr"))
    both_ways = F.array(F.struct("i", "j", "corr"), F.when(F.col("i") < F.col("j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "corr")))
    cells = found.select(F.explode(F.array_compact(both_ways)).alias("c")).select("c.*")
    # Without rows in the table no task returns anything; the pairs are there all the same.
    every = df.sparkSession.range(len(names) ** 2).select(F.floor(F.col("id") / len(names)).cast("int").alias("i"), (F.col("id") % len(names)).cast("int").alias("j"))
    label = F.array(*[F.lit(c) for c in names])
    matrix = every.join(F.broadcast(cells), ["i", "j"], "left")  # as many rows as pairs
    return matrix.select(label[F.col("i")].alias("column_a"), label[F.col("j")].alias("column_b"), "corr")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram with empty bins; the last bin is closed."""
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    ends = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    counts = values.groupBy(_bin(F.col("v"), ends["lo"], ends["hi"], bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (ends["hi"] - ends["lo"]) / bins
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (ends["lo"] + F.col("bin") * width).alias("bin_start"),
        (ends["lo"] + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("c", F.lit(0)).alias("row_count"),
    )
