"""Range filters, rule violations, bands, projections and paging."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from .numbering import number_rows
from .ordering import not_after, row_at_rank, sortable

# The other names that properties go by.
ALIASES = {
    "mw": "molecular_weight",
    "hbd": "num_hbd",
    "hba": "num_hba",
    "rotatable_bonds": "num_rotatable_bonds",
    "aromatic_rings": "num_aromatic_rings",
    "heavy_atoms": "num_heavy_atoms",
    "heavy_atom_count": "num_heavy_atoms",
    "xlogp": "logp",
}

# The drug-likeness ranges and the rule-of-five limits.
DRUG_LIKE_RANGES = {
    "molecular_weight": {"min": 150, "max": 500},
    "logp": {"min": -3, "max": 5},
    "num_hbd": {"max": 5},
    "num_hba": {"max": 10},
    "tpsa": {"max": 140},
}
RULE_OF_FIVE = {"molecular_weight": 500, "logp": 5, "num_hbd": 5, "num_hba": 10}
VEBER = {"num_rotatable_bonds": 10, "tpsa": 140}

# Fixed values: (low below, high above) per property, and the score bands.
PROPERTY_BANDS = {"molecular_weight": (150, 500), "logp": (0, 3), "tpsa": (20, 130)}
SCORE_BANDS = (0.7, 0.5)


def column_for(df: DataFrame, name: str) -> str | None:
    """The table's column for a property name, by name or alias; None if absent."""
    if name in df.columns:
        return name
    wanted = ALIASES.get(name, name)
    if wanted in df.columns:
        return wanted
    return next((a for a, c in ALIASES.items() if c == wanted and a in df.columns), None)


def bounds_of(df: DataFrame, ranges: dict[str, dict[str, float]]) -> tuple[list[tuple[str, Column]], list[str]]:
    """(rule name, predicate) per bound in order, and the properties not found."""
    rules, skipped = [], []
    for name, limits in ranges.items():
        column = column_for(df, name)
        if column is None:
            skipped.append(name)
            continue
        if "min" in limits:
            rules.append((f"{name}_min", F.col(column) >= F.lit(limits["min"])))
        if "max" in limits:
            rules.append((f"{name}_max", F.col(column) <= F.lit(limits["max"])))
    return rules, skipped


def within_ranges(df: DataFrame, ranges: dict[str, dict[str, float]]) -> DataFrame:
    """Rows inside every inclusive range; a null value fails its range.

    The bounds are plain comparisons, so they reach the file scan.
    """
    rules, skipped = bounds_of(df, ranges)
    if skipped:
        warnings.warn(f"no column for {', '.join(skipped)}; not filtered", stacklevel=2)
    return df.filter(reduce(lambda a, b: a & b, [p for _, p in rules])) if rules else df


def drug_like(df: DataFrame) -> DataFrame:
    """Rows inside the preset drug-likeness ranges."""
    return within_ranges(df, DRUG_LIKE_RANGES)


def attrition(df: DataFrame, ranges: dict[str, dict[str, float]]) -> DataFrame:
    """Rows removed by each bound in rule order, and those kept; one pass."""
    rules, _ = bounds_of(df, ranges)
    fate = reduce(
        lambda chain, item: chain.when(~F.coalesce(item[1][1], F.lit(False)), F.lit(item[0])),
        list(enumerate(rules)),
        F.when(F.lit(False), F.lit(-1)),
    ).otherwise(F.lit(len(rules)))
    counted = df.groupBy(fate.alias("rule_no")).agg(F.count(F.lit(1)).alias("rows_removed"))
    names = [name for name, _ in rules] + ["kept"]
    all_rules = F.explode(F.array(*[F.struct(F.lit(i).alias("rule_no"), F.lit(n).alias("rule")) for i, n in enumerate(names)]))
    listed = df.sparkSession.range(1).select(all_rules.alias("r")).select("r.*")
    return listed.join(counted, "rule_no", "left").select(
        "rule_no", "rule", F.coalesce("rows_removed", F.lit(0)).alias("row_count")
    )


def rule_violations(df: DataFrame, limits: dict[str, float] = RULE_OF_FIVE, allowed: int = 1) -> DataFrame:
    """Add a flag per limit, the number of violations and the verdict.

    A missing value counts as 0, as an absent descriptor does.
    """
    flags = {}
    for name, limit in limits.items():
        column = column_for(df, name)
        value = F.coalesce(F.col(column), F.lit(0)) if column else F.lit(0)
        flags[f"{name}_ok"] = value <= F.lit(limit)
    out = df.withColumns(flags)
    broken = reduce(lambda a, b: a + b, [(~F.col(f)).cast("int") for f in flags])
    return out.withColumn("violations", broken).withColumn("rule_pass", F.col("violations") <= allowed)


def veber_pass(df: DataFrame) -> Column:
    """At most 10 rotatable bonds and a polar surface of at most 140; a missing value counts as 0."""
    value = lambda n: F.coalesce(F.col(c), F.lit(0)) if (c := column_for(df, n)) else F.lit(0)
    return (value("num_rotatable_bonds") <= VEBER["num_rotatable_bonds"]) & (value("tpsa") <= VEBER["tpsa"])


def drug_likeness(df: DataFrame) -> DataFrame:
    """Add ``violations``, ``rule_pass``, ``veber_pass``, ``drug_like_score`` and ``alerts``.

    The score is the share of the rule-of-five limits and of Veber's that hold;
    the alerts name the limits that are broken.
    """
    out = rule_violations(df).withColumn("veber_pass", veber_pass(df))
    flags = [f"{n}_ok" for n in RULE_OF_FIVE]
    held = reduce(lambda a, b: a + b, [F.col(f).cast("int") for f in (*flags, "veber_pass")])
    broken = F.array(*[F.when(~F.col(f), F.lit(f.removesuffix("_ok").removesuffix("_pass"))) for f in (*flags, "veber_pass")])
    return out.withColumns({"drug_like_score": held / F.lit(len(flags) + 1.0), "alerts": F.array_compact(broken)})


def band(value: Column, low: float, high: float) -> Column:
    """``low`` / ``ok`` / ``high``; the limits themselves are ok."""
    return F.when(value < low, "low").when(value > high, "high").when(value.isNotNull(), "ok")


def property_bands(df: DataFrame, bands: dict[str, tuple[float, float]] = PROPERTY_BANDS) -> DataFrame:
    """Add ``<name>_band`` for every property the table has."""
    found = {n: column_for(df, n) for n in bands}
    return df.withColumns({f"{n}_band": band(F.col(c), *bands[n]) for n, c in found.items() if c})


def score_band(score: Column) -> Column:
    """``high`` above 0.7, ``medium`` above 0.5, else ``low``."""
    upper, middle = SCORE_BANDS
    return F.when(score > upper, "high").when(score > middle, "medium").when(score.isNotNull(), "low")


def project_properties(df: DataFrame, row_id: str, properties: list[str] | None = None) -> DataFrame:
    """Asked-for properties as a map, with an error entry for unknown ones."""
    asked = properties or ["molecular_weight", "logp", "tpsa"]
    pairs, errors = [], []
    for name in asked:
        column = column_for(df, name)
        pairs += [F.lit(name), F.col(column).cast("double") if column else F.lit(None).cast("double")]
        if column is None:
            errors.append(f"unknown property: {name}")
    listed = F.array(*[F.lit(e) for e in errors]) if errors else F.array().cast("array<string>")
    return df.select(row_id, F.create_map(*pairs).alias("properties"), listed.alias("errors"))


def feature_matrix(df: DataFrame, essentials: tuple[str, ...] = ("smiles", "canonical_smiles", "valid"), row_id: str | None = None) -> DataFrame:
    """Essential columns that exist, then all numeric ones, by schema type."""
    first = [c for c in ((row_id,) if row_id else ()) + essentials if c in df.columns]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in first]
    return df.select(*first, *numeric)


def page(df: DataFrame, key: str, number: int = 1, size: int = 20, largest: int = 100) -> DataFrame:
    """One page of the table ordered by a unique key, with the paging facts.

    The start of the page is sought by rank, so a deep page costs narrow scans
    of the key and one page of rows, not a sort of everything before it.  Rows
    with a null key come first, as Spark sorts them.  ``largest`` bounds the
    rows that a request may ask for.
    """
    if number < 1 or not 1 <= size <= largest:
        raise ValueError(f"page numbers start at 1 and pages hold 1 to {largest} rows")
    total, present = df.agg(F.count(F.lit(1)), F.count(key)).first()
    offset, nulls = (number - 1) * size, total - present
    pages = -(-total // size)
    if offset <= nulls:
        rows = df.orderBy(key).offset(offset) if offset else df
    elif offset < total:
        keyed = df.filter(F.col(key).isNotNull())
        order = [sortable(keyed, key)]
        start = row_at_rank(keyed, order, [offset - nulls - 1], present)[offset - nulls - 1]
        rows = keyed.filter(~not_after(order, start))
    else:
        rows = df.filter(F.lit(False))
    return rows.orderBy(key).limit(size).withColumns(
        {
            "total_items": F.lit(total).cast("bigint"),
            "total_pages": F.lit(pages).cast("bigint"),
            "current_page": F.lit(number).cast("bigint"),
            "has_next": F.lit(number < pages),
            "has_previous": F.lit(number > 1),
        }
    )


def with_pages(df: DataFrame, key: str, size: int = 20) -> DataFrame:
    """All rows with the number of their page, from 1, in the order of ``page``.

    One pass numbers every row, so that page n is a filter on the outcome: the
    way to go where more than a few pages are read.  Rows with a null key come
    first, and rows of one key, or of none, are cut into pages like others.
    """
    if size < 1:
        raise ValueError("pages hold 1 row or more")
    numbered = number_rows(df, [F.col(key).asc_nulls_first()], (), "_row")
    return numbered.withColumn("page", (F.floor(F.col("_row") / size) + 1).cast("int")).drop("_row")
