"""Pair scores on sets (sorted or unsorted arrays of bits) and dense vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

METRICS = ("tanimoto", "dice", "cosine", "jaccard")


def check_metric(metric: str) -> str:
    """Lower-cased metric name; raises on an unknown one."""
    name = metric.lower()
    if name not in METRICS:
        raise ValueError(f"unknown similarity metric: {metric}; one of {', '.join(METRICS)}")
    return "tanimoto" if name == "jaccard" else name


def score_from_counts(common: Column, left: Column, right: Column, metric: str = "tanimoto") -> Column:
    """Score from the three set sizes; two empty sets (or one) score 0."""
    metric = check_metric(metric)
    common, left, right = (c.cast("double") for c in (common, left, right))
    if metric == "tanimoto":
        below = left + right - common
        value = common / F.nullif(below, F.lit(0.0))
    elif metric == "dice":
        value = 2 * common / F.nullif(left + right, F.lit(0.0))
    else:
        value = common / F.nullif(F.sqrt(left * right), F.lit(0.0))
    return F.coalesce(value, F.lit(0.0))


def set_score(left: Column, right: Column, metric: str = "tanimoto") -> Column:
    """Score of two bit sets given as arrays without repeats."""
    common = F.size(F.array_intersect(left, right))
    return score_from_counts(common, F.size(left), F.size(right), metric)


def dense_cosine(left: Column, right: Column) -> Column:
    """Cosine of two dense vectors given as arrays of numbers."""

    def dot(a, b):
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
        )

    return dot(left, right) / F.nullif(F.sqrt(dot(left, left) * dot(right, right)), F.lit(0.0))


def sign_bits(vector: Column) -> Column:
    """Positions of the positive entries of a dense vector."""
    marked = F.transform(vector, lambda x, at: F.when(x > 0, at))
    return F.array_compact(marked)
