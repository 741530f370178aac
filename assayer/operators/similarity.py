"""Similarity search, diversity of a set, and multi-target ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import check_metric, score_from_counts, set_score
from ..session import stage
from .near_duplicates import least_share
from .numbering import number_rows
from .rules import column_for


def query_bits(queries: DataFrame, bits: str) -> list[int]:
    """The fingerprint of a one-row query table; raises when there is none."""
    rows = queries.select(bits).limit(1).collect()
    if not rows or rows[0][0] is None:
        raise ValueError("invalid query structure")
    return list(rows[0][0])


def search(
    targets: DataFrame,
    target_id: str,
    bits: str,
    query: list[int],
    metric: str = "tanimoto",
    threshold: float = 0.0,
    top_k: int | None = None,
    valid: str | None = None,
) -> DataFrame:
    """Targets ranked by their likeness to one query: all, or the ``top_k`` nearest.

    The query's few bits are a literal, so this is one map-only scan.  With
    ``top_k`` its tasks each keep that many rows; without, all targets at or above
    the threshold are numbered by ranges (``numbering``).  Invalid targets score 0 with an error.
    The threshold applies only above 0.  Counts of all comparisons and of the
    rows kept come along as columns.
    """
    if top_k is not None and top_k < 1:
        raise ValueError("top_k must be 1 or more")
    check_metric(metric)
    ok = F.col(valid) if valid else F.lit(True)
    literal = F.array(*[F.lit(int(b)) for b in query]).cast(targets.schema[bits].dataType)
    value = F.when(ok, set_score(F.col(bits), literal, metric)).otherwise(0.0)
    scored = targets.select(
        F.col(target_id),
        value.alias("similarity_score"),
        F.when(~ok, "Invalid target structure").alias("error"),
    )
    total = targets.agg(F.count(F.lit(1)).alias("n")).scalar()
    if top_k is None:
        best = scored.filter(F.col("similarity_score") >= threshold) if threshold > 0 else scored
        place, kept = _all_ranks(best, target_id)
    else:
        best = scored.orderBy(F.desc("similarity_score"), target_id).limit(top_k)
        if threshold > 0:
            # The same rows as filtering first; here it cannot be pushed below the
            # score, which would then be worked out twice.
            best = best.filter(F.col("similarity_score") >= threshold)
        place = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity_score"), target_id)))  # at most top_k rows
        kept = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return place.select(
        "rank", target_id, "similarity_score", F.lit(metric).alias("metric"), "error", total.alias("total_comparisons"), kept.alias("above_threshold")
    )


def _all_ranks(scored: DataFrame, target_id: str) -> tuple[DataFrame, Column]:
    """Every row with its rank by (score descending, id), and the number of rows.

    Rows are numbered by ranges of both, so targets of one score, which may be
    most of them, are cut by their ids.
    """
    ranked = number_rows(stage(scored, "scores"), [F.desc("similarity_score"), target_id], (), "rank", "_kept")
    return ranked.withColumn("rank", (F.col("rank") + 1).cast("int")), F.col("_kept")


def search_many(
    queries: DataFrame,
    targets: DataFrame,
    query_id: str,
    target_id: str,
    bits: str,
    metric: str = "tanimoto",
    threshold: float = 0.3,
    top_k: int | None = None,
) -> DataFrame:
    """Targets of every query at or above a threshold, all or ``top_k`` each; exact.

    A match must share ``ceil(s * |q|)`` bits with query q, so it holds at
    least one of any ``|q| - ceil(s * |q|) + 1`` of q's bits.  The rarest of
    q's bits are taken for that; targets without one of them never meet q.
    Candidates are then scored in full.  The tokens of both sides are made once
    and staged; Spark picks the joins by their sizes and splits hot bits.

    Both tables hold (id, bits); stage them when the bits are costly.
    """
    if not 0 < threshold <= 1:
        raise ValueError("search_many needs a threshold above 0 and up to 1")
    if top_k is not None and top_k < 1:
        raise ValueError("top_k must be 1 or more")
    share = least_share(metric, threshold)
    q = queries.select(F.col(query_id).alias("q"), F.col(bits).alias("q_bits")).filter(F.size("q_bits") > 0)
    t = targets.select(F.col(target_id).alias("t"), F.col(bits).alias("t_bits"))
    q_tokens = q.select("q", F.size("q_bits").alias("q_size"), F.explode("q_bits").alias("bit"))
    q_tokens = stage(q_tokens, "query-tokens")
    t_tokens = t.select("t", F.size("t_bits").alias("t_size"), F.explode("t_bits").alias("bit"))
    t_tokens = stage(t_tokens.join(q_tokens.select("bit").distinct(), "bit", "left_semi"), "tokens")
    frequency = t_tokens.groupBy("bit").agg(F.count(F.lit(1)).alias("freq"))
    # The -1e-9 guards against rounding up past a whole number: a longer
    # prefix is always safe.
    needed = F.ceil(F.col("q_size") * share - 1e-9)
    rarest = Window.partitionBy("q").orderBy(F.col("freq").asc(), F.col("bit").asc())
    prefix = (
        q_tokens.join(frequency, "bit", "left")
        .withColumn("freq", F.coalesce("freq", F.lit(0)))
        .withColumn("place", F.row_number().over(rarest))
        .filter((F.col("place") <= F.col("q_size") - needed + 1) & (F.col("freq") > 0))
        .select("bit", "q", "q_size")
    )
    lengths_fit = (F.col("t_size") >= F.col("q_size") * share - 1e-9) & (F.col("t_size") * share <= F.col("q_size") + 1e-9)
    candidates = t_tokens.join(prefix, "bit").filter(lengths_fit).select("q", "t").distinct()
    pairs = candidates.join(t, "t").join(q, "q")
    # The threshold is applied after the ranking, with the same outcome: a
    # filter here would be pushed into the join and work out the score twice.
    sized = pairs.withColumn("common", F.size(F.array_intersect("q_bits", "t_bits")))
    score = score_from_counts(F.col("common"), F.size("q_bits"), F.size("t_bits"), metric)
    best = Window.partitionBy("q").orderBy(F.desc("similarity_score"), "t")
    return (
        sized.select("q", "t", score.alias("similarity_score"))
        .withColumn("rank", F.row_number().over(best)).filter(F.lit(True) if top_k is None else F.col("rank") <= top_k)
        .filter(F.col("similarity_score") >= threshold)
        .select(F.col("q").alias(query_id), "rank", F.col("t").alias(f"match_{target_id}"), "similarity_score")
    )


def pair_scores(df: DataFrame, left: str, right: str) -> DataFrame:
    """Add every set score of two bit columns of the same row."""
    return df.withColumns({m: set_score(F.col(left), F.col(right), m) for m in ("tanimoto", "dice", "cosine")})


# --- diversity ---------------------------------------------------------------

_PARTIAL = "pairs double, total double, squares double, low double, high double"


def _block_scores(left: pd.Series, right: pd.Series, metric: str) -> np.ndarray:
    """Scores of all sets of one block against all of another."""
    a_size = left.map(len).to_numpy()
    b_size = right.map(len).to_numpy()
    a_bits = np.concatenate(left.to_list() or [np.empty(0)])
    b_bits = np.concatenate(right.to_list() or [np.empty(0)])
    shared = np.intersect1d(a_bits, b_bits)
    a_row, b_row = np.repeat(np.arange(len(left)), a_size), np.repeat(np.arange(len(right)), b_size)
    common = np.zeros((len(left), len(right)))
    for start in range(0, len(shared), 4096):  # a slice of columns at a time
        part = shared[start : start + 4096]

        def dense(bits, rows, n):
            at = np.searchsorted(part, bits)
            hit = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == bits)
            out = np.zeros((n, len(part)), dtype=np.float32)
            out[rows[hit], at[hit]] = 1.0
            return out

        common += dense(a_bits, a_row, len(left)) @ dense(b_bits, b_row, len(right)).T
    if metric == "tanimoto":
        below = a_size[:, None] + b_size[None, :] - common
    elif metric == "dice":
        below, common = a_size[:, None] + b_size[None, :], 2 * common
    else:
        below = np.sqrt(a_size[:, None] * b_size[None, :].astype(float))
    return np.divide(common, below, out=np.zeros_like(common, dtype=float), where=below > 0)


def diversity(df: DataFrame, bits: str, metric: str = "tanimoto", valid: str | None = None, block: int = 1024) -> DataFrame:
    """Mean, std, min and max score over all pairs of a set; score 1 − mean.

    Every pair counts, so the work is quadratic in the number of *distinct*
    fingerprints.  Copies are counted, not compared: a fingerprint with w
    copies is one row of weight w.  Blocks of about ``block`` fingerprints meet
    in one task each, which returns five numbers; no pair becomes a row.
    """
    metric = check_metric(metric)
    rows = df.filter(F.col(valid)) if valid else df
    distinct = rows.filter(F.col(bits).isNotNull()).groupBy(F.col(bits).alias("bits")).agg(F.count(F.lit(1)).alias("w"))
    size = distinct.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n_blocks = max(1, math.ceil(size / block))
    placed = distinct.withColumn("own", F.pmod(F.xxhash64("bits"), F.lit(n_blocks)).cast("int"))
    # Block i goes to every pair (min, max) it belongs to.
    partner = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    meeting = placed.withColumn("other", partner).select(
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "bits", "w"
    )

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        a, b = pdf[pdf["own"] == i], pdf[pdf["own"] == j]
        if a.empty or b.empty:
            return pd.DataFrame({c.split()[0]: pd.Series(dtype=float) for c in _PARTIAL.split(", ")})
        scores = _block_scores(a["bits"], b["bits"], metric)
        weight = a["w"].to_numpy(float)[:, None] * b["w"].to_numpy(float)[None, :]
        if i == j:
            weight = np.triu(weight, 1)
            w = a["w"].to_numpy(float)
            np.fill_diagonal(weight, w * (w - 1) / 2)
        used = weight > 0
        if not used.any():
            return pd.DataFrame({c.split()[0]: pd.Series(dtype=float) for c in _PARTIAL.split(", ")})
        return pd.DataFrame(
            {
                "pairs": [weight.sum()],
                "total": [(weight * scores).sum()],
                "squares": [(weight * scores**2).sum()],
                "low": [scores[used].min()],
                "high": [scores[used].max()],
            }
        )

    partial = meeting.groupBy("i", "j").applyInPandas(compare, _PARTIAL)
    n = rows.filter(F.col(bits).isNotNull()).agg(F.count(F.lit(1)).alias("n")).scalar()
    sums = partial.agg(
        F.sum("pairs").alias("pairs"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    return _diversity_row(sums, n)


def _diversity_row(sums: DataFrame, n: Column) -> DataFrame:
    mean = F.col("total") / F.col("pairs")
    variance = F.greatest(F.lit(0.0), F.col("squares") / F.col("pairs") - mean * mean)
    return sums.select(
        mean.alias("mean_similarity"),
        F.sqrt(variance).alias("std_similarity"),
        F.col("low").alias("min_similarity"),
        F.col("high").alias("max_similarity"),
        (1 - mean).alias("diversity_score"),
        n.alias("num_molecules"),
        F.coalesce(F.col("pairs").cast("bigint"), F.lit(0)).alias("num_comparisons"),
        F.when(F.coalesce(F.col("pairs"), F.lit(0.0)) == 0, "Need at least 2 valid molecules").alias("error"),
    )


def dense_diversity(df: DataFrame, vector: str) -> DataFrame:
    """Mean and std of the cosine over all pairs of dense vectors, without pairs.

    With unit vectors u, the pair scores sum to (|Σu|² − n) / 2 and their
    squares to (|Σ u uᵀ|² − n) / 2, so one pass of d x d partial sums is exact.
    Zero vectors have no direction and are left out.
    """

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = None
        for pdf in batches:
            if pdf.empty:
                continue
            u = np.stack(pdf["v"].to_numpy()).astype(float)
            norms = np.linalg.norm(u, axis=1, keepdims=True)
            u = u[norms[:, 0] > 0] / norms[norms[:, 0] > 0]
            u = np.hstack([u, np.ones((len(u), 1))])  # the last row carries Σu and n
            matrix = u.T @ u if matrix is None else matrix + u.T @ u
        if matrix is not None:
            d = len(matrix)
            i, j = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame({"i": i, "j": j, "s": matrix.ravel(), "d": d - 1})

    sums = df.filter(F.col(vector).isNotNull()).select(F.col(vector).alias("v")).mapInPandas(gram, "i long, j long, s double, d long")
    cells = sums.groupBy("i", "j", "d").agg(F.sum("s").alias("s"))
    inner = (F.col("i") < F.col("d")) & (F.col("j") < F.col("d"))
    facts = cells.agg(
        F.sum(F.when(inner, F.col("s") * F.col("s"))).alias("gram"),
        F.sum(F.when((F.col("i") == F.col("d")) & (F.col("j") < F.col("d")), F.col("s") * F.col("s"))).alias("norm"),
        F.max(F.when((F.col("i") == F.col("d")) & (F.col("j") == F.col("d")), F.col("s"))).alias("n"),
    )
    n = F.col("n")
    pairs = F.nullif(n * (n - 1) / 2, F.lit(0.0))
    mean = (F.col("norm") - n) / 2 / pairs
    square = (F.col("gram") - n) / 2 / pairs
    return facts.select(
        mean.alias("mean_similarity"),
        F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("std_similarity"),
        (1 - mean).alias("diversity_score"),
        n.cast("bigint").alias("num_molecules"),
        F.coalesce(pairs, F.lit(0.0)).cast("bigint").alias("num_comparisons"),
    )


# --- multi-target ranking ----------------------------------------------------


def _goal(df: DataFrame, goal: dict) -> tuple[str, Column, Column]:
    """(name, score in 0..1, met) of one target.

    A goal has ``property``, ``value``, and optionally ``weight``, ``tolerance``
    and ``direction`` (target, minimize or maximize).
    """
    column = column_for(df, goal["property"])
    x = F.col(column).cast("double") if column else F.lit(None).cast("double")
    value, tolerance = F.lit(float(goal["value"])), F.lit(float(goal.get("tolerance", 0.0)))
    direction = goal.get("direction", "target")
    if direction == "target":
        distance = F.abs(x - value) - tolerance
    elif direction == "minimize":
        distance = x - value
    elif direction == "maximize":
        distance = value - x
    else:
        raise ValueError(f"unknown direction: {direction}")
    met = F.coalesce(distance <= 0, F.lit(False))
    miss = 1 / (1 + distance / F.lit(max(abs(float(goal["value"])), 1.0)))
    return goal["property"], F.when(met, 1.0).otherwise(F.coalesce(miss, F.lit(0.0))), met


def rank_candidates(
    df: DataFrame,
    row_id: str,
    goals: list[dict],
    limits: dict[str, dict[str, float]] | None = None,
    similarity: str | None = None,
    min_similarity: float = 0.3,
    only: Column | None = None,
    top_k: int = 10,
) -> DataFrame:
    """Candidates best by weighted fitness, inside hard limits.

    ``limits`` are inclusive ranges, ``similarity`` names a score column with
    a floor, ``only`` is a further condition such as a rule verdict.  Targets
    not met are listed in ``violations``.  One scan keeping ``top_k`` rows.
    """
    parts = [(*_goal(df, g), float(g.get("weight", 1.0))) for g in goals]
    total = sum(w for *_, w in parts)
    fitness = F.lit(0.0)
    for _, score, _, weight in parts:
        fitness = fitness + score * F.lit(weight)
    rows = df
    for name, bounds in (limits or {}).items():
        column = column_for(df, name)
        if column is None:
            raise ValueError(f"no column for the limit on {name}")
        if "min" in bounds:
            rows = rows.filter(F.col(column) >= F.lit(bounds["min"]))
        if "max" in bounds:
            rows = rows.filter(F.col(column) <= F.lit(bounds["max"]))
    if similarity is not None:
        rows = rows.filter(F.col(similarity) >= min_similarity)
    if only is not None:
        rows = rows.filter(only)
    missed = F.array_compact(F.array(*[F.when(~met, F.lit(name)) for name, _, met, _ in parts]))
    scored = rows.select(row_id, (fitness / F.lit(total)).alias("fitness"), missed.alias("violations"))
    best = scored.orderBy(F.desc("fitness"), row_id).limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fitness"), row_id)))
