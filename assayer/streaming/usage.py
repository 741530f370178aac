"""Usage metrics, quotas, job states and cached results over event tables.

All functions but ``cache_misses`` take a batch or a streaming table.  On a
stream the watermark bounds the state: events later than it are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.numbering import number_rows
from ..session import stage

# Quota per minute, cache lifetime, job states.
QUOTA_PER_MINUTE = 100
CACHE_TTL_SECONDS = 3600
JOB_STATES = ("pending", "running", "completed", "failed", "cancelled")

#: Sightings of a block that one task walks through; longer blocks go by doubled jumps.
WALK_ROWS = 100_000


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """The watermark, on streams only; event time must be an instant there."""
    if not df.isStreaming:
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def usage_metrics(
    events: DataFrame,
    endpoint: str | list[str] = "endpoint",
    ok: str = "ok",
    duration: str = "duration",
    ts: str = "ts",
    window: str | None = "1 hour",
    delay: str = "10 minutes",
) -> DataFrame:
    """Requests, successes, failures, mean and longest time per endpoint and window.

    ``endpoint`` may be several columns, such as method and path.
    """
    names = [endpoint] if isinstance(endpoint, str) else list(endpoint)
    keys = ([F.window(ts, window).alias("w")] if window else []) + [F.col(c) for c in names]
    out = _timed(events, ts, delay).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col(ok)).alias("successful_requests"),
        F.count_if(~F.col(ok)).alias("failed_requests"),
        F.avg(duration).alias("average_response_time"),
        F.max(duration).alias("max_response_time"),
        F.max(ts).alias("last_request"),
    )
    return out.withColumn("window_start", F.col("w.start")).drop("w") if window else out


def overall_usage(per_endpoint: DataFrame) -> DataFrame:
    """Totals, error rate in percent and mean time from the per-endpoint metrics."""
    total, failed = F.sum("total_requests"), F.sum("failed_requests")
    spent = F.sum(F.col("average_response_time") * F.col("total_requests"))
    return per_endpoint.agg(
        total.alias("total_requests"),
        F.sum("successful_requests").alias("successful_requests"),
        failed.alias("failed_requests"),
        F.coalesce(100.0 * failed / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("error_rate"),
        (spent / F.nullif(total, F.lit(0))).alias("average_response_time"),
    )


def quotas(
    events: DataFrame,
    client: str = "user_id",
    ts: str = "ts",
    limit: int = QUOTA_PER_MINUTE,
    window: str = "1 minute",
    slide: str | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """Requests used, left, reset time and over-limit flag per client and window."""
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    used = _timed(events, ts, delay).groupBy(frame.alias("w"), F.col(client)).agg(F.count(F.lit(1)).alias("used"))
    return used.select(
        client,
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("reset_time"),
        "used",
        F.lit(limit).cast("bigint").alias("quota"),
        F.greatest(F.lit(0), F.lit(limit) - F.col("used")).cast("bigint").alias("remaining"),
        (F.col("used") > limit).alias("over_limit"),
    )


def job_status(
    updates: DataFrame, job: str = "job_id", status: str = "status", done: str = "done", total: str = "total", ts: str = "ts", tie: str | None = None
) -> DataFrame:
    """Latest state per job with progress; rows with a state not allowed are ignored.

    Keeps one struct per job, merged map-side.  On a stream use update mode.
    """
    order = F.struct(ts, tie) if tie else F.col(ts)
    latest = updates.filter(F.col(status).isin(*JOB_STATES)).groupBy(job).agg(
        F.max_by(F.struct(F.col(status).alias("status"), F.col(done).alias("done"), F.col(total).alias("total"), F.col(ts).alias("at")), order).alias("s"),
        F.min(ts).alias("created_at"),
    )
    return latest.select(
        job,
        "s.status",
        F.col("s.done").alias("processed"),
        F.col("s.total").alias("total"),
        (F.col("s.done") / F.nullif(F.col("s.total").cast("double"), F.lit(0.0))).alias("progress"),
        "created_at",
        F.col("s.at").alias("updated_at"),
    )


def first_within_ttl(events: DataFrame, key: str, ts: str = "ts", ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Streaming form of the result cache: repeats of a key inside the TTL drop.

    State expires by watermark, so what is kept right at the TTL depends on
    when batches arrive; ``cache_misses_stream`` is exact on events in order.
    """
    delay = f"{ttl_seconds} seconds"
    return _timed(events, ts, delay).dropDuplicatesWithinWatermark([key])


def cache_misses_stream(
    events: DataFrame, key: str, row_id: str, ts: str = "ts", ttl_seconds: int = CACHE_TTL_SECONDS, delay: str | None = None
) -> DataFrame:
    """``cache_misses`` of a stream: key, row_id, cached_at of the sightings that are kept.

    A key's state is the time of its last kept sighting.  It is dropped once the
    watermark, which follows ``delay`` (the TTL if not given) behind the latest
    event, has passed that time by a TTL, as nothing is cached then.  Batches may be cut anywhere: on
    events that arrive in order the outcome is that of the batch form.  An event
    that comes after a later one of its key was kept finds that one's result; one
    behind the watermark is not looked at.  Rows without a time are left out, and
    a null key is a key.  A task holds the times of one key in one batch, so
    bound a batch at the source (``maxFilesPerTrigger``).
    """
    ttl = ttl_seconds * 1_000_000
    timed = _timed(events, ts, delay or f"{ttl_seconds} seconds")
    rows = timed.where(F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.col(row_id).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), ts)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def keep(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat([p[["id", "at"]] for p in parts]).sort_values(["at", "id"])
        at, chosen, i = pdf["at"].to_numpy(), [], 0
        last = state.get[0] if state.exists else None
        while i < len(at):
            if last is not None:
                i = max(i, int(np.searchsorted(at, last + ttl)))
                if i >= len(at):
                    break
            chosen.append(i)
            last = int(at[i])
            i += 1
        state.update((last,))
        state.setTimeoutTimestamp(max(last + ttl, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000 + 1)
        yield pd.DataFrame({"k": pd.Series([group[0]] * len(chosen), dtype=object), "id": pdf["id"].to_numpy()[chosen], "at": at[chosen]})

    kept = rows.groupBy("k").applyInPandasWithState(keep, f"k {kinds['k']}, id {kinds['id']}, at bigint", "last bigint", "append", "EventTimeTimeout")
    return kept.select(F.col("k").alias(key), F.col("id").alias(row_id), F.col("at").alias("cached_at"))


def cache_misses(events: DataFrame, key: str, row_id: str, ts: str = "ts", ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Sightings that find no cached result: no kept sighting within the TTL before.

    Exact to the microsecond; of sightings at one instant the smallest id counts.
    ``cached_at`` is in microseconds.  A key's sightings are cut into blocks
    wherever none came for a whole TTL, as nothing is cached after that; the cuts
    are found on the first and last sighting per key and TTL.  A block of up to
    ``WALK_ROWS`` sightings is walked in time order, a batch of rows at a time.
    In a longer one every sighting points to the first that finds it expired, and
    the kept ones are those that pointers lead to from the first (``_by_jumps``);
    no task has a block to itself there.
    """
    ttl = ttl_seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    firsts = events.groupBy(F.col(key).alias("k"), at.alias("at")).agg(F.min(row_id).alias("first_id"))
    firsts = firsts.withColumn("bin", F.floor(F.col("at") / ttl))
    edges = firsts.groupBy("k", "bin").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    before = Window.partitionBy("k").orderBy("bin")
    gap = F.col("lo") - F.lag("hi").over(before)
    cuts = edges.withColumn("new", F.when(gap < ttl, 0).otherwise(1)).select(
        F.col("k").alias("k2"), F.col("bin").alias("bin2"), F.sum("new").over(before).alias("block")
    )
    placed = firsts.join(cuts, F.col("k").eqNullSafe(F.col("k2")) & (F.col("bin") == F.col("bin2"))).select("k", "block", "at", "first_id")
    placed = stage(placed, "sightings")
    long = placed.groupBy("k", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WALK_ROWS).select(F.col("k").alias("k2"), F.col("block").alias("block2"))
    long = stage(long, "long-blocks")  # one row per WALK_ROWS sightings at most
    is_long = F.col("k").eqNullSafe(F.col("k2")) & (F.col("block") == F.col("block2"))
    kept = _walked(placed.join(long, is_long, "left_anti"), ttl)
    if not long.isEmpty():
        kept = kept.unionByName(_by_jumps(placed.join(long, is_long, "left_semi"), ttl))
    return kept.select(F.col("k").alias(key), F.col("first_id").alias(row_id), F.col("at").alias("cached_at"))


def _walked(placed: DataFrame, ttl: int) -> DataFrame:
    """Kept sightings of blocks, each walked through by one task."""
    ordered = placed.repartition("k", "block").sortWithinPartitions("k", "block", "at")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            at = pdf["at"].to_numpy()
            group = pdf[["k", "block"]].ne(pdf[["k", "block"]].shift()).any(axis=1).to_numpy()
            group &= ~(pdf["k"].isna() & pdf["k"].shift().isna() & (pdf["block"] == pdf["block"].shift())).to_numpy()
            group[0] = True
            starts = np.flatnonzero(group)
            chosen = []
            for start, end in zip(starts, [*starts[1:], len(pdf)]):
                name = (None if pd.isna(pdf["k"].iloc[start]) else pdf["k"].iloc[start], pdf["block"].iloc[start])
                if name != current:
                    current, kept = name, None
                i = start
                while i < end:
                    if kept is not None:  # jump to the first sighting after expiry
                        i = start + int(np.searchsorted(at[start:end], kept + ttl))
                        if i >= end:
                            break
                    chosen.append(i)
                    kept = at[i]
                    i += 1
            yield pdf.iloc[chosen]

    return ordered.mapInPandas(walk, ordered.schema)


def _next_sightings(placed: DataFrame, ttl: int) -> DataFrame:
    """k, block, n, p, next, at, first_id: sightings numbered from 0, and the number of the first one ``ttl`` later or more.

    Every sighting asks at its own time plus the TTL.  Among sightings and
    questions in one order of time, question p has p questions before it, so
    what else is before it are the sightings that are too early.
    """
    numbered = stage(number_rows(placed, ["at"], ["k", "block"], "p", "n"), "numbered")
    # A question stands before the sightings of its instant.
    asked = numbered.select("k", "block", (F.col("at") + F.lit(ttl)).alias("t"), F.lit(0).alias("kind"), "n", "p", "at", "first_id")
    seen = numbered.select("k", "block", F.col("at").alias("t"), F.lit(1).alias("kind"), "n", "p", "at", "first_id")
    both = number_rows(stage(asked.unionAll(seen), "questions"), ["t", "kind"], ["k", "block"], "u").where("kind = 0")
    return both.select("k", "block", "n", "p", (F.col("u") - F.col("p")).alias("next"), "at", "first_id")


def _by_jumps(placed: DataFrame, ttl: int) -> DataFrame:
    """Kept sightings by pointer doubling, for blocks of any length.

    After round i the marks are the sightings at most 2**i - 1 jumps from the
    first, and a pointer spans 2**i jumps.  A round joins on the number of a sighting,
    of which there is one each, and is written before the next one; there are
    as many rounds as the longest chain of kept sightings has binary digits.
    """
    nodes = stage(_next_sightings(placed, ttl), "nodes")
    jumps = nodes.where("next < n").select("k", "block", "p", "next")  # the others lead nowhere
    marks = nodes.where("p = 0").select("k", "block", "p")
    same = lambda left, right: F.col("k").eqNullSafe(F.col("k2")) & (F.col("block") == F.col("block2")) & (F.col(left) == F.col(right))
    while True:
        target = jumps.select(F.col("k").alias("k2"), F.col("block").alias("block2"), F.col("p").alias("p2"), F.col("next").alias("next2"))
        reached = stage(marks.join(target, same("p", "p2")).select("k", "block", F.col("next2").alias("p")), "reached")
        if reached.isEmpty():
            break
        marks = stage(marks.unionByName(reached), "marks")
        jumps = stage(jumps.join(target, same("next", "p2")).select("k", "block", "p", F.col("next2").alias("next")), "jumps")
    chosen = marks.select(F.col("k").alias("k2"), F.col("block").alias("block2"), F.col("p").alias("p2"))
    return nodes.join(chosen, same("p", "p2"), "left_semi").select("k", "block", "at", "first_id")
