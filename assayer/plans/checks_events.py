"""Checked queries: event aggregates, in batch form and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ingest, usage
from .checks_tables import VALID_SQL, scratch
from .derived import JOB_UPDATES_SQL, compounds, job_updates, read
from .registry import REGISTRY, rounded, stamp

query = REGISTRY.add

_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
_COUNTS = """count(*) AS total_requests, count(*) FILTER (WHERE event_type <> 'error') AS successful_requests, count(*) FILTER (WHERE event_type = 'error') AS failed_requests,
    round(avg(value), 9) AS average_response_time, max(value) AS max_response_time"""


def _requests(events):
    return events.withColumn("ok", F.col("event_type") != "error")


USAGE_SQL = f"""SELECT event_type, strftime(date_trunc('hour', ts), {_STAMP}) AS window_start, {_COUNTS}, strftime(max(ts), {_STAMP}) AS last_request
    FROM events GROUP BY event_type, date_trunc('hour', ts)"""


def _usage_columns(table):
    out = table.withColumns({"window_start": stamp("window_start"), "last_request": stamp("last_request")})
    return rounded(out, average_response_time=9)


@query("usage_metrics", USAGE_SQL)
def usage_metrics(spark, folder):
    return _usage_columns(usage.usage_metrics(_requests(read(spark, folder, "events")), "event_type", duration="value"))


def _as_stream(spark, folder, table):
    """A table as a stream, be it one file or a folder of part files; a path in brackets may be either."""
    schema = read(spark, folder, table).schema
    return spark.readStream.schema(schema).option("basePath", folder).parquet(f"{folder}/{table}.parque[t]")


def _run(stream, spark, name, mode="update"):
    """Run a stream over everything there is; the last update of each key wins."""
    target = scratch(spark, name)

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    running = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, f"{name}-state"))
        .trigger(availableNow=True).foreachBatch(store).start()
    )
    running.awaitTermination()
    return spark.read.parquet(target)


@query("usage_metrics_stream", USAGE_SQL)
def usage_metrics_stream(spark, folder):
    """The same aggregate as a stream with a watermark."""
    live = usage.usage_metrics(_requests(_as_stream(spark, folder, "events")), "event_type", duration="value")
    seen = _run(live, spark, "usage")
    newest = seen.groupBy("event_type", "window_start").agg(F.max_by(F.struct(*[c for c in seen.columns if c not in ("event_type", "window_start", "batch")]), "batch").alias("s"))
    return _usage_columns(newest.select("event_type", "window_start", "s.*"))


@query(
    "overall_usage",
    """SELECT count(*) AS total_requests, count(*) FILTER (WHERE event_type <> 'error') AS successful_requests, count(*) FILTER (WHERE event_type = 'error') AS failed_requests,
        round(100.0e0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate, round(avg(value), 6) AS average_response_time FROM events""",
)
def overall_usage(spark, folder):
    per_endpoint = usage.usage_metrics(_requests(read(spark, folder, "events")), "event_type", duration="value", window=None)
    return rounded(usage.overall_usage(per_endpoint), error_rate=6, average_response_time=6)


@query(
    "usage_by_method_and_path",
    f"""SELECT event_type, user_id % 5 AS path, {_COUNTS} FROM events GROUP BY ALL""",
)
def usage_by_method_and_path(spark, folder):
    """Two key columns, without windows."""
    requests = _requests(read(spark, folder, "events")).withColumn("path", F.col("user_id") % 5)
    out = usage.usage_metrics(requests, ["event_type", "path"], duration="value", window=None)
    return rounded(out.drop("last_request"), average_response_time=9)


QUOTAS_STREAM_SQL = f"""SELECT user_id, strftime(date_trunc('minute', ts), {_STAMP}) AS window_start, count(*) AS used FROM events GROUP BY ALL"""


@query("quotas_stream", QUOTAS_STREAM_SQL)
def quotas_stream(spark, folder):
    """Quotas as a stream with a watermark."""
    seen = _run(usage.quotas(_as_stream(spark, folder, "events"), limit=2), spark, "quotas")
    newest = seen.groupBy("user_id", "window_start").agg(F.max_by("used", "batch").alias("used"))
    return newest.withColumn("window_start", stamp("window_start"))


@query(
    "latest_turns_stream",
    """SELECT conv_id, arg_max(role, turn) AS status, max(turn) AS processed FROM conversations GROUP BY conv_id""",
)
def latest_turns_stream(spark, folder):
    """The latest state per key as a stream in update mode."""
    turns = _as_stream(spark, folder, "conversations").selectExpr("conv_id", "CASE role WHEN 'user' THEN 'running' WHEN 'assistant' THEN 'completed' ELSE 'pending' END AS status", "turn AS done", "turn AS total", "turn AS ts")
    names = F.create_map(*[F.lit(x) for x in ("running", "user", "completed", "assistant", "pending", "system")])
    seen = _run(usage.job_status(turns, "conv_id"), spark, "turns")
    newest = seen.groupBy("conv_id").agg(F.max_by(F.struct("status", "processed"), "batch").alias("s"))
    return newest.select("conv_id", names[F.col("s.status")].alias("status"), F.col("s.processed").alias("processed"))


@query(
    "quotas",
    f"""SELECT user_id, strftime(w, {_STAMP}) AS window_start, strftime(w + INTERVAL 1 MINUTE, {_STAMP}) AS reset_time, count(*) AS used, CAST(2 AS BIGINT) AS quota,
        CAST(greatest(0, 2 - count(*)) AS BIGINT) AS remaining, count(*) > 2 AS over_limit FROM (SELECT user_id, date_trunc('minute', ts) AS w FROM events) GROUP BY user_id, w""",
)
def quotas(spark, folder):
    used = usage.quotas(read(spark, folder, "events"), limit=2)
    return used.withColumns({"window_start": stamp("window_start"), "reset_time": stamp("reset_time")})


@query(
    "quotas_sliding",
    f"""SELECT user_id, strftime(w, {_STAMP}) AS window_start, count(*) AS used FROM (
        SELECT user_id, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01') - unnest([INTERVAL 0 MINUTE, INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY user_id, w""",
)
def quotas_sliding(spark, folder):
    used = usage.quotas(read(spark, folder, "events"), window="1 hour", slide="30 minutes")
    return used.select("user_id", stamp("window_start").alias("window_start"), "used")


@query(
    "job_status",
    f"""SELECT job_id, arg_max(status, ts) AS status, arg_max(done, ts) AS processed, arg_max(total, ts) AS total,
        round(arg_max(done, ts) / nullif(arg_max(total, ts), 0)::DOUBLE, 6) AS progress, strftime(min(ts), {_STAMP}) AS created_at, strftime(max(ts), {_STAMP}) AS updated_at
        FROM ({JOB_UPDATES_SQL}) WHERE status <> 'unknown' GROUP BY job_id""",
)
def job_status(spark, folder):
    latest = usage.job_status(job_updates(spark, folder), tie="event_id")
    return rounded(latest.withColumns({"created_at": stamp("created_at"), "updated_at": stamp("updated_at")}), progress=6)


@query(
    "latest_turns",
    """SELECT conv_id, arg_max(role, turn) AS status, max(turn) AS processed FROM conversations GROUP BY conv_id""",
)
def latest_turns(spark, folder):
    """The latest row per key on another table, through the same merge."""
    turns = read(spark, folder, "conversations").selectExpr("conv_id", "CASE role WHEN 'user' THEN 'running' WHEN 'assistant' THEN 'completed' ELSE 'pending' END AS status", "turn AS done", "turn AS total", "turn AS ts")
    names = F.create_map(*[F.lit(x) for x in ("running", "user", "completed", "assistant", "pending", "system")])
    return usage.job_status(turns, "conv_id").select("conv_id", names[F.col("status")].alias("status"), "processed")


MISSES_SQL = """WITH RECURSIVE s AS (SELECT user_id AS k, epoch_us(ts) AS us, min(event_id) AS id FROM events GROUP BY ALL),
    kept AS (SELECT k, min(us) AS us FROM s GROUP BY k
        UNION ALL SELECT n.k, n.us FROM (SELECT s.k, min(s.us) AS us FROM kept JOIN s ON s.k = kept.k AND s.us >= kept.us + 86400000000 GROUP BY s.k, kept.us) n)
    SELECT k AS user_id, id AS event_id, us AS cached_at FROM s JOIN kept USING (k, us)"""


@query("cache_misses", MISSES_SQL)
def cache_misses(spark, folder):
    """A result kept for a day, per user."""
    return usage.cache_misses(read(spark, folder, "events"), "user_id", "event_id", ttl_seconds=86400)


@query("cache_misses_stream", MISSES_SQL)
def cache_misses_stream(spark, folder):
    """The same from a stream, with a state per user."""
    live = usage.cache_misses_stream(_as_stream(spark, folder, "events"), "user_id", "event_id", ttl_seconds=86400)
    return _run(live, spark, "misses", "append").drop("batch")


@query(
    "cache_misses_hot_keys",
    """WITH RECURSIVE s AS (SELECT event_type AS k, epoch_us(ts) AS us, min(event_id) AS id FROM events GROUP BY ALL),
        kept AS (SELECT k, min(us) AS us FROM s GROUP BY k
            UNION ALL SELECT n.k, n.us FROM (SELECT s.k, min(s.us) AS us FROM kept JOIN s ON s.k = kept.k AND s.us >= kept.us + 3600000000 GROUP BY s.k, kept.us) n)
        SELECT k AS event_type, id AS event_id, us AS cached_at FROM s JOIN kept USING (k, us)""",
)
def cache_misses_hot_keys(spark, folder):
    """Five keys hold all events."""
    return usage.cache_misses(read(spark, folder, "events"), "event_type", "event_id")


@query(
    "ingest_files",
    f"""SELECT count(DISTINCT row_id % 4) AS files, CAST(count(*) AS BIGINT) AS total_rows, count(*) FILTER (WHERE reject_reason IS NULL) AS valid_rows,
        count(*) FILTER (WHERE reject_reason IS NOT NULL) AS invalid_rows, 'completed' AS status FROM ({VALID_SQL})""",
)
def ingest_files(spark, folder):
    """Four CSV files written from the compounds, taken in by a directory stream."""
    incoming = scratch(spark, "incoming")
    rows = compounds(spark, folder).select("row_id", F.when(F.trim("smiles") != "", F.col("smiles")).alias("smiles"))
    for part in range(4):
        rows.filter(F.col("row_id") % 4 == part).coalesce(1).write.mode("append").option("header", True).csv(incoming)
    results, status = scratch(spark, "results"), scratch(spark, "status")
    ingest.ingest_directory(spark, incoming, results, status, scratch(spark, "ingest-state")).awaitTermination()
    return spark.read.parquet(status).groupBy("status").agg(
        F.count(F.lit(1)).alias("files"), F.sum("total_rows").alias("total_rows"), F.sum("valid_rows").alias("valid_rows"), F.sum("invalid_rows").alias("invalid_rows")
    )


@query(
    "ingest_bad_files",
    f"""SELECT kind, status, files, total_rows, valid_rows FROM (
        SELECT 'good' AS kind, 'completed' AS status, count(DISTINCT row_id % 2) AS files, count(*) AS total_rows, count(*) FILTER (WHERE reject_reason IS NULL) AS valid_rows FROM ({VALID_SQL}) WHERE row_id % 4 < 2
        UNION ALL SELECT 'nokey', 'failed', count(DISTINCT row_id % 4), 0, 0 FROM ({VALID_SQL}) WHERE row_id % 4 = 2
        UNION ALL SELECT 'suffix', 'failed', count(DISTINCT row_id % 4), 0, 0 FROM ({VALID_SQL}) WHERE row_id % 4 = 3)""",
)
def ingest_bad_files(spark, folder):
    """Files without the key column and with a wrong suffix are marked, the others taken."""
    incoming = scratch(spark, "incoming")
    rows = compounds(spark, folder).select("row_id", F.when(F.trim("smiles") != "", F.col("smiles")).alias("smiles"))
    for part, (kind, name) in enumerate([("good", "smiles"), ("good", "smiles"), ("nokey", "structure")]):
        rows.filter(F.col("row_id") % 4 == part).withColumnRenamed("smiles", name).coalesce(1).write.option("header", True).csv(f"{incoming}/{kind}{part}")
    rows.filter("row_id % 4 = 3").select(F.coalesce("smiles", F.lit("-")).alias("value")).coalesce(1).write.text(f"{incoming}/suffix")
    results, status = scratch(spark, "results"), scratch(spark, "status")
    ingest.ingest_directory(spark, f"{incoming}/*", results, status, scratch(spark, "ingest-state")).awaitTermination()
    seen = spark.read.parquet(status).withColumn("kind", F.regexp_extract("file", "/(good|nokey|suffix)[0-9]?/", 1))
    return seen.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("files"), F.sum("total_rows").alias("total_rows"), F.sum("valid_rows").alias("valid_rows"))
