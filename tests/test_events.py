"""Event aggregates: batch against loops, streams against batch."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.streaming import ingest, usage

START = datetime(2024, 3, 1)


def events(spark, n=600, seed=1, keys=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(keys)}"
        rows.append((i, START + timedelta(milliseconds=rng.randrange(6 * 3600 * 1000)), key, rng.random() < 0.8, rng.random()))
    return rows, spark.createDataFrame(rows, "event_id long, ts timestamp, endpoint string, ok boolean, duration double")


def test_cache_misses_match_a_loop(spark):
    rows, df = events(spark)
    for ttl in (1, 60, 3600, 10**6):
        found = {r["event_id"] for r in usage.cache_misses(df.repartition(5), "endpoint", "event_id", ttl_seconds=ttl).collect()}
        expected, kept = set(), {}
        firsts = {}
        for i, ts, key, *_ in rows:
            firsts[(key, ts)] = min(i, firsts.get((key, ts), i))
        for (key, ts), i in sorted(firsts.items()):
            if key not in kept or ts - kept[key] >= timedelta(seconds=ttl):
                kept[key] = ts
                expected.add(i)
        assert found == expected


def test_cache_misses_count_microseconds(spark):
    times = [timedelta(seconds=0.9), timedelta(seconds=3600.1), timedelta(seconds=3600.9), timedelta(seconds=3600.95), timedelta(seconds=99_999)]
    rows = [(9 - i, START + t, key) for key in ("a", None) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, endpoint string")
    found = usage.cache_misses(df, "endpoint", "event_id").collect()
    assert sorted((r["endpoint"] or "", r["event_id"]) for r in found) == [(k, i) for k in ("", "a") for i in (5, 7, 9)]


def test_cache_misses_across_arrow_batches(spark):
    _, df = events(spark, 2000)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = sorted(r["event_id"] for r in usage.cache_misses(df, "endpoint", "event_id", ttl_seconds=90).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        parts = sorted(r["event_id"] for r in usage.cache_misses(df, "endpoint", "event_id", ttl_seconds=90).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert whole == parts


def loop_misses(rows, ttl):
    """event_id of the kept sightings, key by key."""
    kept, out = {}, set()
    for i, ts, key in sorted(rows, key=lambda r: (r[1], r[0])):
        if key not in kept or ts - kept[key] >= timedelta(seconds=ttl):
            kept[key] = ts
            out.add(i)
    return out


def test_jumps_give_what_the_walk_gives(spark, monkeypatch):
    """A key with a sighting every second, one without a key, and quiet keys, at several lifetimes."""
    rng = random.Random(8)
    rows = [(i, START + timedelta(seconds=i), "steady") for i in range(3000)]
    rows += [(5000 + i, START + timedelta(seconds=rng.randrange(4000), microseconds=rng.randrange(3)), None) for i in range(1500)]
    rows += [(9000 + i, START + timedelta(seconds=rng.randrange(10**6)), f"k{i % 40}") for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, endpoint string").repartition(6)
    monkeypatch.setattr(usage, "WALK_ROWS", 100)
    for ttl in (1, 7, 600, 10**5):
        found = [r["event_id"] for r in usage.cache_misses(df, "endpoint", "event_id", ttl_seconds=ttl).collect()]
        assert len(found) == len(set(found)) and set(found) == loop_misses(rows, ttl)


def test_no_task_walks_a_long_block(spark, monkeypatch):
    monkeypatch.setattr(usage, "WALK_ROWS", 200)
    rows = [(i, START + timedelta(seconds=i), "steady") for i in range(20_000)] + [(30_000 + i, START + timedelta(days=i), "calm") for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, endpoint string").repartition(6)
    walked, ranges = [], []
    walk, number = usage._walked, usage.number_rows
    monkeypatch.setattr(usage, "_walked", lambda placed, ttl: walked.append(placed) or walk(placed, ttl))
    monkeypatch.setattr(usage, "number_rows", lambda d, *a: ranges.append((d, [*a[1], *a[0]])) or number(d, *a))
    found = usage.cache_misses(df, "endpoint", "event_id", ttl_seconds=900)
    assert {r["event_id"] for r in found.collect()} == loop_misses(rows, 900)
    assert max(r["count"] for r in walked[0].groupBy("k", "block").count().collect()) <= 200
    # The long block is dealt over the ranges that the numbering sorts, about evenly.
    data, keys = ranges[0]
    shares = [r["count"] for r in data.repartitionByRange(8, *keys).groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) >= 7 and max(shares) <= 2 * sum(shares) / len(shares)


def stream_of(spark, df, folder, files=1):
    df.repartition(files).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def finish(stream, tmp_path, mode="append"):
    target = str(tmp_path / f"out-{mode}")

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    running = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).foreachBatch(store).start()
    )
    running.awaitTermination()
    return stream.sparkSession.read.parquet(target)


def test_usage_stream_equals_batch(spark, tmp_path):
    _, df = events(spark)
    batch = usage.usage_metrics(df)
    # One more event far ahead closes every window of the others.
    ahead = spark.createDataFrame([(10**6, START + timedelta(days=30), "late", True, 0.0)], df.schema)
    live = usage.usage_metrics(stream_of(spark, df.unionAll(ahead), str(tmp_path / "in"), files=1))
    closed = finish(live, tmp_path).drop("batch").filter("endpoint <> 'late'")
    columns = sorted(batch.columns)
    rounded = lambda t: t.withColumn("average_response_time", F.round("average_response_time", 9)).select(columns)
    assert rounded(closed).exceptAll(rounded(batch)).isEmpty() and rounded(batch).exceptAll(rounded(closed)).isEmpty()


def test_late_events_drop(spark, tmp_path):
    schema = "event_id long, ts timestamp, endpoint string, ok boolean, duration double"
    folder = str(tmp_path / "in")
    row = lambda i, minutes: (i, START + timedelta(minutes=minutes), "a", True, 1.0)
    live = None
    for n, minutes in enumerate((0, 300, 5, 900)):  # the third comes far behind the watermark
        spark.createDataFrame([row(n, minutes)], schema).coalesce(1).write.mode("append").parquet(folder)
        live = usage.usage_metrics(spark.readStream.schema(schema).parquet(folder))
        out = finish(live, tmp_path)
    assert out.filter(F.col("window_start") == F.lit(START)).agg(F.sum("total_requests")).first()[0] == 1


def test_quota(spark):
    rows = [(i, START + timedelta(seconds=i // 3), 7) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    found = usage.quotas(df, limit=100).orderBy("window_start").collect()
    assert [(r["used"], r["remaining"], r["over_limit"]) for r in found] == [(180, 0, True), (20, 80, False)]
    assert found[0]["reset_time"] == START + timedelta(minutes=1)
    sliding = usage.quotas(df, window="1 minute", slide="30 seconds")
    assert sliding.agg(F.sum("used")).first()[0] == 400


def test_job_status_stream(spark, tmp_path):
    schema = "job_id string, status string, done long, total long, ts timestamp"
    rows = [("j1", "pending", 0, 10, 0), ("j1", "running", 4, 10, 5), ("j2", "failed", 1, 0, 3), ("j1", "paused", 9, 10, 9), ("j2", "running", 0, 0, 1)]
    df = spark.createDataFrame([(j, s, d, t, START + timedelta(seconds=at)) for j, s, d, t, at in rows], schema)
    batch = {r["job_id"]: r for r in usage.job_status(df).collect()}
    assert (batch["j1"]["status"], batch["j1"]["progress"]) == ("running", 0.4)
    assert (batch["j2"]["status"], batch["j2"]["progress"]) == ("failed", None)
    updates = finish(usage.job_status(stream_of(spark, df, str(tmp_path / "in"), 5)), tmp_path, "update")
    last = updates.groupBy("job_id").agg(F.max_by("status", "batch").alias("status"))
    assert {r["job_id"]: r["status"] for r in last.collect()} == {j: r["status"] for j, r in batch.items()}


def test_first_within_ttl_stream(spark, tmp_path):
    rows = [(0, START, "a"), (1, START + timedelta(seconds=5), "a"), (2, START + timedelta(seconds=7), "b")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, endpoint string").coalesce(1).sortWithinPartitions("event_id")
    live = usage.first_within_ttl(stream_of(spark, df, str(tmp_path / "in")), "endpoint", ttl_seconds=3600)
    assert sorted(r["endpoint"] for r in finish(live, tmp_path).collect()) == ["a", "b"]


def test_cache_misses_stream_equals_batch(spark, tmp_path):
    """Events in order, cut into batches anywhere: also where a key comes back after its state has timed out."""
    rng = np.random.default_rng(4)
    at = np.sort(rng.integers(0, 40 * 3600, 900))
    keys = [None if k == 5 else f"k{k}" for k in rng.integers(0, 6, len(at))]
    rows = [(i, START + timedelta(seconds=int(s)), k) for i, (s, k) in enumerate(zip(at, keys))] + [(900, START + timedelta(hours=60), "k1"), (901, None, "k1")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, endpoint string")
    batch = {tuple(r) for r in usage.cache_misses(df.where("ts is not null"), "endpoint", "event_id").collect()}
    source = tmp_path / "in"
    for n, (low, high) in enumerate([(0, 1), (1, 400), (400, 401), (401, 850), (850, 902)]):
        part = df.where(f"event_id >= {low} and event_id < {high}").coalesce(1)
        part.write.parquet(str(tmp_path / f"part{n}"))
        source.mkdir(exist_ok=True)
        for k, file in enumerate(sorted((tmp_path / f"part{n}").glob("*.parquet"))):
            target = source / f"{n}-{k}.parquet"
            target.write_bytes(file.read_bytes())
            os.utime(target, (1_000_000_000 + 60 * n, 1_000_000_000 + 60 * n))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    found = finish(usage.cache_misses_stream(stream, "endpoint", "event_id"), tmp_path).drop("batch")
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == batch and any(k is None for k, *_ in batch)


def test_ingest_directory(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "five.csv").write_text('smiles,activity,name\nCCO,1.5,a\nCC(=O)O,2,"b, c"\ninvalid_smiles,3,d\nc1ccccc1,,e\nCCN,5,f\n')
    (inbox / "nokey.csv").write_text("a,b\n1,2\n")
    (inbox / "empty.csv").write_text("\n")
    (inbox / "notes.txt").write_text("smiles\nCCO\n")
    (inbox / "large.csv").write_text("smiles\n" + "CCO\n" * 5000)
    (inbox / "ragged.csv").write_text("smiles,n\nCCO,1,2\nCCN,2\n")
    (inbox / "header.csv").write_text("smiles,n\n")
    results, status, state = (str(tmp_path / n) for n in ("results", "status", "state"))

    def run():
        ingest.ingest_directory(spark, str(inbox), results, status, state).awaitTermination()
        return {r["file"].rsplit("/", 1)[1]: r for r in spark.read.parquet(status).collect()}

    found = run()
    assert {n: r["status"] for n, r in found.items()} == {
        "five.csv": "completed", "nokey.csv": "failed", "empty.csv": "failed", "notes.txt": "failed", "large.csv": "completed",
        "ragged.csv": "completed", "header.csv": "completed",
    }
    assert found["large.csv"]["valid_rows"] == 5000 and found["header.csv"]["total_rows"] == 0
    assert (found["ragged.csv"]["valid_rows"], found["ragged.csv"]["invalid_rows"]) == (1, 1)
    assert found["nokey.csv"]["error"] == "column 'smiles' not found"
    five = found["five.csv"]
    assert (five["total_rows"], five["valid_rows"], five["invalid_rows"]) == (5, 4, 1)
    stored = spark.read.parquet(results).filter("smiles = 'CC(=O)O'").first()
    assert stored["fields"] == {"activity": "2", "name": "b, c"}
    (inbox / "second.csv").write_text("smiles\nCCO\n")
    again = run()
    assert len(again) == 8 and again["second.csv"]["valid_rows"] == 1
    assert spark.read.parquet(results).filter("error IS NULL").count() == 5007


def test_streams_read_tables_of_several_files(spark, tmp_path):
    """A table may be a folder of part files."""
    from assayer.plans import checks_events

    turns = [(c, t, ("system", "user", "assistant")[min(t, 1 + t % 2)], "x") for c in range(40) for t in range(1 + c % 5)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, START)], "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet.old")
    assert len(list((tmp_path / "conversations.parquet").glob("part-*"))) > 1
    got = {r["conv_id"]: (r["status"], r["processed"]) for r in checks_events.latest_turns_stream(spark, str(tmp_path)).collect()}
    assert got == {c: (role, t) for c, t, role, _ in turns}
    seen = [(i % 7, START + timedelta(seconds=i)) for i in range(90)]
    spark.createDataFrame(seen, "user_id long, ts timestamp").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    used = checks_events.quotas_stream(spark, str(tmp_path))
    assert used.agg(F.sum("used")).first()[0] == 90
