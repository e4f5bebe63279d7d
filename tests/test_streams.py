"""Streams over a backlog of many files, the newest events first."""

import datetime as dt
import os
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusmill import plans
from corpusmill.streaming import ingest


def backlog(folder, n_files):
    """events.parquet of n_files files in reverse order of time."""
    rng = random.Random(n_files)
    start, step = dt.datetime(2024, 1, 1), dt.timedelta(days=20 if n_files < 10 else 1)
    events = [[(100 * i + k, k % 3, "click" if k % 2 else "view", start + i * step + dt.timedelta(seconds=rng.randrange(80_000))) for k in range(24)] for i in range(n_files)]
    (folder / "events.parquet").mkdir(parents=True)
    for n, rows in enumerate(reversed(events)):
        ids, users, kinds, times = zip(*rows, strict=True)
        table = pa.table({"event_id": pa.array(ids, pa.int64()), "user_id": pa.array(users, pa.int64()), "event_type": kinds, "ts": pa.array(times, pa.timestamp("us"))})
        pq.write_table(table, folder / "events.parquet" / f"part-{n:05}.parquet")
    return [r for rows in events for r in rows]


@pytest.mark.parametrize(("n_files", "at_a_time"), [(200, 64), (5, 1)])
def test_no_row_of_a_backlog_is_late(spark, tmp_path, monkeypatch, n_files, at_a_time):
    monkeypatch.setattr(ingest, "FILES", at_a_time, raising=False)
    events = backlog(tmp_path, n_files)
    rows = plans.QUERIES["stream_deduplicated"](spark, str(tmp_path)).collect()
    assert Counter((r["event_id"], r["user_id"]) for r in rows) == Counter((e, u) for e, u, _, _ in events)
    rows = plans.QUERIES["stream_check_and_record"](spark, str(tmp_path)).collect()
    times, want = defaultdict(list), set()
    for event, user, kind, at in sorted(events, key=lambda e: (e[3], e[0])):
        ok, times[user, kind] = ingest.admit(times[user, kind], int((at - dt.datetime(2024, 1, 1)).total_seconds()), 86_400, 3)
        want.add((event, ok))
    assert len(rows) == len(events) and {(r["event_id"], r["allowed"]) for r in rows} == want


def test_streams_joined_over_event_time_in_any_order_of_files(spark, tmp_path):
    """Files in the reverse order of time give what a batch join gives."""
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.randrange(5), rng.choice(["click", "purchase"]), start + dt.timedelta(minutes=30 * i + rng.randrange(60))) for i in range(120)]
    for n, at in enumerate(range(100, -1, -20)):
        spark.createDataFrame(rows[at : at + 20], "event_id long, user_id long, event_type string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sides = [stream.filter(F.col("event_type") == kind).select("user_id", "event_id", "ts") for kind in ("click", "purchase")]
    pairs = ingest.joined_in_time(*sides, ["user_id"], "ts", "6 hours", "3 days")
    got = sorted((r["user_id"], r["left_event_id"], r["right_event_id"]) for r in ingest.collected(pairs, "append", f"file://{tmp_path}/out").collect())
    want = sorted((a[1], a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] == "click" and b[2] == "purchase" and dt.timedelta(0) < b[3] - a[3] <= dt.timedelta(hours=6))
    assert got == want and len(got) > 30


def test_a_rate_limit_calls_by_groups_of_keys(spark, tmp_path):
    """Three hundred keys take four rows of state; nulls, large ids and times in micros stay what they are."""
    rng, start = random.Random(9), dt.datetime(2024, 1, 1)
    keys = [(None if k == 0 else 2**53 + k, start + dt.timedelta(microseconds=k % 2)) for k in range(300)]
    events = [(None if i == 7 else 2**53 + i, *rng.choice(keys[: 300 if i % 2 else 20]), None if i == 11 else start + dt.timedelta(minutes=i)) for i in range(3000)]
    for n in range(0, 3000, 600):
        part = [c for c in zip(*events[n : n + 600], strict=True)]
        table = pa.table({"event_id": pa.array(part[0], pa.int64()), "user_id": pa.array(part[1], pa.int64()), "since": pa.array(part[2], pa.timestamp("us", "UTC")), "ts": pa.array(part[3], pa.timestamp("us", "UTC"))})
        (tmp_path / "in").mkdir(exist_ok=True)
        pq.write_table(table, tmp_path / "in" / f"{n:05}.parquet")
        os.utime(tmp_path / "in" / f"{n:05}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema("event_id long, user_id long, since timestamp, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = f"file://{tmp_path}/out"
    limited = ingest.check_and_record(stream, ["user_id", "since"], "ts", "event_id", 7200, 3, groups=4)
    rows = ingest.collected(limited, "append", out).selectExpr("event_id", "user_id", "unix_micros(since) % 1000000 AS since", "allowed").collect()
    times, want = defaultdict(list), Counter()
    for event, user, since, at in events:
        ok = False
        if at is not None:
            ok, times[user, since] = ingest.admit(times[user, since], round((at - start).total_seconds()), 7200, 3)
        want[event, user, since.microsecond, ok] += 1
    assert Counter(map(tuple, rows)) == want and len({r["allowed"] for r in rows}) == 2
    checkpoint = next((tmp_path / "out").glob("checkpoint-*"))
    assert 0 < spark.read.format("statestore").load(f"file://{checkpoint}").count() <= 4
