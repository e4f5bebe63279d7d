"""Jobs as a stream give what a loop over their events gives, whatever the batches; leases run out by themselves."""

import datetime as dt
import os
import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusmill import plans
from corpusmill.streaming import ingest, leases

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SECOND = 1_000_000


def plain(events, lease, until):
    """Every change of state, by a loop over the events in the order of time; leases that end by ``until`` have ended."""
    out, jobs = [], {}
    for at, number, job, kind, owner in [*sorted(events), (until, None, None, None, None)]:
        for j, (state, holder, end) in list(jobs.items()):
            if state == "running" and end <= at and (j == job or job is None):
                jobs[j] = ("interrupted", None, 0)
                out.append((j, end, "interrupted", holder))
        if job is None:
            break
        state, holder, _ = jobs.get(job, (None, None, 0))
        new = None
        if kind == "create" and state is None:
            new = ("queued", None, 0)
        elif kind == "claim" and state in ("queued", "interrupted"):
            new = ("running", owner, at + lease)
        elif kind == "cancel" and state in ("queued", "running", "interrupted"):
            new = ("cancelled", None, 0)
        elif state == "running" and owner == holder and kind in ("heartbeat", "complete", "fail"):
            new = {"heartbeat": ("running", owner, at + lease), "complete": ("succeeded", None, 0), "fail": ("failed", None, 0)}[kind]
        if new:
            jobs[job] = new
            if new[0] != state:
                out.append((job, at, new[0], new[1]))
    return sorted(out)


def test_jobs_of_a_stream_are_those_of_a_loop(spark, tmp_path):
    rng = random.Random(3)
    base, lease, events = int(START.timestamp()) * SECOND, 60, []
    for j in range(30):
        at = rng.randrange(300)
        events.append((base + at * SECOND, len(events), f"j{j}", "create", None))
        for _ in range(rng.randrange(9)):
            at += rng.choice([5, 20, 59, 60, 61, 200])
            events.append((base + at * SECOND, len(events), f"j{j}", rng.choice(["claim", "claim", "heartbeat", "heartbeat", "complete", "fail", "cancel"]), rng.choice(["a", "b"])))
    events.append((base + 10_000 * SECOND, len(events), "last", "create", None))
    want = plain(events, lease * SECOND, base + 9_990 * SECOND)
    assert sum(r[2] == "interrupted" for r in want) > 4
    folder = tmp_path / "in"
    folder.mkdir()
    rows = sorted(events)
    for n in range(0, len(rows), 25):
        part = rows[n : n + 25]
        columns = {"job_id": [r[2] for r in part], "event_id": [r[1] for r in part], "kind": [r[3] for r in part], "owner": pa.array([r[4] for r in part], pa.string()), "ts": pa.array([r[0] for r in part], pa.timestamp("us", "UTC")), "at_micros": [r[0] for r in part]}
        pq.write_table(pa.table(columns), f"{folder}/{n:05d}.parquet")
        os.utime(f"{folder}/{n:05d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))  # streams take files by their time
    stream = spark.readStream.schema("job_id string, event_id long, kind string, owner string, ts timestamp, at_micros long").option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = leases.transitions(stream, f"file://{tmp_path}/out", lease, "10 seconds").collect()
    assert sorted((r["job_id"], r["at_micros"], r["state"], r["owner"]) for r in got) == want
    assert spark.conf.get(leases.PROVIDER, None) != leases.ROCKS and ingest.OVERLAP


def test_the_query_gives_what_a_loop_gives(spark):
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("the data folder isn't here")
    events = []
    for r in pq.read_table(folder / "events.parquet").to_pylist():
        at, job = round((r["ts"].replace(tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1)), f"{r['user_id']}/{r['ts']:%Y-%m-%d}"
        events += [(at, 2 * r["event_id"], job, "create", None), (at, 2 * r["event_id"] + 1, job, plans.streams.KINDS.get(r["event_type"], "heartbeat"), "worker")]
    end = max(e[0] for e in events) - SECOND
    got = sorted((r["job_id"], r["at_micros"], r["state"], r["owner"]) for r in plans.QUERIES["stream_job_leases"](spark, str(folder)).collect())
    want = plain(events, 21_600 * SECOND, end)
    assert got == want and {r[2] for r in want} == {"queued", "running", "interrupted", "succeeded", "failed"}


def test_jobs_of_a_group_share_a_row_of_state_and_a_timer(spark, tmp_path):
    """Two hundred jobs in three groups take three rows; leases that end at the watermark have ended, later ones haven't."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    base, lease, events = int(START.timestamp()) * SECOND, 60, []
    for j in range(200):
        at = rng.randrange(300)
        events.append((base + at * SECOND, len(events), f"j{j}", "create", None))
        for _ in range(rng.randrange(6)):
            at += rng.choice([5, 20, 59, 60, 61])
            events.append((base + at * SECOND, len(events), f"j{j}", rng.choice(["claim", "claim", "heartbeat", "complete", "fail", "cancel"]), rng.choice(["a", "b", None])))
    for job, at in (("k0", 929), ("k1", 930), ("k2", 931), ("l0", 930)):
        events += [(base + at * SECOND, len(events), job, "create", None), (base + at * SECOND, len(events) + 1, job, "claim", "a")]
    events.append((base + 1_000 * SECOND, len(events), "k9", "create", None))
    want = plain(events, lease * SECOND, base + 990 * SECOND)
    (tmp_path / "in").mkdir()
    for n, part in enumerate([sorted(events)[n : n + 100] for n in range(0, len(events), 100)]):
        columns = {"job_id": [r[2] for r in part], "event_id": [r[1] for r in part], "kind": [r[3] for r in part], "owner": pa.array([r[4] for r in part], pa.string()), "ts": pa.array([r[0] for r in part], pa.timestamp("us", "UTC")), "at_micros": [r[0] for r in part]}
        pq.write_table(pa.table(columns), f"{tmp_path}/in/{n:05d}.parquet")
        os.utime(f"{tmp_path}/in/{n:05d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema("job_id string, event_id long, kind string, owner string, ts timestamp, at_micros long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rows = leases.transitions(stream, f"file://{tmp_path}/out", lease, "10 seconds", F.substring("job_id", 1, 1)).collect()
    got = [(r["job_id"], r["at_micros"], r["state"], r["owner"]) for r in rows]
    key = lambda r: (r[0], r[1], r[2], r[3] or "")
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[0] for r in want if r[0][0] in "kl" and r[2] == "interrupted"} == {"k0", "k1", "l0"}
    checkpoint = next((tmp_path / "out").glob("checkpoint-*"))
    assert spark.read.format("statestore").option("stateVarName", "jobs").load(f"file://{checkpoint}").count() == 3
