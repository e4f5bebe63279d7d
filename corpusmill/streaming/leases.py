"""Jobs and their leases as state of a stream: an expired lease interrupts its job by itself, by a timer of event time.

Events are create, claim, heartbeat, cancel, complete and fail. A job is queued, then running while its lease holds; a
heartbeat of its owner renews the lease. A lease that runs out makes the job interrupted, and a claim takes it up again.
What doesn't fit a job's state changes nothing. Whether a lease ran out is decided by event time alone, so it doesn't
matter how events are dealt to batches: a later event of the job sees it, and where none comes, the timer does.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.streaming.ingest import GROUPS, collected, dealt

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "job_id string, at_micros bigint, state string, owner string"
COLUMNS = ["job_id", "at_micros", "state", "owner"]
STATE = "ids array<string>, states array<string>, owners array<string>, ends array<bigint>, timer bigint"
ENDED = ("succeeded", "failed", "cancelled")


def moved(now: tuple, kind: str, owner: str | None, at: int, lease: int) -> tuple:
    """A job's (state, owner, end of its lease) after an event; the same if the event doesn't fit."""
    state, holder, expires = now
    if kind == "create":
        return ("queued", None, 0) if state is None else now
    if kind == "claim":
        return ("running", owner, at + lease) if state in ("queued", "interrupted") else now
    if kind == "cancel":
        return ("cancelled", None, 0) if state is not None and state not in ENDED else now
    if state != "running" or owner != holder:
        return now
    return {"heartbeat": ("running", holder, at + lease), "complete": ("succeeded", None, 0), "fail": ("failed", None, 0)}.get(kind, now)


class Jobs(StatefulProcessor):
    """State per group of jobs: what each of them is, who holds it and until when, and the timer of the lease that ends first.

    A call, a read and a write of state cost far more than an event, so they are made once for a batch of a whole group.
    """

    def __init__(self, lease: int):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("jobs", STATE)

    def _read(self) -> tuple[dict, int | None]:
        *columns, timer = self.held.get() or ([], [], [], [], None)
        return {job: now for job, *now in zip(*columns, strict=True)}, timer

    def _write(self, jobs: dict, timer: int | None) -> None:
        """Keeps the jobs, and one timer where a lease is running; ``timer`` is the one that was set before, if it still is."""
        first = min((-(-end // 1000) for state, _, end in jobs.values() if state == "running"), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        states, owners, ends = zip(*jobs.values(), strict=True)
        self.held.update((list(jobs), list(states), list(owners), list(ends), first))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (jobs, timer), out = self._read(), []
        frame = pd.concat(list(rows)).sort_values(["at_micros", "event_id"], kind="stable")
        owners = frame["owner"].astype(object).where(frame["owner"].notna(), None)
        for job, kind, owner, at in zip(frame["job_id"].tolist(), frame["kind"].tolist(), owners.tolist(), frame["at_micros"].tolist(), strict=True):
            then = jobs.get(job, (None, None, 0))
            if then[0] == "running" and then[2] <= at:
                out.append((job, then[2], "interrupted", then[1]))
                then = jobs[job] = ("interrupted", None, 0)
            now = moved(then, kind, owner, at, self.lease)
            if now[0] is not None:
                jobs[job] = now
            if now[0] != then[0]:
                out.append((job, at, now[0], now[1]))
        if jobs:
            self._write(jobs, timer)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Interrupts all jobs of the group whose leases have run out by the watermark, not only the first one's."""
        (jobs, _), out = self._read(), []
        by = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        for job, (state, owner, expires) in jobs.items():
            if state == "running" and expires <= by:
                out.append((job, expires, "interrupted", owner))
        jobs |= {job: ("interrupted", None, 0) for job, *_ in out}
        self._write(jobs, None)  # the timer that fired goes by itself
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def transitions(events: DataFrame, folder: str, lease_seconds: int, late: str, group: Column | None = None) -> DataFrame:
    """job_id, at_micros, state and owner of every change of state, over a stream of job_id, event_id, kind, owner, ts and at_micros.

    ``at_micros`` is ``ts`` in microseconds. Events may come as late as ``late`` says. Leases that hold beyond the watermark
    are still open when the stream ends. State lies in RocksDB, which this kind of state needs; the session's setting is put
    back afterwards.

    ``group``: what the jobs that share a row of state have in common, the same for all events of a job. The row is written
    anew by each batch with events of the group, so its jobs should live at about the same time and be some thousands at
    most. Without it jobs are dealt by their ids to ``GROUPS``, whose rows grow with all jobs there ever were.
    """
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        given = events.withColumn("_group", dealt(F.col("job_id"), GROUPS) if group is None else group)
        given = given.select("_group", "ts", "job_id", "event_id", "kind", F.col("owner").cast("string").alias("owner"), "at_micros")
        moves = given.withWatermark("ts", late).groupBy("_group").transformWithStateInPandas(Jobs(lease_seconds * 1_000_000), OUT, "append", "eventTime")
        return collected(moves, "append", folder)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
