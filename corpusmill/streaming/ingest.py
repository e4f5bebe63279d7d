"""Streams: resumable ingestion, windows over event time, and rate limits with state."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from corpusmill.operators.relations import latest_per_key, upsert
from corpusmill.sources import sinks
from corpusmill.sources.feeds import feed_stream

#: Late rows of so many days are read again.
OVERLAP = "14 days"
#: Files that a batch takes.
FILES = 64
#: Groups that the keys of a rate limit, or jobs, are dealt to; the time of an event that has none.
GROUPS, NEVER = 1024, -(2**63)


def event_stream(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """A Parquet file or folder as a stream; the time column as an instant, which watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}*").withColumn(ts, F.col(ts).cast("timestamp"))


def span(spark: SparkSession, path: str, ts: str = "ts") -> str:
    """A watermark's delay by which no row of what is there comes late, whatever the order of its files."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    seconds = spark.read.parquet(path).agg(F.max(at) - F.min(at)).first()[0]
    return f"{(seconds or 0) + 2} seconds"


def in_order(spark: SparkSession, path: str, folder: str, ts: str = "ts") -> str:
    """A copy of what is there, below ``folder``, that a stream reads in the order of time; rows of one time share a file.

    Streams take files by their time of modification, so the copy's files get times in their order.
    """
    out = f"{folder}/ordered-{uuid.uuid4().hex}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(spark.read.parquet(path).inputFiles()))
    spark.read.parquet(path).repartitionByRange(n, ts).write.parquet(out)
    place = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(place) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    newest = max((fs.getFileStatus(f).getModificationTime() for f in files), default=0)
    for i, f in enumerate(files):
        fs.setTimes(f, newest - 1000 * (len(files) - i), -1)
    return out


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Takes what is there now, in batches, then stops. A second run goes on where this one stopped."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def upsert_sink(folder: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """Merges each batch into the table below ``folder``, bucket by bucket; a batch that comes again changes nothing."""

    def merge(batch: DataFrame, old: DataFrame | None) -> DataFrame:
        fresh = latest_per_key(batch, key, [F.desc(order), *map(F.col, key)])
        if old is None:
            return fresh
        newer = fresh.alias("n").join(old.alias("o"), key, "left").filter(F.col(f"o.{order}").isNull() | (F.col(f"n.{order}") >= F.col(f"o.{order}")))
        return upsert(old, newer.select("n.*"), key, [F.desc(order)])

    return lambda batch, _: sinks.merge_buckets(batch, folder, key, merge)


def run_mode(requested: str, state: dict | None) -> tuple[str, bool, str | None]:
    """full or delta, whether an unfinished run goes on, and where a delta starts: its watermark less the overlap.

    ``state``: mode, complete and watermark (an ISO date) of the last run, or None. A run that goes on has its start.
    """
    if requested not in ("auto", "full", "delta"):
        raise ValueError("The mode must be auto, full or delta.")
    state = state or {}
    mode = requested if requested != "auto" else "delta" if state.get("complete") else "full"
    mode = "full" if mode == "delta" and not state.get("watermark") else mode
    resumes = bool(state) and not state.get("complete") and state.get("mode") == mode
    start = None
    if mode == "delta" and not resumes:
        start = (dt.date.fromisoformat(state["watermark"]) - dt.timedelta(days=int(OVERLAP.split()[0]))).isoformat()
    return mode, resumes, start


def delta_page(rows: DataFrame, mode: str, size: int, last_key: tuple | None, start: str | None, id_: str = "violation_id", status: str = "status_date") -> DataFrame:
    """The next page of a feed: by id for a full run, by time of status and id for a delta, after the last page's key.

    Times are compared in full, so a page that one day fills doesn't come again.
    """
    if mode == "full":
        wanted = rows if last_key is None else rows.filter(F.col(id_) > last_key[-1])
        return wanted.orderBy(id_).limit(size)
    if last_key is None:
        wanted = rows.filter(F.col(status) >= F.lit(start).cast("timestamp_ntz"))
    else:
        at = F.lit(last_key[0]).cast("timestamp_ntz")
        wanted = rows.filter((F.col(status) > at) | ((F.col(status) == at) & (F.col(id_) > last_key[1])))
    return wanted.orderBy(status, id_).limit(size)


def ingest_feed(spark: SparkSession, path: str, folder: str, mode: str = "auto", id_: str = "violation_id", status: str = "status_date") -> dict:
    """Takes a feed into a table of buckets as a stream of keys, in one pass over what is new, and returns the state.

    A full run reads in the order of ids, a delta in that of status and id from some time before the watermark on. A run
    that stops anywhere goes on with its own checkpoint: a batch that was begun comes again with the same rows, and merging
    it again changes nothing. The log has a row per batch: run, batch, rows and a checksum. The watermark, the day of the
    latest status, moves only when a run is complete. Rows with a null id or, in a delta, a null status have no place.
    """
    state = sinks.latest(spark, f"{folder}/state") or {}
    chosen, resumes, start = run_mode(mode, state or None)
    run = {"run": state["run"], "start": state["start"]} if resumes else {"run": uuid.uuid4().hex, "start": start}
    now = {"mode": chosen, "complete": False, "watermark": state.get("watermark"), "generation": run["run"], **run}
    if not resumes:
        sinks.commit(spark, f"{folder}/state", now)
    merge = upsert_sink(f"{folder}/table", [id_], status)
    log = f"{folder}/log"

    def sink(batch: DataFrame, number: int) -> None:
        merge(batch, number)
        row = batch.agg(F.count("*").alias("rows"), F.max(status).alias("seen"), F.sum(F.xxhash64(*batch.columns).cast("decimal(38,0)")).cast("string").alias("checksum"))
        sinks.append_log(row.select(F.lit(run["run"]).alias("run"), F.lit(number).cast("long").alias("batch"), "*"), log, "run", "batch")

    rows = feed_stream(spark, path, [id_] if chosen == "full" else [status, id_], run["start"])
    for _ in range(2 if resumes else 1):  # a run that goes on repeats the batch that was begun, and then takes the rest
        run_once(rows, f"{folder}/checkpoints/{run['run']}", sink)
    mine = spark.read.parquet(log).filter(F.col("run") == run["run"]) if sinks.exists(spark, log) else None
    seen, taken = mine.agg(F.max("seen"), F.coalesce(F.sum("rows"), F.lit(0))).first() if mine else (None, 0)
    now |= {"complete": True, "rows": taken, "watermark": max(filter(None, (now["watermark"], seen and seen.date().isoformat())), default=None)}
    sinks.commit(spark, f"{folder}/state", now)
    return now


def deduplicated(stream: DataFrame, key: str, ts: str, late: str = OVERLAP) -> DataFrame:
    """Redelivered rows dropped for as long as they may still come; a replay of a backlog names its ``span``."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, ts: str, width: str, *by: str, late: str = OVERLAP) -> DataFrame:
    """Counts per window and group; the watermark lets finished windows go."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), *by, "n")


def changed_counts(stream: DataFrame, folder: str, *by: str) -> DataFrame:
    """Every change of the counts by group, in the order of batches: group, n and batch. Groups that stay the same write nothing."""
    counts, out = stream.groupBy(*by).agg(F.count("*").alias("n")), f"{folder}/changes-{uuid.uuid4().hex}"
    write = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)
    run_once(counts, f"{folder}/checkpoint-{uuid.uuid4().hex}", write, "update")
    return stream.sparkSession.read.parquet(out)


def sliding(stream: DataFrame, ts: str, width: str, step: str, *by: str, late: str = OVERLAP) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, step).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), *by, "n")


def joined_in_time(left: DataFrame, right: DataFrame, by: list[str], ts: str, within: str, late: str) -> DataFrame:
    """Pairs of rows of two streams that share ``by``, the right one after the left one by at most ``within``.

    Both streams have a watermark, so each side's rows are kept only while a partner may still come: a left row until the
    right watermark is past its time and ``within``, a right one until the left watermark is past its own. Columns are
    those of ``by``, and the others with left_ and right_ before their names. Files may come in any order in which no row
    is later than ``late`` allows.
    """
    side = lambda rows, name: rows.withWatermark(ts, late).select(*(F.col(c).alias(f"{name}_{c}") for c in rows.columns))
    a, b = side(left, "left"), side(right, "right")
    same = [F.col(f"left_{c}") == F.col(f"right_{c}") for c in by]
    soon = (F.col(f"right_{ts}") > F.col(f"left_{ts}")) & (F.col(f"right_{ts}") <= F.col(f"left_{ts}") + F.expr(f"INTERVAL {within}"))
    pairs = a.join(b, reduce(lambda x, y: x & y, same, soon), "inner")
    others = [c for c in pairs.columns if c not in [f"{s}_{k}" for s in ("left", "right") for k in by]]
    return pairs.select(*(F.col(f"left_{c}").alias(c) for c in by), *others)


def admit(times: list[int], now: int, window: int, limit: int) -> tuple[bool, list[int]]:
    """Whether an event at ``now`` is admitted, and the times that count from here on; a rejected event isn't among them."""
    live = [t for t in times if t >= now - window]
    return (True, [*live, now]) if len(live) < limit else (False, live)


def dealt(key: Column, groups: int) -> Column:
    """The group, one of so many, that a key belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(groups))


def check_and_record(rows: DataFrame, by: list[str], ts: str, event_id: str, seconds: int, limit: int, groups: int = GROUPS) -> DataFrame:
    """by, event_id, allowed, for a stream: an event counts only if it was admitted, so the state is the admitted times.

    A call costs far more than an event, so keys are dealt to ``groups``, and a call handles a batch's events of a whole
    group. Its state holds at most ``limit`` times a key; a key is dropped once the watermark is past its window's end.
    ``groups`` stays the same for a checkpoint. Batches have to come in the order of time: a backlog goes through
    ``in_order`` first. An event without a time has no place in a window, and isn't admitted.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    key, none = F.to_json(F.struct(*by), exact), F.col(event_id).isNull()
    # pandas makes whole numbers with nulls floating-point ones, so nulls travel as values
    id_ = F.coalesce(F.col(event_id), F.lit(0)) if kinds[event_id] in ("tinyint", "smallint", "int", "bigint") else F.col(event_id)
    at = F.coalesce(F.unix_micros(F.col(ts)), F.lit(NEVER))
    given = rows.select(ts, dealt(key, groups).alias("_group"), key.alias("_key"), at.alias("_at"), none.alias("_none"), id_.alias("_id"))
    window = seconds * 1_000_000

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(state.get[0]) if state.exists else {}
        frame = pd.concat(list(frames)).sort_values(["_at", "_none", "_id"], kind="stable")
        allowed = []
        for k, at in zip(frame["_key"].tolist(), frame["_at"].tolist(), strict=True):
            ok = False
            if at != NEVER:
                ok, held[k] = admit(held.get(k, []), at, window, limit)
            allowed.append(ok)
        past = state.getCurrentWatermarkMs()
        ends = {k: (max(times) + window) // 1000 for k, times in held.items() if times}
        held = {k: held[k] for k, end in ends.items() if end >= past}
        if held:
            state.update((held,))
            state.setTimeoutTimestamp(max(past + 1, *(ends[k] for k in held)))
        elif state.exists:
            state.remove()
        yield frame[["_key", "_none", "_id"]].assign(allowed=allowed)

    out = f"_key string, _none boolean, _id {kinds[event_id]}, allowed boolean"
    each = given.withWatermark(ts, f"{seconds} seconds").groupBy("_group").applyInPandasWithState(step, out, "times map<string, array<bigint>>", "append", GroupStateTimeout.EventTimeTimeout)
    back = F.from_json("_key", StructType([rows.schema[c] for c in by]), exact)
    return each.select(F.when(~F.col("_none"), F.col("_id")).alias(event_id), "allowed", back.alias("_by")).select("_by.*", event_id, "allowed")


def collected(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """What a stream gives over all that is there now, kept in ``folder`` and read again."""
    spark, out = stream.sparkSession, f"{folder}/out-{uuid.uuid4().hex}"
    write = lambda batch, _: batch.write.mode("append" if mode == "append" else "overwrite").parquet(out)
    run_once(stream, f"{folder}/checkpoint-{uuid.uuid4().hex}", write, mode)
    return spark.read.parquet(out)
