"""Queries that run as streams over all events there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.registry import query
from corpusmill.sources import feeds, sinks
from corpusmill.sources.shared import new_folder
from corpusmill.streaming import ingest, leases


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


@query("SELECT date_trunc('day', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = ingest.tumbling(ingest.event_stream(spark, f"{folder}/events.parquet"), "ts", "1 day", "event_type")
    return ingest.collected(counts, "complete", _folder(spark)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("SELECT b AS bucket, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY ALL")
def stream_sliding_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = ingest.sliding(ingest.event_stream(spark, f"{folder}/events.parquet"), "ts", "2 hours", "1 hour", "event_type")
    return ingest.collected(counts, "complete", _folder(spark)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user and type, merged batch by batch into a published table."""
    out = _folder(spark)
    last = F.struct("ts", "event_id").alias("place")
    rows = ingest.event_stream(spark, f"{folder}/events.parquet").select("user_id", "event_type", "event_id", "ts", last)
    ingest.run_once(rows, f"{out}/checkpoint", ingest.upsert_sink(f"{out}/table", ["user_id", "event_type"], "place"))
    return sinks.active(spark, f"{out}/table").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/events.parquet"
    rows = ingest.event_stream(spark, path)
    twice = rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return ingest.collected(ingest.deduplicated(twice, "event_id", "ts", ingest.span(spark, path)).select("event_id", "user_id"), "append", _folder(spark))


@query()
def stream_check_and_record(spark: SparkSession, folder: str) -> DataFrame:
    """At most three admitted events of a type per user and day; rejected ones don't count."""
    out = _folder(spark)
    rows = ingest.event_stream(spark, ingest.in_order(spark, f"{folder}/events.parquet", out))
    return ingest.collected(ingest.check_and_record(rows, ["user_id", "event_type"], "ts", "event_id", 86_400, 3), "append", out)


@query("SELECT event_id, user_id, event_type, ts FROM events WHERE event_type IN ('click', 'purchase') AND user_id >= 50 AND ts >= TIMESTAMP '2024-01-10'")
def feed_filtered_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A feed read with its filters: Spark hands them to the source, which leaves out row groups and rows."""
    rows = feeds.feed(spark, f"{folder}/events.parquet", ["event_id", "user_id", "event_type", "ts"])
    return rows.filter(F.col("event_type").isin("click", "purchase") & (F.col("user_id") >= 50) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")))


@query("SELECT event_id, user_id, event_type, ts FROM events WHERE ts IS NOT NULL")
def feed_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """All events as a feed in the order of ids, taken into a table of buckets; a delta run afterwards changes nothing."""
    out = _folder(spark)
    for _ in range(2):
        ingest.ingest_feed(spark, f"{folder}/events.parquet", out, "auto", "event_id", "ts")
    return sinks.active(spark, f"{out}/table").select("event_id", "user_id", "event_type", "ts")


@query("""
SELECT l.user_id, l.event_id AS left_event_id, r.event_id AS right_event_id FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts > l.ts AND r.ts <= l.ts + INTERVAL 6 HOUR
WHERE l.event_type = 'click' AND r.event_type = 'purchase'""")
def stream_interval_join(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases within six hours of a click by the same user: two streams joined over event time."""
    path = f"{folder}/events.parquet"
    rows = ingest.event_stream(spark, path).select("user_id", "event_id", "event_type", "ts")
    sides = [rows.filter(F.col("event_type") == kind).drop("event_type") for kind in ("click", "purchase")]
    pairs = ingest.joined_in_time(*sides, ["user_id"], "ts", "6 hours", ingest.span(spark, path))
    return ingest.collected(pairs, "append", _folder(spark)).select("user_id", "left_event_id", "right_event_id")


#: A job per user and day: what its events do to it, by their kind; the lease lasts six hours.
KINDS = {"signup": "claim", "click": "claim", "view": "heartbeat", "error": "fail", "purchase": "complete"}


@query()
def stream_job_leases(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a user's day as those of a job, whose leases run out by themselves: every change of its state."""
    out, path = _folder(spark), f"{folder}/events.parquet"
    rows = ingest.event_stream(spark, ingest.in_order(spark, path, out)).filter("ts IS NOT NULL")
    kind = F.coalesce(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("event_type")], F.lit("heartbeat"))
    day = F.date_format("ts", "yyyy-MM-dd")
    job = F.concat_ws("/", F.col("user_id").cast("string"), day).alias("job_id")
    made = F.array(F.struct((2 * F.col("event_id")).alias("event_id"), F.lit("create").alias("kind")), F.struct((2 * F.col("event_id") + 1).alias("event_id"), kind.alias("kind")))
    group = F.concat_ws("/", day, ingest.dealt(F.col("job_id"), 128).cast("string"))  # jobs of a day share rows of state
    events = rows.select(job, F.lit("worker").alias("owner"), "ts", F.unix_micros("ts").alias("at_micros"), F.inline(made))
    return leases.transitions(events, out, 21_600, "1 second", group)
