"""Event ledgers, budgets, sliding windows and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRECEDENCE = ("reserve", "uncertain", "settle", "correction")


def attempt_states(events: DataFrame) -> DataFrame:
    """A row per attempt that was reserved: its final event by precedence, and when it was reserved.

    Of events of one type the last by time and id counts. ``events``: attempt_id, event_type, event_id, ts, amount, status.
    """
    rank = sum((F.when(F.col("event_type") == t, i + 1).otherwise(0) for i, t in enumerate(PRECEDENCE)), F.lit(0))
    known = events.filter(F.col("event_type").isin(*PRECEDENCE))
    place = F.struct(rank, "ts", "event_id")
    reserve = F.when(F.col("event_type") == "reserve", F.struct("ts", "event_id"))
    return (
        known.groupBy("attempt_id")
        .agg(F.max_by(F.struct("event_type", "status", "amount"), place).alias("final"), F.max(reserve).alias("reserve"))
        .filter("reserve IS NOT NULL")
        .select("attempt_id", F.col("reserve.ts").alias("reserved_at"), F.col("final.event_type").alias("final_type"), F.col("final.status").alias("status"), F.col("final.amount").alias("amount"))
    )


def month(ts: Column, zone: str = "UTC") -> Column:
    """The calendar month in a zone of an instant kept in UTC."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp_ntz").cast("timestamp"), zone), "yyyy-MM")


def month_summary(states: DataFrame, cap: float, zone: str = "UTC") -> DataFrame:
    """Per month of the reservation: settled, uncertain and reserved amounts and what is left of the cap."""
    total = lambda s: F.sum(F.when(F.col("status") == s, F.col("amount")).otherwise(0))
    sums = states.groupBy(month(F.col("reserved_at"), zone).alias("month")).agg(*(total(s).alias(s) for s in ("settled", "uncertain", "reserved")), F.sum("amount").alias("used"))
    return sums.withColumn("remaining", F.greatest(F.lit(0).cast("decimal(18,8)"), F.lit(cap).cast("decimal(18,8)") - F.col("used")))


def window_decisions(events: DataFrame, by: list[str], ts: str, seconds: int, limit: int) -> DataFrame:
    """Each event with the number in the window that ends with it, and whether that stays within the limit."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    window = Window.partitionBy(*by).orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    counted = events.withColumn("_at", at).withColumn("in_window", F.count("*").over(window)).withColumn("oldest", F.min(ts).over(window))
    return counted.withColumn("allowed", F.col("in_window") <= limit).drop("_at")


def evictions(entries: DataFrame, most: int) -> DataFrame:
    """The entries that go, least recently used first, until the rest fits. Pinned entries stay but take room.

    Sums run over minutes and days. Whole minutes before the bound go; only the minute in which it falls is ordered by entry.
    """
    loose = entries.filter("NOT pinned").withColumn("_at", F.date_trunc("minute", F.col("last_accessed").cast("timestamp")))
    total = entries.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    minutes = loose.groupBy("_at").agg(F.sum("size_bytes").alias("_bytes")).withColumn("_day", F.to_date("_at"))
    days = minutes.groupBy("_day").agg(F.sum("_bytes").alias("_sum"))
    before_day = Window.orderBy(F.asc_nulls_first("_day")).rowsBetween(Window.unboundedPreceding, -1)
    in_day = Window.partitionBy("_day").orderBy(F.asc_nulls_first("_at")).rowsBetween(Window.unboundedPreceding, -1)
    bases = days.select("_day", F.coalesce(F.sum("_sum").over(before_day), F.lit(0)).alias("_base"))
    placed = minutes.withColumn("_here", F.coalesce(F.sum("_bytes").over(in_day), F.lit(0))).alias("m").join(bases.alias("d"), F.col("m._day").eqNullSafe(F.col("d._day"))).select("m._at", "m._bytes", (F.col("_base") + F.col("_here")).alias("_before"))
    gone = placed.withColumn("_whole", total - F.col("_before") - F.col("_bytes") > most).filter(total - F.col("_before") > most).select(F.col("_at").alias("_gone_at"), "_before", "_whole")
    rows = loose.join(gone, F.col("_at").eqNullSafe(F.col("_gone_at")))
    inside = Window.partitionBy("_at").orderBy("last_accessed", "cache_key").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.filter("NOT _whole").withColumn("_inside", F.coalesce(F.sum("size_bytes").over(inside), F.lit(0))).filter(total - F.col("_before") - F.col("_inside") > most)
    return rows.filter("_whole").select(*entries.columns).unionByName(edge.select(*entries.columns))


def unreferenced(rows: DataFrame, artifact: str, candidate: Column) -> DataFrame:
    """Artifacts all of whose referrers are candidates for removal."""
    return rows.groupBy(artifact).agg(F.bool_and(candidate).alias("_all"), F.count("*").alias("n_references")).filter("_all").drop("_all")


def retention(events: DataFrame, cutoff: str, current_month: str) -> DataFrame:
    """attempt_id and decision: unresolved and current attempts are protected, others go once all their events are old."""
    types = F.collect_set("event_type")
    grouped = events.groupBy("attempt_id").agg(types.alias("types"), F.max("ts").alias("last"), F.min(F.when(F.col("event_type") == "reserve", F.col("ts"))).alias("reserved"))
    resolved = F.col("reserved").isNotNull() & F.arrays_overlap("types", F.array(F.lit("settle"), F.lit("correction")))
    decision = (
        F.when(~resolved, "unresolved")
        .when(F.date_format("reserved", "yyyy-MM") == current_month, "current")
        .when(F.col("last") < F.lit(cutoff).cast("timestamp_ntz"), "remove")
        .otherwise("keep")
    )
    return grouped.select("attempt_id", decision.alias("decision"))


def freshness(entries: DataFrame, now: Column, ttl: Column, stale_seconds: int) -> DataFrame:
    """fresh until the time to live ends, stale for a while after, then expired."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("fetched_at").cast("timestamp"))
    return entries.withColumn("state", F.when(age < ttl, "fresh").when(age < ttl + stale_seconds, "stale").otherwise("expired"))


def summary(states: DataFrame, cap: float, month_now: str, zone: str = "UTC") -> DataFrame:
    """One row for a month: settled, uncertain and reserved amounts, what is left, and attempts of unknown cost.

    Attempts that are still open count whatever month they were reserved in. ``states``: as of ``attempt_states`` with
    cost_known.
    """
    now = (month(F.col("reserved_at"), zone) == month_now) | F.col("status").isin("reserved", "uncertain")
    total = lambda s: F.coalesce(F.sum(F.when(now & (F.col("status") == s), F.col("amount"))), F.lit(0)).cast("decimal(18,8)")
    unknown = F.count_if(now & ~F.coalesce("cost_known", F.lit(True)))
    sums = states.agg(*(total(s).alias(s) for s in ("settled", "uncertain", "reserved")), unknown.alias("unknown_cost"))
    used = F.col("settled") + F.col("uncertain") + F.col("reserved")
    return sums.withColumn("remaining", F.greatest(F.lit(0).cast("decimal(18,8)"), F.lit(cap).cast("decimal(18,8)") - used.cast("decimal(18,8)")))


def admission(states: DataFrame, requests: DataFrame, month_now: str, monthly_cap: float, operation_cap: float, leases: DataFrame, most_concurrent: int, zone: str = "UTC") -> DataFrame:
    """``requests`` with the decision on each, taken by itself: known_attempt, over_operation, over_month, busy or admitted.

    A request of unknown cost has amount 0 and passes the caps. ``requests``: attempt_id, operation_id, amount, cost_known;
    ``states``: with operation_id; ``leases``: a row per call under way.
    """
    open_or_settled = F.col("status").isin("reserved", "settled", "uncertain")
    this = month(F.col("reserved_at"), zone) == month_now
    month_sum = F.sum(F.when((this & open_or_settled) | (~this & F.col("status").isin("reserved", "uncertain")), F.col("amount")))
    totals = states.agg(F.coalesce(month_sum, F.lit(0)).alias("_month"))
    by_operation = states.filter(open_or_settled).groupBy("operation_id").agg(F.sum("amount").alias("_operation"))
    known = states.select("attempt_id").distinct().withColumn("_known", F.lit(True))
    rows = requests.join(known, "attempt_id", "left").join(by_operation, "operation_id", "left").join(F.broadcast(totals)).join(F.broadcast(leases.agg(F.count("*").alias("_leases"))))
    priced = F.coalesce("cost_known", F.lit(True))
    decision = (
        F.when(F.col("_known"), "known_attempt")
        .when(priced & (F.coalesce("_operation", F.lit(0)) + F.col("amount") > operation_cap), "over_operation")
        .when(priced & (F.col("_month") + F.col("amount") > monthly_cap), "over_month")
        .when(F.col("_leases") >= most_concurrent, "busy")
        .otherwise("admitted")
    )
    return rows.withColumn("decision", decision).select(*requests.columns, "decision")


def reserve_events(decided: DataFrame, now: Column) -> DataFrame:
    """The events to append for the requests that were admitted."""
    admitted = decided.filter("decision = 'admitted'")
    return admitted.select("attempt_id", "operation_id", F.lit("reserve").alias("event_type"), F.lit("reserved").alias("status"), "amount", now.alias("ts"))


def finish_events(states: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The events to append for finished attempts: settle with an amount, uncertain, at what was reserved, without one.

    Only reserved attempts finish; one that ended before, or was never reserved, adds nothing. ``outcomes``: attempt_id, actual.
    """
    open_ = states.filter("status = 'reserved'").select("attempt_id", "operation_id", F.col("amount").alias("_reserved"))
    kind = F.when(F.col("actual").isNull(), "uncertain").otherwise("settle")
    status = F.when(F.col("actual").isNull(), "uncertain").otherwise("settled")
    return outcomes.join(open_, "attempt_id").select("attempt_id", "operation_id", kind.alias("event_type"), status.alias("status"), F.coalesce("actual", "_reserved").alias("amount"), now.alias("ts"))


def correction_events(states: DataFrame, corrections: DataFrame, now: Column) -> DataFrame:
    """The events that correct uncertain attempts; others can't be corrected. A correction has an amount of 0 or more and a reason.

    ``corrections``: attempt_id, actual, reason.
    """
    sound = (F.col("actual") >= 0) & (F.trim(F.coalesce("reason", F.lit(""))) != "") & (F.length("reason") <= 500)
    found = corrections.filter(sound).join(states.filter("status = 'uncertain'").select("attempt_id", "operation_id"), "attempt_id")
    return found.select("attempt_id", "operation_id", F.lit("correction").alias("event_type"), F.lit("settled").alias("status"), F.col("actual").alias("amount"), now.alias("ts"))


def apply_retention(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """The events without those of attempts to be removed."""
    return events.join(decisions.filter("decision = 'remove'").select("attempt_id"), "attempt_id", "left_anti")


def retention_preview(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Attempts by decision, and the events that would go."""
    counts = events.groupBy("attempt_id").agg(F.count("*").alias("_n"))
    return decisions.join(counts, "attempt_id").groupBy("decision").agg(F.count("*").alias("attempts"), F.sum("_n").alias("events"))


def pruned_floor(previous: Column, cutoff: Column, removed: Column) -> Column:
    """How far back history is whole: never earlier than before, and unchanged where nothing was removed."""
    return F.when(removed > 0, F.greatest(previous, cutoff)).otherwise(previous)


# States that a job ends in.
TERMINAL = ["succeeded", "failed", "cancelled"]


def finished_jobs(jobs: DataFrame, cutoff: str) -> DataFrame:
    """Jobs that may go: ended before the cutoff, and not failed ones that may be tried again."""
    over = F.col("state").isin(TERMINAL) & ~((F.col("state") == "failed") & F.coalesce("retryable", F.lit(False)))
    return jobs.filter(over & (F.col("updated_at") < F.lit(cutoff).cast("timestamp_ntz")))


def expired_artifacts(artifacts: DataFrame, now: Column) -> DataFrame:
    """Artifacts to be purged: past their time, not purged before, of no current version and not held."""
    return artifacts.filter((F.col("expires_at") <= now) & F.col("purged_at").isNull() & ~F.coalesce("is_current", F.lit(False)) & ~F.coalesce("held", F.lit(False)))


def cache_write(cache: DataFrame, responses: DataFrame, now: Column) -> DataFrame:
    """The cache with new responses in place of those of the same key; a verified zero lives an hour, anything else a day. Pins stay."""
    ttl = F.when(F.col("status") == "verified_zero", 3600).otherwise(86_400)
    pins = cache.select("cache_key", F.col("pinned").alias("_pinned"))
    fresh = responses.join(pins, "cache_key", "left").select(
        "cache_key", "status", "size_bytes", now.alias("fetched_at"), F.timestamp_add("SECOND", ttl, now).alias("expires_at"), now.alias("last_accessed"), F.coalesce("_pinned", F.lit(False)).alias("pinned")
    )
    return cache.join(fresh.select("cache_key"), "cache_key", "left_anti").unionByName(fresh.select(*cache.columns))


def cache_read(cache: DataFrame, keys: DataFrame, now: Column, stale_seconds: int = 604_800) -> tuple[DataFrame, DataFrame]:
    """What the cache has for the keys, with its state, and the cache with those entries marked as just used."""
    state = F.when(now < F.col("expires_at"), "fresh").when(now < F.timestamp_add("SECOND", F.lit(stale_seconds), F.col("expires_at")), "stale").otherwise("expired")
    hits = cache.join(keys.select("cache_key").distinct(), "cache_key", "left_semi")
    touched = cache.join(keys.select("cache_key").distinct().withColumn("_hit", F.lit(True)), "cache_key", "left").withColumn("last_accessed", F.when(F.col("_hit"), now).otherwise(F.col("last_accessed"))).drop("_hit")
    return hits.withColumn("state", state), touched


def cache_clear(cache: DataFrame) -> DataFrame:
    """What stays when the cache is cleared: pinned entries."""
    return cache.filter("pinned")


def cache_pin(cache: DataFrame, keys: DataFrame, pinned: bool) -> DataFrame:
    return cache.join(keys.select("cache_key").distinct().withColumn("_hit", F.lit(True)), "cache_key", "left").withColumn("pinned", F.when(F.col("_hit"), F.lit(pinned)).otherwise(F.col("pinned"))).drop("_hit")
