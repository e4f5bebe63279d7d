"""Operations on jobs, leases, sources and answers: state machines, checks for updates, and reviews."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.relations import latest_per_key

# The moves that a job may make.
TRANSITIONS = [
    ("queued", "running"), ("queued", "cancelled"), ("running", "succeeded"), ("running", "failed"),
    ("running", "cancelled"), ("running", "interrupted"), ("interrupted", "queued"), ("failed", "queued"),
]


def illegal_moves(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Events whose state may not follow the one before it; a job has to begin as queued."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    moves = F.array(*(F.lit(f"{a}>{b}") for a, b in TRANSITIONS))
    legal = F.when(before.isNull(), F.col(state) == "queued").otherwise((before == F.col(state)) | F.array_contains(moves, F.concat(before, F.lit(">"), F.col(state))))
    return events.withColumn("previous", before).withColumn("_legal", legal).filter("NOT _legal").drop("_legal")


def expired_leases(leases: DataFrame, key: str, expires: str, now: Column) -> DataFrame:
    """The holder's newest lease, if it has run out: what is recovered as interrupted."""
    last = leases.groupBy(key).agg(F.max(expires).alias(expires))
    return last.filter(F.col(expires) <= now).withColumn("state", F.lit("interrupted"))


def newest_histogram(rows: DataFrame, order: list[Column], state: str, most: int) -> DataFrame:
    """Counts by state among the newest rows only."""
    return rows.orderBy(*order).limit(most).groupBy(state).agg(F.count("*").alias("n"))


def update_check(manifest: DataFrame, installed: DataFrame, key: str, content_hash: str) -> DataFrame:
    """new, changed, unchanged or withdrawn, for every source that either side knows."""
    pair = manifest.select(key, F.col(content_hash).alias("_new")).join(installed.select(key, F.col(content_hash).alias("_old")), key, "full_outer")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "withdrawn").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")
    return pair.select(key, state.alias("state"))


def restored(versions: DataFrame, active: DataFrame, module: str, order: list[Column]) -> DataFrame:
    """The newest retained version of each module that has none active."""
    return latest_per_key(versions.join(active.select(module), module, "left_anti"), [module], order)


def covers_year(start: Column, end: Column, year: Column) -> Column:
    """Whether a year lies in an interval that may be open at its end."""
    return (start <= year) & (end.isNull() | (year <= end))


def section_number(citation: Column) -> Column:
    """A citation's number as something that sorts by its parts: 26-501.1 is (26, [501, 1])."""
    return F.struct(F.regexp_extract(citation, r"(\d+)-", 1).try_cast("int").alias("chapter"), F.transform(F.split(F.regexp_extract(citation, r"-(\d+(?:\.\d+)*)", 1), r"\."), lambda x: x.try_cast("int")).alias("parts"))


def cited_markers(answer: Column) -> Column:
    """Numbers of the [n] markers in an answer, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))


def review_verdict(checks: DataFrame, key: str, passed: str, name: str) -> DataFrame:
    """Whether all checks of a case passed, how many there are, and the names of those that failed."""
    failed = F.array_sort(F.collect_set(F.when(~F.col(passed), F.col(name))))
    return checks.groupBy(key).agg(F.bool_and(passed).alias("passed"), F.count("*").alias("checks"), F.array_join(failed, ",").alias("failed"))


def redact(text: Column, replacements: list[tuple[str, str]]) -> Column:
    """Literal replacements, longest first, so that a path inside another doesn't spoil it."""
    for old, new in sorted(replacements, key=lambda r: -len(r[0])):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def find_values(json: Column, name: str) -> Column:
    """All string values of a key at any depth, in order of appearance, with their escapes resolved; the key may have escapes, too."""
    key = "".join(rf"(?:{re.escape(c)}|\\u(?i:{ord(c):04x}))" for c in name)
    found = F.regexp_extract_all(json, F.lit(rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.transform(found, lambda x: F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>")[0])


def month_cutoff(ts: Column, zone: str, months: int) -> Column:
    """The instant, in UTC, at which the first of the last ``months`` calendar months of a zone begins."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    return F.to_utc_timestamp(F.add_months(F.trunc(local, "month"), 1 - months).cast("timestamp"), zone)


def tokens_left(logs: DataFrame, ts: str, tokens: str, *by: str, budget: int) -> DataFrame:
    """Tokens used per day and group, and what the daily budget leaves."""
    day = F.date_trunc("day", F.col(ts)).cast("timestamp_ntz").alias("day")
    used = F.coalesce(F.sum(tokens), F.lit(0)).alias("used")
    return logs.groupBy(day, *by).agg(used).withColumn("remaining", F.greatest(F.lit(0), F.lit(budget) - F.col("used")))


def counted_page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page by offset, with the number of all rows that match beside each; the count is a pass of its own and one row."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def title_only(text: Column, title: Column, short: int = 40) -> Column:
    """A chunk that says no more than its title, or hardly anything."""
    return (F.trim(text) == F.coalesce(F.trim(title), F.lit(""))) | (F.length(F.trim(text)) < short)


def matter_index(items: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One searchable text per matter, from its items in order. A matter is what one person keeps together, so its items fit a row."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return items.groupBy(key).agg(parts.alias("p")).select(key, F.array_join("p.t", "\n").alias("body"), F.size("p").alias("n_items"))


def compare_and_swap(rows: DataFrame, changes: DataFrame, key: str, revision: str) -> DataFrame:
    """``rows`` with the changes that name the current revision, which then grows by one; stale changes are left out."""
    fresh = changes.alias("c").join(rows.alias("r"), key).filter(F.col(f"c.{revision}") == F.col(f"r.{revision}"))
    done = fresh.select(key, *(F.col(f"c.{c}") if c in changes.columns and c != revision else (F.col(f"r.{revision}") + 1).alias(revision) if c == revision else F.col(f"r.{c}") for c in rows.columns if c != key))
    return rows.join(done.select(key), key, "left_anti").unionByName(done)


def first_requests(rows: DataFrame, known: DataFrame, request: str, order: list[Column]) -> DataFrame:
    """Rows whose request id is new, the first of each: what an idempotent append adds."""
    return latest_per_key(rows.join(known.select(request), request, "left_anti"), [request], order)
