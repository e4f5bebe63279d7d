"""Queries over jobs, leases, sources and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import operations as ops
from corpusmill.plans.registry import query
from corpusmill.sources.tables import chunks, table

# an event of a user in the role of a job's state
_STATE = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'succeeded' END"
_NEXT = ", ".join(f"'{a}>{b}'" for a, b in ops.TRANSITIONS)


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", F.expr(_STATE).alias("state"))


@query(f"""WITH j AS (SELECT user_id AS job_id, event_id, ts, {_STATE} AS state FROM events), p AS (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous FROM j)
SELECT job_id, event_id, state, previous FROM p WHERE CASE WHEN previous IS NULL THEN state <> 'queued' ELSE state <> previous AND previous || '>' || state NOT IN ({_NEXT}) END""")
def job_illegal_moves(spark: SparkSession, folder: str) -> DataFrame:
    return ops.illegal_moves(_jobs(spark, folder), "job_id", ["ts", "event_id"], "state").select("job_id", "event_id", "state", "previous")


@query("SELECT user_id AS job_id, max(ts + INTERVAL 90 SECONDS) AS expires, 'interrupted' AS state FROM events WHERE event_type = 'click' GROUP BY 1 HAVING max(ts + INTERVAL 90 SECONDS) <= TIMESTAMP '2024-01-29'")
def lease_expiry(spark: SparkSession, folder: str) -> DataFrame:
    leases = _jobs(spark, folder).filter("state = 'running'").withColumn("expires", F.expr("ts + INTERVAL 90 SECONDS"))
    return ops.expired_leases(leases, "job_id", "expires", F.lit("2024-01-29").cast("timestamp_ntz"))


@query(f"WITH n AS (SELECT {_STATE} AS state FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT state, count(*) AS n FROM n GROUP BY 1")
def job_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return ops.newest_histogram(_jobs(spark, folder), [F.desc("ts"), F.desc("event_id")], "state", 100)


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'withdrawn' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS state FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang IS DISTINCT FROM 'fr') a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE source IS DISTINCT FROM 'src1') b ON a.doc_id = b.doc_id")
def update_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents")
    offered = rows.filter("NOT lang <=> 'fr'").select("doc_id", F.sha2("text", 256).alias("h"))
    there = rows.filter("NOT source <=> 'src1'").select("doc_id", F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("h"))
    return ops.update_check(offered, there, "doc_id", "h")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def restore_versions(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return ops.restored(versions, versions.filter("o_orderstatus = 'P'"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT source, bool_or(1990 + doc_id % 30 <= 2005 AND (doc_id % 4 = 0 OR 2005 <= 1995 + doc_id % 37)) AS covered, count(*) FILTER (WHERE doc_id % 4 = 0) AS open_ended FROM documents GROUP BY 1")
def historical_coverage(spark: SparkSession, folder: str) -> DataFrame:
    start, end = 1990 + F.col("doc_id") % 30, F.when(F.col("doc_id") % 4 != 0, 1995 + F.col("doc_id") % 37)
    return table(spark, folder, "documents").groupBy("source").agg(F.bool_or(ops.covers_year(start, end, F.lit(2005))).alias("covered"), F.count_if(end.isNull()).alias("open_ended"))


@query("SELECT doc_id, '26-' || (480 + doc_id % 60) || CASE WHEN doc_id % 3 = 0 THEN '.' || (doc_id % 12) ELSE '' END AS citation FROM documents WHERE 480 + doc_id % 60 BETWEEN 501 AND 519 OR (480 + doc_id % 60 = 520 AND doc_id % 3 <> 0)")
def section_range(spark: SparkSession, folder: str) -> DataFrame:
    """Sections 26-501 to 26-520, both included; numbers compare by their parts, so 26-520.1 lies beyond."""
    citation = F.concat(F.lit("26-"), 480 + F.col("doc_id") % 60, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("."), F.col("doc_id") % 12)).otherwise(""))
    rows = table(spark, folder, "documents").select("doc_id", citation.alias("citation"))
    number = ops.section_number(F.col("citation"))
    return rows.filter((number >= ops.section_number(F.lit("26-501"))) & (number <= ops.section_number(F.lit("26-520"))))


@query(r"""WITH a AS (SELECT conv_id, turn, text || ' [' || turn || '] and [' || (turn + 3) || '] again [' || turn || ']' AS t FROM conversations), m AS (SELECT conv_id, turn, [turn, turn + 3] AS c FROM a)
SELECT conv_id, turn, array_to_string(c, ',') AS cited, array_to_string(list_filter(c, lambda x: x > 5), ',') AS invalid FROM m""")
def answer_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence markers of answers, and those beyond the five pieces of evidence."""
    text = F.concat("text", F.lit(" ["), "turn", F.lit("] and ["), F.col("turn") + 3, F.lit("] again ["), "turn", F.lit("]"))
    found = table(spark, folder, "conversations").select("conv_id", "turn", ops.cited_markers(text).alias("c"))
    return found.select("conv_id", "turn", F.array_join(F.col("c").cast("array<string>"), ",").alias("cited"), F.array_join(F.filter("c", lambda x: x > 5).cast("array<string>"), ",").alias("invalid"))


@query("WITH c AS (SELECT conv_id, role AS name, length(text) > 30 AS passed FROM conversations) SELECT conv_id, bool_and(passed) AS passed, count(*) AS checks, coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE NOT passed)), ','), '') AS failed FROM c GROUP BY 1")
def review_rollup(spark: SparkSession, folder: str) -> DataFrame:
    checks = table(spark, folder, "conversations").select("conv_id", F.col("role").alias("name"), (F.length("text") > 30).alias("passed"))
    return ops.review_verdict(checks, "conv_id", "passed", "name")


@query("SELECT page_id, replace(replace(url, 'https://', '<scheme>'), 'page', '<p>') AS redacted FROM pages")
def path_redaction(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", ops.redact(F.col("url"), [("page", "<p>"), ("https://", "<scheme>")]).alias("redacted"))


@query("SELECT user_id, count(*) * 2 AS found, min('c' || event_id) AS least FROM events GROUP BY 1")
def json_find_values(spark: SparkSession, folder: str) -> DataFrame:
    payload = F.to_json(F.struct(F.concat(F.lit("c"), "event_id").alias("chunk_id"), F.struct(F.array(F.struct(F.concat(F.lit("d"), "event_id").alias("chunk_id"))).alias("list")).alias("deep")))
    found = table(spark, folder, "events").select("user_id", F.explode(ops.find_values(payload, "chunk_id")).alias("id"))
    return found.groupBy("user_id").agg(F.count("*").alias("found"), F.min("id").alias("least"))


@query("SELECT event_id, ((date_trunc('month', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') - INTERVAL 2 MONTHS) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS cutoff FROM events")
def month_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", ops.month_cutoff(F.col("ts"), "America/New_York", 3).cast("timestamp_ntz").alias("cutoff"))


@query("SELECT date_trunc('day', ts) AS day, event_type, coalesce(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 0) AS used, greatest(0, 5000 - coalesce(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 0)) AS remaining FROM events GROUP BY ALL")
def daily_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    logs = table(spark, folder, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))
    return ops.tokens_left(logs, "ts", "tokens", "event_type", budget=5000)


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page_with_total(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return ops.counted_page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 40, 20)


@query("SELECT doc_id AS chunk_id FROM documents WHERE trim(text, ' ') = trim(split_part(text, chr(10), 1), ' ') OR length(trim(text, ' ')) < 40")
def title_only_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).filter(ops.title_only(F.col("text"), F.col("title"))).select("chunk_id")


@query("SELECT o_custkey, string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey) AS body, CAST(count(*) AS INTEGER) AS n_items FROM orders GROUP BY 1")
def matter_index(spark: SparkSession, folder: str) -> DataFrame:
    return ops.matter_index(table(spark, folder, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'renamed' ELSE s_name END AS s_name, s_suppkey % 3 + CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS revision FROM supplier")
def revision_check(spark: SparkSession, folder: str) -> DataFrame:
    """Changes that name revision 0: those made from an older state are refused."""
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name", (F.col("s_suppkey") % 3).alias("revision"))
    changes = rows.filter("s_suppkey % 2 = 0").select("s_suppkey", F.lit("renamed").alias("s_name"), F.lit(0).cast("long").alias("revision"))
    return ops.compare_and_swap(rows, changes, "s_suppkey", "revision")


@query("SELECT user_id, event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 200) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def idempotent_append(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", "event_id", "ts")
    return ops.first_requests(rows, table(spark, folder, "events").filter("value > 200").select("user_id"), "user_id", [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id")
