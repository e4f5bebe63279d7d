"""Queries over questions, feeds, ledgers, caches, matters, properties, answers and corpus snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import documents, routing
from corpusmill.functions import text as T
from corpusmill.operators import answers, audit, corpus, ledger, matters, property, relations
from corpusmill.operators import operations as ops
from corpusmill.plans.registry import query
from corpusmill.sources import tables
from corpusmill.sources.shared import new_folder
from corpusmill.sources.tables import table


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS building_id, CASE WHEN c_custkey % 3 = 1 THEN CAST(c_custkey AS VARCHAR) END AS registration_id,
  CASE WHEN c_custkey % 3 = 2 THEN c_custkey || '-7A' END AS house_number, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment || ' AVENUE' END AS street_name, CASE WHEN c_custkey % 3 = 2 THEN CAST(10000 + c_custkey % 90 AS VARCHAR) END AS zip_code,
  CASE WHEN c_custkey % 3 < 2 THEN 'property_signal_with_identifier' ELSE 'property_signal_with_identifier' END AS reason FROM customer""")
def question_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("Show violations of building id: "), k)).when(k % 3 == 1, F.concat(F.lit("registration #"), k, F.lit(" please")))
    text = text.otherwise(F.concat(F.lit("see the property at "), k, F.lit("-7A "), F.lower("c_mktsegment"), F.lit("  Avenue in NYC "), 10_000 + k % 90, F.lit(" violations")))
    return table(spark, folder, "customer").select("c_custkey", *(c.alias(n) for n, c in routing.identifiers(text).items()), routing.route(text)["reason"].alias("reason"))


RULES = [
    {"rule_id": "heat", "pattern": r"(?i)\bthe\b", "priority": 2},
    {"rule_id": "gas", "pattern": r"(?i)\bde\b", "unless": r"(?i)\bla\b", "priority": 5},
    {"rule_id": "age", "pattern": r"(?i)\b(and|der)\b", "lang": "odd", "priority": 2},
]


@query(r"""WITH q AS (SELECT item_id, text, CASE WHEN item_id % 2 = 1 THEN 'odd' ELSE 'even' END AS lang FROM benchmark),
m AS (SELECT item_id, 'heat' AS rule_id, 2 AS priority FROM q WHERE regexp_matches(text, '(?i)\bthe\b') UNION ALL SELECT item_id, 'gas', 5 FROM q WHERE regexp_matches(text, '(?i)\bde\b') AND NOT regexp_matches(text, '(?i)\bla\b')
  UNION ALL SELECT item_id, 'age', 2 FROM q WHERE regexp_matches(text, '(?i)\b(and|der)\b') AND lang = 'odd')
SELECT item_id, rule_id, priority, CAST(row_number() OVER (PARTITION BY item_id ORDER BY priority DESC, rule_id) AS INTEGER) AS place FROM m""")
def situation_rules(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 2 == 1, "odd").otherwise("even").alias("lang"))
    return routing.matching_rules(asked, "text", RULES).select("item_id", "rule_id", "priority", "place")


@query("""WITH p AS (SELECT * FROM (VALUES ('p1', ['THE  x', 'tion the']), ('p2', ['de la', 'and ing'])) AS t(pack, terms)), q AS (SELECT item_id, lower(text) AS t FROM benchmark)
SELECT item_id, pack FROM q, p WHERE len(list_filter(terms, lambda x: contains(t, lower(x)))) > 0""")
def pack_triggers(spark: SparkSession, folder: str) -> DataFrame:
    packs = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(p).alias("pack"), F.array(*map(F.lit, ts)).alias("terms")) for p, ts in (("p1", ["THE  x", "tion the"]), ("p2", ["de la", "and ing"]))))))
    return routing.term_triggers(table(spark, folder, "benchmark").select("item_id", "text"), "text", packs, "pack", "terms").select("item_id", "pack")


@query("""SELECT p_partkey, p_name || '"\\' || chr(10) || 'é' AS value FROM part UNION ALL SELECT p_partkey, p_brand FROM part""")
def json_deep_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values of a key at two depths, with quotes, backslashes and line ends in them; the same words in a text don't count."""
    odd = F.concat("p_name", F.lit('"\\\né'))
    payload = F.to_json(F.struct(F.lit('"id": "no"').alias("text"), F.array(F.struct(odd.alias("id"))).alias("list"), F.struct(F.struct(F.col("p_brand").alias("id"), F.lit(3).alias("n")).alias("b")).alias("a")))
    return table(spark, folder, "part").select("p_partkey", F.explode(ops.find_values(payload, "id")).alias("value"))


@query("SELECT event_type, count(*) FILTER (WHERE event_id % 6 <> 1) AS known, count(*) AS n FROM events GROUP BY 1")
def json_literal_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Only the literal false says no: not the text, not null, not a number, not broken JSON."""
    k = F.col("event_id") % 6
    payload = F.when(k == 0, '{"cost_known": "false"}').when(k == 1, '{"cost_known": false}').when(k == 2, '{"cost_known": null}').when(k == 3, '{"cost_known": 0}').when(k == 4, "broken").otherwise('{"cost_known": true}')
    return table(spark, folder, "events").groupBy("event_type").agg(F.count_if(T.json_flag(payload, "cost_known")).alias("known"), F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS word FROM documents), h AS (SELECT doc_id, sha256(word) AS h FROM w),
s AS (SELECT doc_id, CAST(('0x' || h[1:2])::INTEGER % 64 AS INTEGER) AS slot, sum(CAST(('0x' || h[3:6])::INTEGER AS DOUBLE) / 65535 + 0.01) AS v FROM h GROUP BY ALL)
SELECT doc_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM s""")
def hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(documents.hash_embedding(F.col("text"))).alias("slot", "v"))
    return rows.filter("v <> 0").select("doc_id", "slot", F.round("v", 6).alias("value"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), b AS (SELECT doc_id, unnest(range(40)) AS i, h FROM h), v AS (SELECT doc_id, i, CAST(('0x' || h[(i % 32) * 2 + 1:(i % 32) * 2 + 2])::INTEGER AS DOUBLE) / 255 * 2 - 1 AS v FROM b)
SELECT doc_id, CAST(i AS INTEGER) AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM v""")
def seed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(T.seed_embedding(F.col("text"), 40)).alias("i", "v"))
    return rows.select("doc_id", "i", F.round("v", 6).alias("value"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey || '-1A' END AS house, upper(c_mktsegment) || CASE c_custkey % 3 WHEN 0 THEN ' STREET' WHEN 1 THEN ' AVENUE' ELSE ' PLACE' END AS street,
  CASE c_custkey % 4 WHEN 0 THEN 'BROOKLYN' WHEN 1 THEN 'STATEN ISLAND' WHEN 2 THEN 'QUEENS' END AS borough FROM customer""")
def canonical_addresses(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    house = F.concat(F.lit("  "), k, F.when(k % 4 == 0, "/2").otherwise("-1a"))
    street = F.concat(F.lower("c_mktsegment"), F.when(k % 3 == 0, ",  st").when(k % 3 == 1, " ave.").otherwise(" place"))
    borough = F.when(k % 4 == 0, "3").when(k % 4 == 1, "staten  island").when(k % 4 == 2, "qn").otherwise("Hoboken")
    return table(spark, folder, "customer").select("c_custkey", T.canonical_house(house).alias("house"), T.canonical_street(street).alias("street"), T.canonical_borough(borough).alias("borough"))


@query("""WITH c AS (SELECT o_orderkey, '{"building_id":"' || o_custkey || '","inspection_date":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"' || strftime(o_orderdate, '%Y-%m-%d') || '"' END || ',"request_hash":"' || sha256(o_orderstatus) || '","violation_id":"' || o_orderkey || '"}' AS j, o_orderdate, o_custkey, o_orderstatus FROM orders)
SELECT o_orderkey, translate(to_base64(encode(j)), '+/', '-_') AS cursor, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) END AS building_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS inspection_date FROM c""")
def page_cursors(spark: SparkSession, folder: str) -> DataFrame:
    """Cursors made for each order and read again as of a request for status F, which others don't belong to."""
    date = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    made = T.encode_cursor(F.sha2("o_orderstatus", 256), F.col("o_custkey").cast("string"), date, F.col("o_orderkey").cast("string"))
    rows = table(spark, folder, "orders").select("o_orderkey", made.alias("cursor"))
    end = T.decode_cursor(F.col("cursor"), F.sha2(F.lit("F"), 256))
    return rows.select("o_orderkey", "cursor", end["building_id"].alias("building_id"), end["inspection_date"].alias("inspection_date"))


@query("""WITH h AS (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(p_name)) AS h FROM part)
SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17:17])::INTEGER % 4 + 1] || h[18:20] || '-' || h[21:32] AS id FROM part JOIN h USING (p_partkey)""")
def name_uuids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", T.uuid5(F.lit(T.URL_SPACE), F.col("p_name")).alias("id"))


@query(r"""WITH u AS (SELECT page_id, url, 'https://e.org/site/' || replace(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 'https-', '') || '.page?x=' || page_id AS u FROM pages), s AS (SELECT page_id, u, regexp_extract(u, 'site/(.*)\.page', 1) AS stem FROM u)
SELECT page_id, stem || '-' || sha1(u)[1:8] AS document_key, array_to_string(list_transform(string_split(stem, '-'), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title, stem || '-' || sha1(CAST(page_id AS VARCHAR) || ':' || stem)[1:6] AS section_key FROM s""")
def page_keys(spark: SparkSession, folder: str) -> DataFrame:
    stem = F.replace(T.slug(F.col("url")), F.lit("https-"), F.lit(""))
    rows = table(spark, folder, "pages").select("page_id", stem.alias("stem"), F.concat(F.lit("https://e.org/site/"), stem, F.lit(".page?x="), "page_id").alias("u"))
    return rows.select("page_id", T.document_key(F.col("u")).alias("document_key"), T.title_from_url(F.col("u")).alias("title"), T.section_key(F.col("stem"), F.col("page_id")).alias("section_key"))


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 THEN sha256('{"boro":"' || o_orderpriority || '","class":"' || o_orderstatus || '","currentstatusdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","house_number":"","housenumber":"' || o_custkey || 'b","inspectiondate":"' || strftime(o_orderdate, '%Y-%m-%d') || '","street_name":"main st","violationid":""}') ELSE CAST(o_orderkey AS VARCHAR) END AS external_id,
  o_orderkey, o_custkey || 'b' AS house_number, o_custkey || 'B' AS normalized_house_number, o_custkey || 'B MAINST' AS normalized_full_address, o_orderpriority AS boro, o_orderstatus AS violation_class, CAST(o_orderdate AS DATE) AS inspection_date, CAST(o_orderdate AS DATE) AS current_status_date, CAST(NULL AS VARCHAR) AS nov_id FROM orders""")
def feed_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a feed with some of the fields, one under its other name, and an empty one before a given one."""
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.when(k % 7 == 0, "").otherwise(k.cast("string")).alias("violationid"), F.lit("").alias("house_number"), F.concat("o_custkey", F.lit("b")).alias("housenumber"), F.lit("main st").alias("street_name"),
        F.col("o_orderpriority").alias("boro"), F.col("o_orderstatus").alias("class"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("inspectiondate"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("currentstatusdate"),
    )
    values = property.feed_values(rows, "o_orderkey")
    return values.select("external_id", "o_orderkey", "house_number", "normalized_house_number", "normalized_full_address", "boro", "violation_class", "inspection_date", "current_status_date", "nov_id")


@query(r"""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations), b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE rank <= 6)
SELECT conv_id, turn, CASE WHEN length(text) > 500 - before THEN regexp_replace(substr(text, 1, CAST(500 - before AS INTEGER)), '\s+$', '') ELSE text END AS text FROM b WHERE before < 500""")
def trimmed_context(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").withColumn("rank", F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn)"))
    return property.trimmed_context(rows, "conv_id", "rank", "text", 6, 500).select("conv_id", "turn", "text")


_VIOLATIONS = "SELECT o_orderkey AS violation_id, o_custkey AS building_id, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS inspection_date FROM orders"


@query(f"""WITH v AS ({_VIOLATIONS}), p AS (SELECT building_id, CAST(violation_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY building_id ORDER BY inspection_date DESC NULLS LAST, violation_id) AS place FROM v)
SELECT building_id, 'property' AS kind, CAST(place AS INTEGER) AS place, id FROM p WHERE place <= 3 UNION ALL SELECT doc_id, 'legal', CAST(n AS INTEGER), CAST(doc_id * 10 + n AS VARCHAR) FROM documents, range(1, 3) AS t(n)""")
def summary_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.violations(spark, folder).select("violation_id", "building_id", "inspection_date")
    hits = table(spark, folder, "documents").select(F.col("doc_id").alias("building_id"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("rank"))
    return property.evidence(rows, hits.withColumn("chunk_id", F.col("building_id") * 10 + F.col("rank")), "building_id", 3, 2)


@query("SELECT count(DISTINCT l_partkey) AS \"rows\", count(DISTINCT l_linenumber) AS pages, 'page_limit' AS reason FROM lineitem WHERE l_linenumber < 3")
def export_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as pages of an export that is cut off after so many."""
    pages = table(spark, folder, "lineitem").select("l_partkey", (F.col("l_linenumber") - 1).alias("page"), "l_orderkey", F.lit(True).alias("has_more"))
    return property.complete_export(pages, "l_partkey", "page", "l_orderkey", 2, "has_more")[1]


@query("""SELECT event_id, CAST(round_even((event_id * 150 + user_id * 600) / 1e9::DECIMAL(18,8), 8) AS DOUBLE) AS cost, CASE WHEN event_id % 3 = 0 THEN 'PDF page ' || (event_id + 1) WHEN event_id % 3 = 1 THEN CASE WHEN user_id % 2 = 0 THEN 'paragraph ' || (event_id + 1) ELSE 'paragraphs ' || (event_id + 1) || '-' || (event_id + 2) END ELSE 'not supplied' END AS label FROM events""".replace("round_even((event_id * 150 + user_id * 600) / 1e9::DECIMAL(18,8), 8)", "(event_id * 150 + user_id * 600) / 1e9"))
def costs_and_labels(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("event_id")
    cost = T.token_cost(k, F.col("user_id"), F.lit("0.15").cast("decimal(18,8)"), F.lit("0.6").cast("decimal(18,8)"))
    locator = F.when(k % 3 == 0, F.to_json(F.struct((k + 1).alias("pdf_page")))).when(k % 3 == 1, F.to_json(F.struct((k + 1).alias("paragraph_start"), (k + 1 + F.col("user_id") % 2).alias("paragraph_end")))).otherwise('{"section": ""}')
    return table(spark, folder, "events").select("event_id", cost.cast("double").alias("cost"), T.locator_label(locator).alias("label"))


_STATES = """l AS (SELECT event_id // 3 AS attempt_id, CASE event_type WHEN 'view' THEN 'reserve' WHEN 'error' THEN 'uncertain' WHEN 'purchase' THEN 'settle' WHEN 'signup' THEN 'correction' END AS event_type, event_id, ts, CAST(floor(value * 100) AS DECIMAL(18,8)) AS amount,
  CASE event_type WHEN 'view' THEN 'reserved' WHEN 'error' THEN 'uncertain' ELSE 'settled' END AS status FROM events WHERE event_type IN ('view', 'error', 'purchase', 'signup')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY CASE event_type WHEN 'reserve' THEN 1 WHEN 'uncertain' THEN 2 WHEN 'settle' THEN 3 ELSE 4 END DESC, ts DESC, event_id DESC) AS place FROM l),
states AS (SELECT r.attempt_id, r.attempt_id % 40 AS operation_id, reserved_at, status, amount, r.attempt_id % 9 <> 0 AS cost_known FROM ranked r JOIN (SELECT attempt_id, max(ts) AS reserved_at FROM l WHERE event_type = 'reserve' GROUP BY 1) USING (attempt_id) WHERE place = 1)"""


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Three events after one another as the events of an attempt."""
    return tables.ledger(spark, folder).withColumn("attempt_id", F.floor(F.col("event_id") / 3))


def _states(spark: SparkSession, folder: str) -> DataFrame:
    rows = ledger.attempt_states(_events(spark, folder))
    return rows.withColumn("operation_id", F.col("attempt_id") % 40).withColumn("cost_known", F.col("attempt_id") % 9 != 0)


@query(f"""WITH {_STATES}, c AS (SELECT * FROM states WHERE strftime(reserved_at, '%Y-%m') = '2024-01' OR status IN ('reserved', 'uncertain'))
SELECT CAST(coalesce(sum(amount) FILTER (WHERE status = 'settled'), 0) AS DOUBLE) AS settled, CAST(coalesce(sum(amount) FILTER (WHERE status = 'uncertain'), 0) AS DOUBLE) AS uncertain, CAST(coalesce(sum(amount) FILTER (WHERE status = 'reserved'), 0) AS DOUBLE) AS reserved,
  count(*) FILTER (WHERE NOT cost_known) AS unknown_cost, CAST(greatest(0, 9000000 - coalesce(sum(amount), 0)) AS DOUBLE) AS remaining FROM c""")
def ledger_summary(spark: SparkSession, folder: str) -> DataFrame:
    one = ledger.summary(_states(spark, folder), 9_000_000, "2024-01")
    return one.select(*(F.col(c).cast("double").alias(c) for c in ("settled", "uncertain", "reserved", "remaining")), "unknown_cost")


@query(f"""WITH {_STATES}, m AS (SELECT coalesce(sum(amount), 0) AS month FROM states WHERE strftime(reserved_at, '%Y-%m') = '2024-01' OR status IN ('reserved', 'uncertain')), o AS (SELECT operation_id, sum(amount) AS used FROM states GROUP BY 1),
q AS (SELECT o_orderkey AS attempt_id, o_custkey % 60 AS operation_id, CAST(floor(o_totalprice) AS DECIMAL(18,8)) AS amount, o_orderkey % 5 <> 0 AS cost_known FROM orders)
SELECT attempt_id, CASE WHEN attempt_id IN (SELECT attempt_id FROM states) THEN 'known_attempt' WHEN cost_known AND coalesce(used, 0) + q.amount > 300000 THEN 'over_operation' WHEN cost_known AND month + q.amount > (SELECT month + 150000 FROM m) THEN 'over_month' WHEN (SELECT count(*) FROM region) >= 9 THEN 'busy' ELSE 'admitted' END AS decision
FROM q LEFT JOIN o USING (operation_id), m""")
def spend_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as requests, each against the ledger as it stands; the cap leaves 150,000 of the month."""
    states = _states(spark, folder)
    used = ledger.summary(states, 0, "2024-01").select(F.expr("settled + uncertain + reserved")).first()[0]
    asked = table(spark, folder, "orders").select(F.col("o_orderkey").alias("attempt_id"), (F.col("o_custkey") % 60).alias("operation_id"), F.floor("o_totalprice").cast("decimal(18,8)").alias("amount"), (F.col("o_orderkey") % 5 != 0).alias("cost_known"))
    return ledger.admission(states, asked, "2024-01", float(used) + 150_000, 300_000, table(spark, folder, "region"), 9).select("attempt_id", "decision")


@query(f"""WITH {_STATES}, f AS (SELECT attempt_id, CASE WHEN attempt_id % 3 = 0 THEN 'uncertain' ELSE 'settle' END AS event_type, CAST(CASE WHEN attempt_id % 3 = 0 THEN amount ELSE 12 END AS DOUBLE) AS amount FROM states WHERE status = 'reserved'),
c AS (SELECT attempt_id, 'correction', 7.0::DOUBLE FROM states WHERE status = 'uncertain' AND attempt_id % 2 = 0) SELECT * FROM f UNION ALL SELECT * FROM c""")
def ledger_appends(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes for every attempt there is: only reserved ones finish, and only uncertain ones with a reason are corrected."""
    states, now = _states(spark, folder), F.lit("2024-02-01").cast("timestamp_ntz")
    ids = states.select("attempt_id")
    done = ledger.finish_events(states, ids.withColumn("actual", F.when(F.col("attempt_id") % 3 != 0, F.lit(12).cast("decimal(18,8)"))), now)
    fixed = ledger.correction_events(states, ids.select("attempt_id", F.lit(7).cast("decimal(18,8)").alias("actual"), F.when(F.col("attempt_id") % 2 == 0, "bank").otherwise(" ").alias("reason")), now)
    return done.unionByName(fixed).select("attempt_id", "event_type", F.col("amount").cast("double").alias("amount"))


_DECIDED = """g AS (SELECT attempt_id, bool_or(event_type IN ('settle', 'correction')) AS done, max(ts) AS last, min(ts) FILTER (WHERE event_type = 'reserve') AS reserved, count(*) AS n FROM l GROUP BY 1),
d AS (SELECT attempt_id, n, CASE WHEN reserved IS NULL OR NOT done THEN 'unresolved' WHEN strftime(reserved, '%Y-%m') = '2024-02' THEN 'current' WHEN last < TIMESTAMP '2024-01-29' THEN 'remove' ELSE 'keep' END AS decision FROM g)"""


@query(f"WITH {_STATES}, {_DECIDED} SELECT event_id FROM l JOIN d USING (attempt_id) WHERE decision <> 'remove'")
def retention_applied(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    return ledger.apply_retention(events, ledger.retention(events, "2024-01-29", "2024-02")).select("event_id")


@query(f"WITH {_STATES}, {_DECIDED} SELECT decision, count(*) AS attempts, CAST(sum(n) AS BIGINT) AS events FROM d GROUP BY 1")
def retention_preview(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    return ledger.retention_preview(events, ledger.retention(events, "2024-01-29", "2024-02"))


@query("""SELECT event_id, event_type IN ('purchase', 'signup') OR (event_type = 'error' AND user_id % 2 = 0) AS over FROM events WHERE ts < TIMESTAMP '2024-01-20' AND (event_type IN ('purchase', 'signup') OR (event_type = 'error' AND user_id % 2 = 0))""")
def finished_jobs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "succeeded").when(kind == "signup", "cancelled").when(kind == "error", "failed").otherwise("running")
    jobs = table(spark, folder, "events").select("event_id", state.alias("state"), (F.col("user_id") % 2 == 1).alias("retryable"), F.col("ts").alias("updated_at"))
    return ledger.finished_jobs(jobs, "2024-01-20").select("event_id", F.lit(True).alias("over"))


@query("""SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000 AND s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 1 AND s_suppkey % 5 <> 2""")
def expired_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    now, k = F.lit("2024-06-01").cast("timestamp_ntz"), F.col("s_suppkey")
    at = F.when(F.col("s_acctbal") < 5000, F.lit("2024-01-01")).otherwise(F.lit("2025-01-01")).cast("timestamp_ntz")
    rows = table(spark, folder, "supplier").select("s_suppkey", at.alias("expires_at"), F.when(k % 3 == 0, now).alias("purged_at"), (k % 4 == 1).alias("is_current"), F.when(k % 5 == 2, True).alias("held"))
    return ledger.expired_artifacts(rows, now).select("s_suppkey")


@query("""WITH e AS (SELECT user_id AS k, max(ts) AS f, count(*) AS n FROM events GROUP BY 1), w AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'verified_zero' ELSE 'found' END AS status FROM e WHERE k % 3 = 0)
SELECT k AS cache_key, CASE WHEN w.k IS NULL THEN CASE WHEN TIMESTAMP '2024-02-01' < f + INTERVAL 1 DAY THEN 'fresh' WHEN TIMESTAMP '2024-02-01' < f + INTERVAL 8 DAYS THEN 'stale' ELSE 'expired' END ELSE 'fresh' END AS state,
  CASE WHEN w.k IS NULL THEN f + INTERVAL 1 DAY WHEN w.status = 'verified_zero' THEN TIMESTAMP '2024-02-01 01:00:00' ELSE TIMESTAMP '2024-02-02' END AS expires_at, e.k % 5 = 0 AS pinned FROM e LEFT JOIN w USING (k)""")
def cache_read_through(spark: SparkSession, folder: str) -> DataFrame:
    """A cache with an entry for every user, to a third of which new responses come; then all are read."""
    now, key = F.lit("2024-02-01").cast("timestamp_ntz"), F.col("cache_key")
    users = table(spark, folder, "events").groupBy(F.col("user_id").alias("cache_key")).agg(F.max("ts").alias("fetched_at"), F.count("*").alias("size_bytes"))
    cache = users.select("cache_key", F.lit("found").alias("status"), "size_bytes", "fetched_at", F.timestamp_add("DAY", F.lit(1), F.col("fetched_at")).alias("expires_at"), F.col("fetched_at").alias("last_accessed"), (key % 5 == 0).alias("pinned"))
    answered = users.filter("cache_key % 3 = 0").select("cache_key", F.when(key % 2 == 0, "verified_zero").otherwise("found").alias("status"), "size_bytes")
    hits, _ = ledger.cache_read(ledger.cache_write(cache, answered, now), users, now)
    return hits.select("cache_key", "state", "expires_at", "pinned")


@query("""WITH old AS (SELECT o_custkey AS m, o_orderkey AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'), mx AS (SELECT m, max(n) AS n FROM old GROUP BY 1),
new AS (SELECT o_custkey AS m, o_orderkey AS i FROM orders WHERE o_orderstatus <> 'F'), placed AS (SELECT new.m, new.i, coalesce(mx.n, 0) + row_number() OVER (PARTITION BY new.m ORDER BY CAST(i AS VARCHAR)) AS n FROM new LEFT JOIN mx ON mx.m = new.m)
SELECT CAST(m AS VARCHAR) AS matter_id, CAST(i AS VARCHAR) AS item_id, n AS display_order FROM old UNION ALL SELECT CAST(m AS VARCHAR), CAST(i AS VARCHAR), n FROM placed""")
def matter_links(spark: SparkSession, folder: str) -> DataFrame:
    """All orders are linked to their customers; those of status F are linked already, and customers that don't exist can't be."""
    rows = table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("matter_id"), F.col("o_orderkey").cast("string").alias("item_id"), "o_orderkey", "o_orderstatus")
    old = rows.filter("o_orderstatus = 'F'").selectExpr("matter_id", "item_id", "CAST(row_number() OVER (PARTITION BY matter_id ORDER BY o_orderkey) AS BIGINT) AS display_order")
    known = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("matter_id"))
    asked = rows.select("matter_id", "item_id").unionByName(rows.select(F.lit("nobody").alias("matter_id"), "item_id"))
    return matters.linked(old, asked, known, rows.select("item_id"))


@query("""WITH c AS (SELECT o_custkey AS q, o_orderstatus AS b FROM orders GROUP BY ALL), n AS (SELECT q, count(*) AS n FROM c GROUP BY 1)
SELECT q AS query_id, b AS building_id FROM c JOIN n USING (q) WHERE CASE WHEN q % 3 = 0 THEN b = 'O' ELSE n = 1 END""")
def confirmed_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Customers settle on a status of their orders: on O where that was confirmed, else only where there is no other."""
    found = table(spark, folder, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderstatus").alias("building_id"))
    said = table(spark, folder, "customer").select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_custkey") % 3 == 0, "O").alias("building_id"))
    return matters.confirmed(found, "query_id", said).select("query_id", "building_id")


@query("""SELECT upper(c_custkey || '|' || c_mktsegment || '|' || c_nationkey || '|') AS normalized_address, c_custkey || ' ' || c_mktsegment || ' ' || c_nationkey AS display_address, CAST(c_custkey + 1 AS VARCHAR) AS building_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 5 + 1 ELSE 1 END AS revision FROM customer""")
def resolved_identities(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer's address is resolved anew; half of them are known, under an older number."""
    rows = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("house_number"), F.col("c_mktsegment").alias("street_name"), F.col("c_nationkey").cast("string").alias("borough"), F.lit(None).cast("string").alias("zip_code"), (F.col("c_custkey") + 1).cast("string").alias("building_id"), F.lit(None).cast("string").alias("registration_id"), "c_custkey")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    key = T.address_key(F.col("house_number"), F.col("street_name"), F.col("borough"), F.col("zip_code"))
    old = rows.filter("c_custkey % 2 = 0").select(key.alias("normalized_address"), F.lit("old").alias("display_address"), F.lit("0").alias("building_id"), "registration_id", (F.col("c_custkey") % 5).alias("revision"), now.alias("updated_at"))
    return matters.resolved(old, rows, now).select("normalized_address", "display_address", "building_id", "revision")


@query("""WITH a AS (SELECT conv_id, list(DISTINCT turn ORDER BY turn) AS turns FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(list_filter(turns, lambda t: t % 2 = 0), ',') AS valid, CASE WHEN conv_id % 4 = 0 THEN 'status,term:the' ELSE '' END AS failures, CASE WHEN conv_id % 4 = 0 THEN FALSE ELSE conv_id % 5 <> 1 END AS passes FROM a""")
def answer_expectations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as answers: the turns they cite, of which even ones were retrieved, and a case for each."""
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).cast("array<string>").alias("turns"))
    k, none = F.col("conv_id"), F.lit(None).cast("string")
    cited = F.array(F.struct(F.lit("Code § 1").alias("citation"), F.lit("Code").alias("source_name"), F.lit("law").alias("source_type")))
    cases = rows.select(
        "conv_id", "turns", F.when(k % 4 == 0, "answered").alias("expected_status"), F.lit(1).alias("min_citation_count"), F.lit("co").alias("required_source_name_contains"), F.lit("law").alias("required_source_type"), none.alias("required_citation_contains"),
        F.when(k % 4 == 0, F.array(F.lit("the"))).alias("required_answer_terms"), F.lit("An answer.").alias("answer"), F.lit("refused").alias("answer_status"), cited.alias("citations"),
    )
    even = F.filter("turns", lambda t: t.cast("long") % 2 == 0)
    passes = answers.case_passes(F.lit("cite"), F.when(k % 4 == 0, "refused").otherwise("answered"), F.array(F.lit("a")), F.when(k % 5 == 1, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"))), none, F.array().cast("array<string>"))
    return answers.failed_expectations(cases).select("conv_id", F.array_join(answers.valid_citations(F.col("turns"), even), ",").alias("valid"), F.array_join("failures", ",").alias("failures"), passes.alias("passes"))


@query("SELECT 'documents' AS \"table\", count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages")
def table_totals(spark: SparkSession, folder: str) -> DataFrame:
    return audit.totals({t: table(spark, folder, t) for t in ("documents", "labels", "pages")})


@query("SELECT source, count(*) AS chunks, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS embedded, CAST(coalesce(sum(length(text)) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)), 0) AS BIGINT) AS missing_chars FROM documents GROUP BY 1")
def missing_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return audit.missing_characters(table(spark, folder, "documents"), table(spark, folder, "labels"), "source", "doc_id", "text").drop("tokens")


@query("SELECT source AS slug, CASE WHEN count(*) FILTER (WHERE lang = 'fr') = 0 AND source < 'src5' THEN 'ingest' WHEN count(*) FILTER (WHERE lang = 'fr') = 0 THEN 'disabled' WHEN count(*) FILTER (WHERE contains(text, '###')) > 0 THEN 'parse' ELSE 'none' END AS action FROM documents WHERE source IS NOT NULL GROUP BY 1")
def source_repairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").filter("source IS NOT NULL").groupBy(F.col("source").alias("slug")).agg(F.count_if(F.col("lang") == "fr").alias("chunks"), F.count_if(F.contains("text", F.lit("###"))).alias("dirty"))
    return audit.repairs(rows.select("slug", "chunks", F.lit(0).alias("missing_citations"), "dirty", F.lit(0).alias("whole_pages"), (F.col("slug") < "src5").alias("automated")))


@query("""WITH v AS (SELECT o_custkey AS s, o_orderkey AS v, o_orderdate AS d, o_orderstatus = 'O' AS new FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d DESC, v DESC) AS place FROM v WHERE new), o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d DESC, v DESC) AS place FROM v WHERE NOT new)
SELECT s, v, place = 1 AS is_current FROM n UNION ALL SELECT s, v, place = 1 AND s NOT IN (SELECT s FROM n) FROM o""")
def demoted_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as versions of customers; the open ones come new, and the newest of them is current instead of the old one."""
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("s"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("retrieved_at"), "o_orderstatus")
    old = rows.filter("o_orderstatus <> 'O'").selectExpr("s", "version_id", "retrieved_at", "row_number() OVER (PARTITION BY s ORDER BY retrieved_at DESC, version_id DESC) = 1 AS is_current")
    return audit.demoted(old, rows.filter("o_orderstatus = 'O'").select("s", "version_id", "retrieved_at"), "s").select("s", F.col("version_id").alias("v"), "is_current")


def _corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents as sections of their sources: manifests and sections."""
    rows = table(spark, folder, "documents").filter("source IS NOT NULL")
    sources = rows.select(F.col("source").alias("slug")).distinct()
    given = sources.select(
        "slug", F.upper("slug").alias("name"), F.lit("guidance").alias("source_type"), F.lit("City").alias("publisher"), F.lit("nyc").alias("jurisdiction"), F.concat(F.lit("https://e.org/"), "slug").alias("source_url"),
        F.lit("1").alias("parser_version"), F.lit("core").alias("origin"), F.lit(True).alias("model_use_allowed"), F.array().cast("array<string>").alias("required_citations"), F.lit(1).alias("minimum_documents"),
    )
    key = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    parts = rows.filter("trim(text) <> ''").select(
        F.col("source").alias("slug"), F.sha2("source", 256).alias("content_hash"), F.coalesce("lang", F.lit("none")).alias("document"), F.col("lang").alias("document_title"), F.lit(None).cast("string").alias("document_url"),
        key.alias("section_key"), F.lit(None).cast("string").alias("citation"), F.substring("text", 1, 20).alias("title"), "text", F.col("doc_id").alias("place"),
    )
    return given, parts


@query("""WITH d AS (SELECT * FROM documents WHERE source IS NOT NULL AND trim(text, ' ') <> '') SELECT source AS slug, count(*) AS chunks, count(DISTINCT coalesce(lang, 'none')) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, 'text_ready' AS readiness, 0 AS faults FROM d GROUP BY 1""")
def snapshot_publish(spark: SparkSession, folder: str) -> DataFrame:
    """Documents installed as a corpus: checked, stored, published, and read again through the active generation."""
    out = new_folder(spark, "corpus")
    entry = corpus.install(spark, out, *_corpus(spark, folder), F.lit("2024-01-01").cast("timestamp"), [])
    found = corpus.generation(spark, out)
    rows = found["chunks"].join(relations.few(found["versions"].select("version_id", "slug")), "version_id")
    counts = rows.groupBy("slug").agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"), F.sum(F.length("text")).alias("chars"))
    return counts.select("*", F.lit(entry["readiness"]).alias("readiness"), F.lit(corpus.faults(found).count()).alias("faults"))


@query("""WITH d AS (SELECT * FROM documents WHERE source IS NOT NULL AND trim(text, ' ') <> '') SELECT source AS slug, doc_id, sha256(text) AS text_hash FROM d""")
def bundle_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus exported as a bundle and imported into an empty one: the same chunks arrive."""
    out, bundle, there = (new_folder(spark, n) for n in ("corpus", "bundle", "corpus"))
    corpus.install(spark, out, *_corpus(spark, folder), F.lit("2024-01-01").cast("timestamp"), [])
    corpus.export_bundle(spark, out, bundle)
    corpus.import_bundle(spark, there, bundle, [])
    found = corpus.generation(spark, there)
    rows = found["chunks"].join(relations.few(found["versions"].select("version_id", "slug")), "version_id")
    return rows.select("slug", F.col("stable_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("text_hash"))


@query("""SELECT slug, CASE WHEN n < 2 THEN 'too_few_documents' ELSE '' END || CASE WHEN slug = 'src3' THEN CASE WHEN n < 2 THEN ',' ELSE '' END || 'missing:x' ELSE '' END AS problems FROM (SELECT source AS slug, count(DISTINCT coalesce(lang, 'none')) AS n FROM documents WHERE source IS NOT NULL AND trim(text, ' ') <> '' GROUP BY 1)""")
def source_problems(spark: SparkSession, folder: str) -> DataFrame:
    given, parts = _corpus(spark, folder)
    strict = given.withColumn("minimum_documents", F.lit(2)).withColumn("required_citations", F.when(F.col("slug") == "src3", F.array(F.lit("x"))).otherwise(F.col("required_citations")))
    return corpus.problems(strict.join(parts.select("slug").distinct(), "slug", "left_semi"), parts).select("slug", F.array_join("problems", ",").alias("problems"))


@query("SELECT d.doc_id, l.quality = 1 AS keep, 'src' || (d.doc_id % 20) AS source_slug, round(length(text) / 4.0, 2) AS tokens FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND (lang IS NULL OR lang NOT IN ('de', 'fr'))")
def listed_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of an allowlist whose class isn't among those hidden."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    kept = audit.not_hidden(audit.allowed(rows, "quality", [1]), "lang", ["de", "fr"])
    return kept.select("doc_id", (F.col("quality") == 1).alias("keep"), F.concat(F.lit("src"), F.col("doc_id") % 20).alias("source_slug"), F.round(F.length("text") / 4, 2).alias("tokens"))
