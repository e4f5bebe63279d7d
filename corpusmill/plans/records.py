"""Queries over property records, ledgers, events and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import audit, compare, ledger, property, relations
from corpusmill.plans.registry import query
from corpusmill.sources import tables
from corpusmill.sources.tables import table

V = """WITH v AS (SELECT o_orderkey AS violation_id, o_custkey AS building_id, o_orderstatus AS status, o_orderpriority AS class,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS inspection_date, r_name AS borough, CAST(o_custkey % 100 AS VARCHAR) AS house_number, c_mktsegment || ' St' AS street_name
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
L = """WITH l AS (SELECT user_id AS attempt_id, CASE event_type WHEN 'view' THEN 'reserve' WHEN 'error' THEN 'uncertain' WHEN 'purchase' THEN 'settle' WHEN 'signup' THEN 'correction' END AS event_type, event_id, ts,
  CAST(floor(value * 100) AS DECIMAL(18,8)) AS amount, CASE event_type WHEN 'view' THEN 'reserved' WHEN 'error' THEN 'uncertain' WHEN 'purchase' THEN 'settled' WHEN 'signup' THEN 'settled' END AS status
  FROM events WHERE event_type IN ('view', 'error', 'purchase', 'signup')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY CASE event_type WHEN 'reserve' THEN 1 WHEN 'uncertain' THEN 2 WHEN 'settle' THEN 3 ELSE 4 END DESC, ts DESC, event_id DESC) AS place FROM l),
states AS (SELECT r.attempt_id, reserved_at, event_type AS final_type, status, amount FROM ranked r JOIN (SELECT attempt_id, max(ts) AS reserved_at FROM l WHERE event_type = 'reserve' GROUP BY 1) USING (attempt_id) WHERE place = 1)"""
ORDER = "ORDER BY inspection_date DESC NULLS LAST, violation_id"


def _v(spark: SparkSession, folder: str) -> DataFrame:
    return tables.violations(spark, folder)


@query(V + f""", f AS (SELECT * FROM v WHERE upper(borough) = 'ASIA' AND upper(class) = '1-URGENT' AND status = 'O' AND inspection_date >= TIMESTAMP '1996-01-01' AND inspection_date < TIMESTAMP '1998-01-01'),
n AS (SELECT *, row_number() OVER ({ORDER}) AS position, count(*) OVER () > 25 AS has_more FROM f) SELECT violation_id, building_id, inspection_date, CAST(position AS INTEGER) AS position, has_more FROM n WHERE position <= 25""")
def property_filter_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = _v(spark, folder).filter(property.identity(borough="ASIA") & property.page_filter("1-urgent", "O", "1996-01-01", "1997-12-31"))
    return property.page(rows, 25).select("violation_id", "building_id", "inspection_date", "position", "has_more")


@query(V + f""", f AS (SELECT * FROM v WHERE inspection_date < TIMESTAMP '1995-06-15' OR (inspection_date = TIMESTAMP '1995-06-15' AND violation_id > 100) OR inspection_date IS NULL),
n AS (SELECT *, row_number() OVER ({ORDER}) AS position FROM f) SELECT violation_id, inspection_date, CAST(position AS INTEGER) AS position FROM n WHERE position <= 50""")
def property_keyset_next(spark: SparkSession, folder: str) -> DataFrame:
    return property.page(_v(spark, folder), 50, ("1995-06-15", 100)).select("violation_id", "inspection_date", "position")


@query(V + f""", n AS (SELECT *, row_number() OVER ({ORDER}) AS position FROM v WHERE inspection_date IS NULL AND violation_id > 1000) SELECT violation_id, CAST(position AS INTEGER) AS position FROM n WHERE position <= 20""")
def property_undated_page(spark: SparkSession, folder: str) -> DataFrame:
    return property.page(_v(spark, folder), 20, (None, 1000)).select("violation_id", "position")


@query(V + " SELECT DISTINCT building_id, borough, house_number, street_name FROM v WHERE borough = 'EUROPE' ORDER BY ALL LIMIT 101")
def property_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return property.candidates(_v(spark, folder).filter(property.identity(borough="EUROPE")), "building_id", "borough", "house_number", "street_name")


@query(V + """, a AS (SELECT *, nullif(regexp_replace(upper(house_number), '[^A-Z0-9]', '', 'g'), '') AS h, nullif(regexp_replace(upper(street_name), '[^A-Z0-9]', '', 'g'), '') AS s FROM v)
SELECT violation_id, building_id FROM a WHERE h || ' ' || s = '12 BUILDINGST' OR (h = '12' AND contains(s, 'BUILDINGST')) OR (house_number = '12' AND street_name ILIKE '%building st%') OR (house_number || ' ' || street_name) ILIKE '%12 building st%'""")
def address_or_match(spark: SparkSession, folder: str) -> DataFrame:
    return _v(spark, folder).filter(property.address_match("12", "building st")).select("violation_id", "building_id")


@query(V + """ SELECT status, class, count(*) AS total, min(inspection_date) AS first_date FROM v WHERE borough ILIKE 'a%' AND status ILIKE '_' GROUP BY ALL""")
def ilike_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _v(spark, folder).filter(F.col("borough").ilike("a%") & F.col("status").ilike("_"))
    return rows.groupBy("status", "class").agg(F.count("*").alias("total"), F.min("inspection_date").alias("first_date"))


@query(f"{V} SELECT violation_id, inspection_date, row_number() OVER ({ORDER}) AS position FROM v")
def nulls_last_order(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with their place in the order, those without a date last."""
    rows = _v(spark, folder).select("violation_id", "inspection_date")
    return relations.numbered(rows, [F.desc_nulls_last("inspection_date"), F.asc("violation_id")], "position")


@query("""SELECT c_custkey AS building_id, upper(c_name) AS name, nullif(regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g'), '') AS name_part,
  concat_ws('|', upper(trim(c_mktsegment)), '', upper(trim(c_name))) AS address_key FROM customer""")
def address_normalize(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer")
    return rows.select(F.col("c_custkey").alias("building_id"), F.upper("c_name").alias("name"), T.address_part(F.col("c_name")).alias("name_part"), T.address_key(F.col("c_mktsegment"), F.lit(None).cast("string"), F.col("c_name")).alias("address_key"))


_FEED = """f AS (SELECT l_orderkey AS k, l_linenumber AS n, l_shipdate AS d, l_linestatus AS s, l_quantity AS q FROM lineitem WHERE l_linestatus = 'O'),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC, n DESC) AS place FROM f) WHERE place = 1)"""


def _feed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_shipdate").alias("d"), F.col("l_linestatus").alias("s"))


@query(f"WITH {_FEED}, old AS (SELECT o_orderkey AS k, o_orderdate AS d, o_orderstatus AS s FROM orders WHERE o_orderpriority <> '1-URGENT') SELECT k, d, s FROM newest UNION ALL SELECT k, d, s FROM old WHERE k NOT IN (SELECT k FROM newest)")
def upsert_merge(spark: SparkSession, folder: str) -> DataFrame:
    old = table(spark, folder, "orders").filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_orderstatus").alias("s"))
    return relations.upsert(old, _feed(spark, folder), ["k"], [F.desc("d"), F.desc("n")])


@query(f"WITH {_FEED} SELECT count(*) FILTER (WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT')) AS created, count(*) FILTER (WHERE k IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT')) AS updated FROM newest")
def upsert_counts(spark: SparkSession, folder: str) -> DataFrame:
    old = table(spark, folder, "orders").filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("k"))
    return relations.upsert_counts(old, _feed(spark, folder), ["k"])


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return relations.latest_per_key(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def first_wins_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return property.first_across_pages(rows, "l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1")
def last_wins_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber").withColumn("position", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return property.last_per_building(rows, "l_suppkey", "position").drop("position")


@query(V + """ SELECT violation_id, label, date FROM (SELECT violation_id, 'inspected' AS label, inspection_date AS date FROM v UNION ALL
  SELECT l_orderkey, 'shipped ' || CAST(l_linenumber AS VARCHAR), max(l_shipdate) FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE date IS NOT NULL""")
def unpivot_timeline(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("violation_id")).pivot("l_linenumber", list(range(1, 8))).agg(F.max("l_shipdate"))
    rows = _v(spark, folder).select("violation_id", "inspection_date").join(lines, "violation_id", "full")
    return property.timeline(rows, "violation_id", {"inspection_date": "inspected"} | {str(n): f"shipped {n}" for n in range(1, 8)})


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(spark: SparkSession, folder: str) -> DataFrame:
    return relations.missing(table(spark, folder, "documents").select("doc_id", "source"), table(spark, folder, "labels"), ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def semi_member(spark: SparkSession, folder: str) -> DataFrame:
    """Members of a generation that the index lacks."""
    rows = table(spark, folder, "documents").select("doc_id", "source")
    return relations.unindexed(rows, table(spark, folder, "labels").filter("quality = 1"), table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("SELECT doc_id FROM documents LEFT JOIN (SELECT doc_id, sha256(text || CASE WHEN lang = 'de' THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) k USING (doc_id) WHERE sha256(text) IS DISTINCT FROM k.h")
def stale_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    labelled = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    known = labelled.select("doc_id", F.sha2(F.concat("text", F.when(F.col("lang") == "de", "x").otherwise("")), 256).alias("text_hash"))
    return relations.stale(rows, known, "doc_id", "text_hash").select("doc_id")


@query("""SELECT (SELECT count(*) FROM region WHERE r_name <> 'ASIA') AS modules, (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') AS versions,
  (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') AS documents,
  (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') AS chunks""")
def bundle_closure(spark: SparkSession, folder: str) -> DataFrame:
    modules = table(spark, folder, "region").filter("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("module_id"))
    versions = table(spark, folder, "nation").select(F.col("n_nationkey").alias("version_id"), F.col("n_regionkey").alias("module_id"))
    documents = table(spark, folder, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("version_id"))
    parts = relations.closure(modules, versions, documents, table(spark, folder, "orders").select(F.col("o_custkey").alias("document_id")))
    counts = [df.agg(F.count("*").alias(name)) for name, df in parts.items()]  # one row each
    out = counts[0]
    for more in counts[1:]:
        out = out.join(F.broadcast(more))
    return out


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT')")
def broken_references(spark: SparkSession, folder: str) -> DataFrame:
    parents = table(spark, folder, "orders").filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return relations.broken_references(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), parents, "l_orderkey")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 = 0")
def bundle_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    old = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderdate").alias("d"))
    new = old.withColumn("s", F.when(F.col("k") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("s")))
    return relations.conflicts(old, new, "k")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47)")
def source_deletions(spark: SparkSession, folder: str) -> DataFrame:
    new = table(spark, folder, "lineitem").filter("l_quantity > 47").select(F.col("l_partkey").alias("p_partkey"))
    return relations.deletions(table(spark, folder, "part"), new, ["p_partkey"])


@query("SELECT p_size, p_brand, p_partkey FROM (SELECT p_size, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_brand END AS p_brand, p_partkey FROM part) QUALIFY row_number() OVER (PARTITION BY p_size, lower(p_brand) ORDER BY p_partkey) = 1")
def tag_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_size", F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("p_brand"), "p_partkey")
    return relations.case_insensitive_distinct(rows, "p_size", "p_brand", "p_partkey")


@query("WITH old AS (SELECT o_custkey AS k, max(o_orderkey % 10) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o_custkey AS k, o_orderkey AS item, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS display_order FROM orders LEFT JOIN old ON k = o_custkey WHERE o_orderstatus <> 'F'")
def append_display_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("item"), "o_orderstatus")
    old = rows.filter("o_orderstatus = 'F'").withColumn("display_order", F.col("item") % 10)
    return relations.append_order(old, rows.filter("o_orderstatus <> 'F'").drop("o_orderstatus"), "k", "item").withColumn("display_order", F.col("display_order").cast("long"))


@query("""WITH a AS (SELECT source, list(DISTINCT lang) AS langs FROM documents GROUP BY 1) SELECT source, array_to_string(list_sort(list_filter(['de', 'en', 'es', 'fr', 'it', 'pt'], lambda x: NOT list_contains(langs, x))), ',') AS missing,
  list_contains(langs, 'en') AND list_contains(langs, 'fr') AS has_core, array_to_string(list_sort(list_intersect(langs, ['de', 'fr', 'xx'])), ',') AS shared FROM a""")
def coverage_sets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    wanted = F.array(*map(F.lit, ("de", "en", "es", "fr", "it", "pt")))
    core = F.array(F.lit("en"), F.lit("fr"))
    shared = F.array_intersect("langs", F.array(*map(F.lit, ("de", "fr", "xx"))))
    return rows.select("source", F.array_join(relations.array_difference(wanted, F.col("langs")), ",").alias("missing"), relations.is_subset(core, F.col("langs")).alias("has_core"), F.array_join(F.array_sort(shared), ",").alias("shared"))


@query(L + " SELECT attempt_id, reserved_at, final_type, status, CAST(amount AS DOUBLE) AS amount FROM states")
def ledger_state(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.attempt_states(tables.ledger(spark, folder)).withColumn("amount", F.col("amount").cast("double"))


@query(L + """, m AS (SELECT strftime((reserved_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m') AS month, sum(CASE WHEN status = 'settled' THEN amount ELSE 0 END) AS settled, sum(CASE WHEN status = 'uncertain' THEN amount ELSE 0 END) AS uncertain, sum(CASE WHEN status = 'reserved' THEN amount ELSE 0 END) AS reserved, sum(amount) AS used FROM states GROUP BY 1)
SELECT month, CAST(settled AS DOUBLE) AS settled, CAST(uncertain AS DOUBLE) AS uncertain, CAST(reserved AS DOUBLE) AS reserved, CAST(used AS DOUBLE) AS used, CAST(greatest(0, 1000000 - used) AS DOUBLE) AS remaining FROM m""")
def ledger_month_summary(spark: SparkSession, folder: str) -> DataFrame:
    sums = ledger.month_summary(ledger.attempt_states(tables.ledger(spark, folder)), 1_000_000, "America/New_York")
    return sums.select("month", *(F.col(c).cast("double").alias(c) for c in ("settled", "uncertain", "reserved", "used", "remaining")))


@query(L + """ SELECT CAST(sum(CASE WHEN strftime(reserved_at, '%Y-%m') = '2024-01' THEN amount ELSE 0 END) AS DOUBLE) AS month_total, CAST(sum(CASE WHEN strftime(reserved_at, '%Y-%m') < '2024-01' AND status IN ('reserved', 'uncertain') THEN amount ELSE 0 END) AS DOUBLE) AS outstanding, count(*) FILTER (WHERE status = 'reserved') AS unresolved FROM states""")
def admission_totals(spark: SparkSession, folder: str) -> DataFrame:
    states = ledger.attempt_states(tables.ledger(spark, folder)).withColumn("m", F.date_format("reserved_at", "yyyy-MM"))
    total = lambda test: F.sum(F.when(test, F.col("amount")).otherwise(0)).cast("double")
    return states.agg(total(F.col("m") == "2024-01").alias("month_total"), total((F.col("m") < "2024-01") & F.col("status").isin("reserved", "uncertain")).alias("outstanding"), F.count_if(F.col("status") == "reserved").alias("unresolved"))


@query(L + """, g AS (SELECT attempt_id, bool_or(event_type IN ('settle', 'correction')) AS done, max(ts) AS last, min(ts) FILTER (WHERE event_type = 'reserve') AS reserved FROM l GROUP BY 1)
SELECT attempt_id, CASE WHEN reserved IS NULL OR NOT done THEN 'unresolved' WHEN strftime(reserved, '%Y-%m') = '2024-01' THEN 'current' WHEN last < TIMESTAMP '2024-01-25' THEN 'remove' ELSE 'keep' END AS decision FROM g""")
def usage_retention(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.retention(tables.ledger(spark, folder), "2024-01-25", "2024-01")


@query("SELECT event_id, count(*) OVER w AS in_window, min(ts) OVER w AS oldest, count(*) OVER w <= 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW)")
def rate_window(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.window_decisions(table(spark, folder, "events"), ["user_id", "event_type"], "ts", 86_400, 3).select("event_id", "in_window", "oldest", "allowed")


@query("""WITH e AS (SELECT event_id AS cache_key, ts AS last_accessed, CAST(floor(value * 100) AS BIGINT) AS size_bytes, event_type = 'signup' AS pinned FROM events), t AS (SELECT sum(size_bytes) AS total FROM e),
p AS (SELECT cache_key, coalesce(sum(size_bytes) OVER (ORDER BY last_accessed, cache_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e WHERE NOT pinned) SELECT cache_key FROM p, t WHERE total - before > 20000""")
def lru_evict(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "events").select(F.col("event_id").alias("cache_key"), F.col("ts").alias("last_accessed"), F.floor(F.col("value") * 100).alias("size_bytes"), (F.col("event_type") == "signup").alias("pinned"))
    return ledger.evictions(entries, 20_000).select("cache_key")


@query("SELECT user_id, count(*) AS n_references FROM events GROUP BY 1 HAVING bool_and(ts < TIMESTAMP '2024-01-20' OR event_type <> 'purchase')")
def refcount_prune(spark: SparkSession, folder: str) -> DataFrame:
    candidate = (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) | (F.col("event_type") != "purchase")
    return ledger.unreferenced(table(spark, folder, "events"), "user_id", candidate)


@query("SELECT event_id, CASE WHEN epoch(TIMESTAMP '2024-01-20' - ts) < CASE WHEN event_type = 'view' THEN 3600 ELSE 86400 END THEN 'fresh' WHEN epoch(TIMESTAMP '2024-01-20' - ts) < CASE WHEN event_type = 'view' THEN 3600 ELSE 86400 END + 604800 THEN 'stale' ELSE 'expired' END AS state FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events)")
def cache_freshness(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "events").withColumnRenamed("ts", "fetched_at")
    ttl = F.when(F.col("event_type") == "view", 3600).otherwise(86_400)
    return ledger.freshness(entries, F.lit("2024-01-20").cast("timestamp_ntz"), ttl, 604_800).select("event_id", "state")


@query("SELECT date_trunc('day', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, folder: str) -> DataFrame:
    return audit.counts_by(table(spark, folder, "events"), "ts", "day", "event_type")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.n""")
def session_counts(spark: SparkSession, folder: str) -> DataFrame:
    return audit.sessions(table(spark, folder, "events"), "user_id", "ts", "6 hours")


@query("SELECT event_type, sum(ceil(value / 3)) AS cost, coalesce(sum(CASE WHEN value > 1e9 THEN value END), 0) AS none, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k, sum(CASE WHEN json_extract_string(props, '$.cost_known') = 'false' THEN 0 ELSE 1 END) AS known FROM events GROUP BY 1")
def json_flag(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    known = F.sum(F.when(T.json_flag(F.col("props"), "cost_known"), 1).otherwise(0))
    none = F.coalesce(F.sum(F.when(F.col("value") > 1e9, F.col("value"))), F.lit(0.0))
    return rows.groupBy("event_type").agg(F.sum(F.ceil(F.col("value") / 3)).cast("double").alias("cost"), none.alias("none"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), known.alias("known"))


@query(V + " SELECT borough, status, class, count(*) AS n, grouping(borough, status, class) AS level FROM v GROUP BY ROLLUP (borough, status, class)")
def rollup_status_class(spark: SparkSession, folder: str) -> DataFrame:
    return audit.rolled_up(_v(spark, folder), "borough", "status", "class")


@query(V + ", s AS (SELECT borough, building_id, count(*) AS metric FROM v WHERE status <> 'F' GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY borough ORDER BY metric DESC) AS rank FROM s) SELECT borough, building_id, metric, rank FROM r WHERE rank <= 5")
def rank_buildings(spark: SparkSession, folder: str) -> DataFrame:
    return audit.ranked_groups(_v(spark, folder).filter("status <> 'F'"), ["building_id"], F.count("*"), ["borough"], 5)


@query(V + " SELECT date_trunc('month', inspection_date) AS bucket, borough, class, count(*) AS n FROM v WHERE inspection_date >= TIMESTAMP '1996-01-01' GROUP BY ALL")
def citywide_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A template with bound values; nothing is pasted into the SQL."""
    _v(spark, folder).createOrReplaceTempView("_violations")
    sql = "SELECT cast(date_trunc('month', inspection_date) AS timestamp_ntz) AS bucket, borough, class, count(*) AS n FROM _violations WHERE inspection_date >= cast(:start AS timestamp_ntz) GROUP BY ALL"
    return spark.sql(sql, args={"start": "1996-01-01"})


@query(V + " SELECT max(inspection_date) FILTER (WHERE inspection_date <= TIMESTAMP '1997-01-01') AS watermark, count(*) FILTER (WHERE inspection_date > TIMESTAMP '1997-01-01') AS quarantined FROM v")
def plausible_watermark(spark: SparkSession, folder: str) -> DataFrame:
    return audit.plausible_watermark(_v(spark, folder), "inspection_date", "1997-01-01")


@query("SELECT o_orderstatus, quantile_disc(o_totalprice, 0.95) AS value FROM orders GROUP BY 1")
def percentile_nearest_rank(spark: SparkSession, folder: str) -> DataFrame:
    return audit.nearest_rank(table(spark, folder, "orders"), "o_totalprice", 0.95, "o_orderstatus")


@query("SELECT count(DISTINCT source) AS all_sources, count(DISTINCT CASE WHEN lang = 'de' AND contains(text, '###') THEN source END) AS scope_sources FROM documents")
def distinct_scopes(spark: SparkSession, folder: str) -> DataFrame:
    return audit.scope_counts(table(spark, folder, "documents"), "source", (F.col("lang") == "de") & F.contains("text", F.lit("###")))


@query("""WITH m AS (SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels) AS i, doc_id IN (SELECT vec_id FROM embeddings) AS e FROM documents)
SELECT source, count(*) AS chunks, count(*) FILTER (WHERE i) AS indexed, count(*) FILTER (WHERE e) AS embedded, count(*) = count(*) FILTER (WHERE i) AND count(*) = count(*) FILTER (WHERE e) AS complete FROM m GROUP BY 1""")
def snapshot_verify(spark: SparkSession, folder: str) -> DataFrame:
    embedded = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return audit.snapshot_counts(table(spark, folder, "documents").select("doc_id", "source"), table(spark, folder, "labels"), embedded, "source", "doc_id")


@query("SELECT s_name, n_name, greatest(s_acctbal, 0) AS quota FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def quota_defaults(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier").filter("s_acctbal > 5000")
    joined = table(spark, folder, "nation").join(suppliers, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("s_name", "n_name", F.when(F.col("s_acctbal").isNotNull(), F.greatest("s_acctbal", F.lit(0.0))).otherwise(0.0).alias("quota"))


@query("WITH r AS (SELECT source, lang, count(*) AS n, bool_and(doc_id IN (SELECT doc_id FROM labels)) AS reviewed FROM documents GROUP BY ALL) SELECT source, sum(n) AS total, count(*) AS parts, sum(CASE WHEN reviewed THEN 1 ELSE 0 END) AS done, CASE WHEN bool_and(reviewed) THEN 'installed' WHEN bool_or(reviewed) THEN 'partial' ELSE 'missing' END AS status FROM r GROUP BY 1")
def pack_status(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    parts = table(spark, folder, "documents").join(labels, "doc_id", "left").groupBy("source", "lang").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("reviewed"))
    status = F.when(F.bool_and("reviewed"), "installed").when(F.bool_or("reviewed"), "partial").otherwise("missing")
    return parts.groupBy("source").agg(F.sum("n").alias("total"), F.count("*").alias("parts"), F.sum(F.when(F.col("reviewed"), 1).otherwise(0)).alias("done"), status.alias("status"))
