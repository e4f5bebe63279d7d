"""Queries over documents, pages and conversations: comparison, parsing, text functions and audits."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from corpusmill.functions import citations, documents, routing, word_files
from corpusmill.functions import text as T
from corpusmill.operators import audit, batches, compare, property
from corpusmill.plans.registry import query
from corpusmill.sources import archives
from corpusmill.sources.shared import new_folder, remove_folder
from corpusmill.sources.tables import chunks, table

_SIDES = r"""WITH a AS (SELECT doc_id, text, source AS citation, substr(text, 1, 20) AS title FROM documents WHERE lang IS DISTINCT FROM 'fr'),
b AS (SELECT CASE WHEN doc_id % 11 = 0 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' more' WHEN doc_id % 3 = 0 THEN replace(text, ' ', '  ') ELSE text END AS text,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE source END AS citation, substr(text, 1, 20) AS title FROM documents),
n AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NULL AS added, b.doc_id IS NULL AS removed, trim(regexp_replace(a.text, '\s+', ' ', 'g')) AS o, trim(regexp_replace(b.text, '\s+', ' ', 'g')) AS w,
  a.citation IS DISTINCT FROM b.citation OR a.title IS DISTINCT FROM b.title AS moved FROM a FULL JOIN b ON a.doc_id = b.doc_id),
c AS (SELECT *, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN o <> w THEN 'text_changed' WHEN moved THEN 'metadata_only' ELSE 'unchanged' END AS k, coalesce(o, w) AS body FROM n),
p AS (SELECT body FROM c WHERE k IN ('added', 'removed') AND body <> '' GROUP BY body HAVING count(*) FILTER (WHERE k = 'added') = 1 AND count(*) FILTER (WHERE k = 'removed') = 1),
r AS (SELECT doc_id, CASE WHEN k IN ('added', 'removed') AND body IN (SELECT body FROM p) THEN 'uncertain' ELSE k END AS classification FROM c)"""


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "documents").select("doc_id", "text", F.col("source").alias("citation"), F.substring("text", 1, 20).alias("title"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" more"))).when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("text"))
    moved = F.when(F.col("doc_id") % 11 == 0, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id"))
    after = rows.select(moved.alias("doc_id"), text.alias("text"), F.when(F.col("doc_id") % 13 != 0, F.col("citation")).alias("citation"), "title")
    before = table(spark, folder, "documents").filter("NOT lang <=> 'fr'").select("doc_id")
    return rows.join(before, "doc_id", "left_semi"), after


@query(_SIDES + " SELECT doc_id, classification, CASE WHEN classification = 'uncertain' THEN 'low' ELSE 'high' END AS certainty FROM r")
def full_outer_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of the documents aligned by id; texts found once on either side are a possible renumbering."""
    return compare.changes(*_versions(spark, folder), "doc_id", "text", ["citation", "title"]).select("doc_id", "classification", "certainty")


@query(_SIDES + " SELECT classification, count(*) AS n FROM r GROUP BY 1")
def diff_class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return compare.changes(*_versions(spark, folder), "doc_id", "text", ["citation", "title"]).groupBy("classification").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT user_id AS item_id, event_id AS chunk_id FROM events), ch AS (SELECT doc_id AS chunk_id FROM documents WHERE lang = 'de')
SELECT item_id, array_to_string(list_sort(list(chunk_id)), ',') AS matching, (SELECT max(ts) FROM events WHERE user_id = item_id AND event_type = 'signup') AS reviewed_at FROM e JOIN ch USING (chunk_id) GROUP BY item_id""")
def comparison_impacts(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    items = events.groupBy(F.col("user_id").alias("item_id")).agg(F.collect_set("event_id").alias("chunk_ids"))
    changed = table(spark, folder, "documents").filter("lang = 'de'").select(F.col("doc_id").alias("chunk_id"))
    reviews = events.filter("event_type = 'signup'").select(F.col("user_id").alias("item_id"), F.col("ts").alias("reviewed_at"))
    found = compare.impacts(items, changed, reviews)
    return found.select("item_id", F.array_join(F.transform("matching_chunk_ids", lambda x: x.cast("string")), ",").alias("matching"), "reviewed_at")


@query("""WITH m AS (SELECT conv_id, role, turn, text FROM conversations)
SELECT 'citation:conv ' || conv_id AS section_key, count(*) AS members, array_to_string(list(CAST(turn AS VARCHAR) ORDER BY turn, text), ',') AS turns, string_agg(text, chr(10) ORDER BY turn, text) AS text, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS text_hash FROM m GROUP BY conv_id""")
def section_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation as the chunks of one section."""
    rows = table(spark, folder, "conversations").select(
        F.col("turn").alias("chunk_id"), F.col("role").alias("title"), "text", "turn",
        compare.canonical_key(F.concat(F.lit(" CONV  "), F.col("conv_id")), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("key"),
    )
    found = compare.sections(rows, "key", "turn")
    return found.select("section_key", F.size("chunk_ids").cast("long").alias("members"), F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("turns"), "text", "text_hash")


@query("SELECT source, count(*) AS n, min(length(text)) AS min_length, max(length(text)) AS max_length, round(avg(length(text)), 2) AS avg_length FROM documents GROUP BY 1")
def length_stats(spark: SparkSession, folder: str) -> DataFrame:
    return audit.length_statistics(table(spark, folder, "documents"), "source", "text")


@query("SELECT source, count(*) FILTER (WHERE contains(text, '###') OR contains(text, '!!') OR contains(text, ' | ')) AS n_marked, count(*) AS n FROM documents GROUP BY 1")
def quality_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.marked(table(spark, folder, "documents"), "source", "text", ["###", "!!", " | "])


@query("SELECT doc_id AS chunk_id, source AS citation FROM documents WHERE NOT (doc_id % 4 = 0)")
def uncited_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunks(spark, folder).select("chunk_id", "citation")
    known = rows.select("chunk_id", F.when(F.col("chunk_id") % 4 == 0, F.col("citation")).otherwise("other").alias("normalized_citation"))
    return audit.without_own_citation(rows, known)


@query("""WITH s AS (SELECT conv_id, turn, text, least(length(text), 300) AS n FROM conversations), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT conv_id, turn, substr(text, 1, CAST(least(n, 700 - before) AS INTEGER)) AS excerpt FROM b WHERE before < 700 AND n > 0""")
def budget_running_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return property.running_excerpts(rows, "conv_id", "turn", "text", 300, 700).select("conv_id", "turn", "excerpt")


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed, CASE WHEN length(text) > 80 THEN regexp_replace(substr(text, 1, 80), '\s+$', '') || '...' ELSE text END AS excerpt,
  greatest(1, octet_length(encode(text))) AS token_bound, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS tokens, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS query_hash FROM documents""")
def text_normalize(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return table(spark, folder, "documents").select("doc_id", T.collapse(text).alias("collapsed"), T.excerpt(text, 80).alias("excerpt"), T.input_token_bound(text).alias("token_bound"), T.estimated_tokens(text).alias("tokens"), T.query_hash(text).alias("query_hash"))


@query(r"""WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '=' || p_name WHEN 1 THEN '  +' || p_name WHEN 2 THEN '@' || p_name ELSE p_name END AS x FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(x, '^\s*[=+@-]') THEN '''' || x ELSE x END AS safe, trim(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM s""")
def csv_guard(spark: SparkSession, folder: str) -> DataFrame:
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    x = F.when(k == 0, F.concat(F.lit("="), n)).when(k == 1, F.concat(F.lit("  +"), n)).when(k == 2, F.concat(F.lit("@"), n)).otherwise(n)
    return table(spark, folder, "part").select("p_partkey", x.alias("x")).select("p_partkey", T.spreadsheet_safe(F.col("x")).alias("safe"), T.slug(F.col("x")).alias("slug"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) WHEN 2 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def lenient_dates(spark: SparkSession, folder: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).when(k == 3, F.date_format(d, "dd/MM/yyyy")).otherwise("")
    return table(spark, folder, "orders").select("o_orderkey", T.lenient_date(text).alias("parsed"))


@query("""SELECT page_id, rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS url, regexp_matches(lower(url), '^https?://[^/?#\\s]+') AS safe, sha256(url || ':' || page_id) AS id FROM pages""")
def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    return table(spark, folder, "pages").select("page_id", T.canonical_url(url).alias("url"), T.safe_web_url(url).alias("safe"), T.stable_id(url, F.col("page_id")).alias("id"))


@query(r"""WITH q AS (SELECT conv_id, turn, lower(text) AS t, text FROM conversations),
f AS (SELECT conv_id, turn, contains(t, 'hpd') OR contains(t, 'violation') OR contains(t, 'building') OR contains(t, 'registration') OR contains(t, 'apartment') OR contains(t, 'property') OR contains(t, 'address') AS named, contains(t, 'violation') OR contains(t, 'building id') OR contains(t, 'registration id') OR contains(t, 'address') AS sought, contains(t, 'section') OR contains(t, '§') OR contains(t, 'rpapl') OR contains(t, 'admin code') OR contains(t, 'housing maintenance code') OR contains(t, 'multiple dwelling law') AS legal,
  regexp_matches(t, '\b(show|list|find|search|lookup|look up|check|see|get)\b') AS verb, regexp_matches(text, '(?i)\b(building|registration)(\s+id)?\s*[:#]?\s*\d+\b') OR regexp_matches(text, '(?i)\b\d+(-\d+)?[a-z]?\s+[a-z][a-z0-9 .''-]*?(\s+(violations?|hpd|open|closed|complaints?|problems?))?\s*$') AS given FROM q)
SELECT conv_id, turn, CASE WHEN named AND given AND NOT legal THEN 'property_signal_with_identifier' WHEN NOT legal AND verb AND sought THEN 'property_lookup_missing_identifier' ELSE 'default_legal' END AS reason FROM f""")
def question_routing(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", routing.route(F.col("text"))["reason"].alias("reason"))


@query("""WITH a AS (SELECT doc_id, 'Apartment ' || doc_id || ' § 27-' || (2000 + doc_id % 50) || ' and MDL 7' || CASE WHEN doc_id % 2 = 0 THEN '8' ELSE '9-a' END AS t FROM documents)
SELECT doc_id, 0 AS ordinal, 'NYC Admin Code § 27-' || (2000 + doc_id % 50) AS normalized_citation, 'nyc_code' AS citation_type FROM a UNION ALL SELECT doc_id, 1, 'Multiple Dwelling Law § 7' || CASE WHEN doc_id % 2 = 0 THEN '8' ELSE '9-A' END, 'ny_law' FROM a""")
def citation_extract(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat(F.lit("Apartment "), k, F.lit(" § 27-"), 2000 + k % 50, F.lit(" and MDL 7"), F.when(k % 2 == 0, "8").otherwise("9-a"))
    found = citations.extract(table(spark, folder, "documents").select("doc_id", text.alias("t")), "t", "doc_id")
    return found.select("doc_id", "ordinal", "normalized_citation", "citation_type")


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM documents),
i AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l),
h AS (SELECT doc_id, lines, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal FROM i WHERE regexp_matches(lines[i], '^(T\w+)'))
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, regexp_extract(lines[i], '^(T\w+)', 1) AS section, array_to_string(lines[i:coalesce(nxt - 1, len(lines))], chr(10)) AS body FROM h""")
def section_split(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that begin with a capital T stand for section headers."""
    return documents.split_at(table(spark, folder, "documents"), "text", r"^(T\w+)", "doc_id")


@query()
def html_sections(spark: SparkSession, folder: str) -> DataFrame:
    return documents.page_sections(table(spark, folder, "pages"), "html", "page_id", "url")


@query()
def greedy_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return documents.chunked(table(spark, folder, "documents"), "text", "doc_id")


@query()
def unified_diff(spark: SparkSession, folder: str) -> DataFrame:
    before, after = _versions(spark, folder)
    joined = before.select("doc_id", F.col("text").alias("a")).join(after.select("doc_id", F.col("text").alias("b")), "doc_id")
    return joined.filter("a <> b").select("doc_id", compare.unified_diff("a", "b").alias("diff"))


@query("SELECT vec_id, 64 AS dimension, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 5) AS squared FROM embeddings")
def vector_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors through their binary form and back."""
    rows = table(spark, folder, "embeddings").select("vec_id", documents.decode_vector(documents.encode_vector("embedding")).alias("v"))
    squared = F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.size("v").alias("dimension"), F.round(squared, 5).alias("squared"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, coalesce(length(text), 0) AS size FROM documents),
t AS (SELECT place, coalesce(sum(size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, size FROM d),
nxt AS (SELECT a.place, min(b.place) AS then FROM t a JOIN t b ON b.place > a.place AND b.place <= a.place + 32 AND (b.place = a.place + 32 OR b.before + b.size - a.before > 20000) GROUP BY 1),
s AS (SELECT CAST(1 AS BIGINT) AS place, CAST(0 AS BIGINT) AS batch UNION ALL SELECT n.then, s.batch + 1 FROM s JOIN nxt n USING (place) WHERE n.then IS NOT NULL)
SELECT doc_id, d.place, s.batch FROM d ASOF JOIN s ON d.place >= s.place""")
def greedy_batches_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by their ids in batches of at most 32 and 20,000 characters, filled one after the other."""
    return batches.greedy_batches(table(spark, folder, "documents"), ["doc_id"], F.length("text"), 32, 20_000)


@query("SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(coalesce(text, '')) AS checksum FROM documents")
def archive_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All texts through one ZIP archive that many tasks write, read back by the places in its manifest."""
    out = new_folder(spark, "archive")
    members = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"))
    back, text = archives.read_members(archives.write_archive(members, f"{out}.zip"), f"{out}.zip"), F.decode("content", "UTF-8")
    rows = back.select(F.col("name").cast("long").alias("doc_id"), F.length(text).cast("long").alias("chars"), F.sha2("content", 256).alias("checksum")).checkpoint()
    remove_folder(spark, f"{out}.zip")
    return rows


_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


@F.pandas_udf(BinaryType())
def _as_word_file(texts: pd.Series, sources: pd.Series) -> pd.Series:
    """A Word file with a paragraph for each line, the first of them a heading, and a table of one row: the source and an empty cell."""

    def one(text: str, source: str) -> bytes:
        paragraph = lambda line, style="": f"<w:p>{style}<w:r><w:t>{escape(line)}</w:t></w:r></w:p>"
        first, *rest = text.split("\n")
        body = paragraph(first, '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + "".join(map(paragraph, rest))
        body += f"<w:tbl><w:tr><w:tc>{paragraph(source)}</w:tc><w:tc>{paragraph('')}</w:tc></w:tr></w:tbl>"
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("[Content_Types].xml", "<Types>application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml</Types>")
            z.writestr("word/document.xml", f"<w:document {_WORD}><w:body>{body}</w:body></w:document>")
        return buffer.getvalue()

    return pd.Series([one(t, s) for t, s in zip(texts, sources, strict=True)])


@query(r"""WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
c AS (SELECT doc_id, n, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM l), h AS (SELECT doc_id, text AS heading FROM c WHERE n = 1),
b AS (SELECT doc_id, 'docx-p-' || printf('%05d', n) AS block_id, text, n AS spot FROM c UNION ALL SELECT doc_id, 'docx-t-0001-r-0001-c-0001', trim(regexp_replace(coalesce(source, ''), '\s+', ' ', 'g')), 1000000000 FROM documents)
SELECT doc_id, block_id, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS INTEGER) AS ordinal, heading FROM b JOIN h USING (doc_id) WHERE text <> ''""")
def word_file_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as Word files, read again: their blocks with ids and the heading above them."""
    files = table(spark, folder, "documents").select("doc_id", _as_word_file(F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))).alias("file"))
    rows = word_files.docx_blocks(files, "file", "doc_id").filter("status = 'ok'")
    return rows.select("doc_id", "block_id", "text", "ordinal", F.array_join("headings", " > ").alias("heading"))
