"""Data-quality audits, evaluation figures and aggregates over property records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.operations import section_number
from corpusmill.operators.relations import latest_per_key


def length_statistics(rows: DataFrame, by: str, text: str) -> DataFrame:
    """Per group: number of texts and their least, largest and mean length."""
    n = F.length(text)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.round(F.avg(n), 2).alias("avg_length"))


def marked(rows: DataFrame, by: str, text: str, markers: list[str]) -> DataFrame:
    """Per group: rows whose text holds any of the markers."""
    test = F.lit(False)
    for m in markers:
        test = test | F.contains(F.col(text), F.lit(m))
    return rows.groupBy(by).agg(F.count_if(test).alias("n_marked"), F.count("*").alias("n"))


def without_own_citation(chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """Chunks that name a citation which isn't among their citations."""
    own = citations.select("chunk_id", F.col("normalized_citation").alias("citation"))
    return chunks.filter(F.col("citation").isNotNull()).join(own, ["chunk_id", "citation"], "left_anti")


def scope_counts(rows: DataFrame, source: str, scope: Column) -> DataFrame:
    """Distinct sources overall and within the scope, in one pass."""
    return rows.agg(F.count_distinct(source).alias("all_sources"), F.count_distinct(F.when(scope, F.col(source))).alias("scope_sources"))


def snapshot_counts(members: DataFrame, index: DataFrame, embeddings: DataFrame, generation: str, key: str) -> DataFrame:
    """Per generation: chunks, indexed chunks, embedded chunks, and whether all three agree."""
    rows = members.join(index.select(key).distinct().withColumn("_i", F.lit(1)), key, "left").join(embeddings.select(key).distinct().withColumn("_e", F.lit(1)), key, "left")
    counted = rows.groupBy(generation).agg(F.count("*").alias("chunks"), F.count("_i").alias("indexed"), F.count("_e").alias("embedded"))
    return counted.withColumn("complete", (F.col("chunks") == F.col("indexed")) & (F.col("chunks") == F.col("embedded")))


def retrieval_ranks(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case: the best rank of any expected citation and the rank by which all are found, null if some never are.

    ``ranked``: case_id, citation, rank; ``expected``: case_id, citation.
    """
    best = ranked.groupBy("case_id", "citation").agg(F.min("rank").alias("rank"))
    joined = expected.distinct().join(best, ["case_id", "citation"], "left")
    return joined.groupBy("case_id").agg(F.min("rank").alias("any_rank"), F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("all_rank"))


def recall_and_mrr(ranks: DataFrame, k: int, rank: str = "any_rank") -> DataFrame:
    """Cases, recall at k, and the mean reciprocal rank of hits within k."""
    hit = F.col(rank) <= k
    return ranks.agg(F.count("*").alias("cases"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("recall"), F.avg(F.when(hit, 1.0 / F.col(rank)).otherwise(0.0)).alias("mrr"))


def nearest_rank(rows: DataFrame, value: str, share: float, *by: str) -> DataFrame:
    """The value at the nearest rank of the share, per group."""
    return rows.groupBy(*by).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").alias("value"))


def counts_by(rows: DataFrame, ts: str, unit: str, *by: str) -> DataFrame:
    """Counts per time bucket and group."""
    return rows.groupBy(F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("bucket"), *by).agg(F.count("*").alias("n"))


def rolled_up(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of all prefixes of the grouping, the grand total included; ``level`` tells them apart."""
    return rows.rollup(*by).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def ranked_groups(rows: DataFrame, by: list[str], metric: Column, within: list[str], most: int) -> DataFrame:
    """Groups by a metric, ranked within a wider group; ties share a rank."""
    scored = rows.groupBy(*within, *by).agg(metric.alias("metric"))
    order = Window.partitionBy(*within).orderBy(F.desc("metric"))
    return scored.withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= most)


def plausible_watermark(rows: DataFrame, ts: str, now: str) -> DataFrame:
    """The largest date that isn't in the future, and how many rows were set aside for theirs."""
    limit = F.lit(now).cast("timestamp_ntz")
    return rows.agg(F.max(F.when(F.col(ts) <= limit, F.col(ts))).alias("watermark"), F.count_if(F.col(ts) > limit).alias("quarantined"))


def sessions(events: DataFrame, by: str, ts: str, gap: str) -> DataFrame:
    """Sessions of events that follow each other within the gap."""
    at = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    return at.groupBy(by, F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """table and n, the number of rows of each."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, df in sorted(tables.items())))


def size_and_count(rows: DataFrame, size: str) -> DataFrame:
    """Number of rows and the sum of their sizes, in one row."""
    return rows.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def missing_characters(chunks: DataFrame, embeddings: DataFrame, by: str, key: str, text: str) -> DataFrame:
    """Per source: chunks, embedded ones, and the characters still to be embedded, with their estimated tokens."""
    rows = chunks.join(embeddings.select(key).distinct().withColumn("_e", F.lit(1)), key, "left")
    chars = F.coalesce(F.sum(F.when(F.col("_e").isNull(), F.length(text))), F.lit(0))
    return rows.groupBy(by).agg(F.count("*").alias("chunks"), F.count("_e").alias("embedded"), chars.alias("missing_chars")).withColumn("tokens", F.col("missing_chars") / 4)


def whole_page_chunks(chunks: DataFrame, by: str) -> DataFrame:
    """Per source: sections without a citation that hold a page's full text, which a finer parse would replace."""
    return chunks.groupBy(by).agg(F.count_if(F.col("citation").isNull() & (F.col("title") == "Full Text")).alias("whole_pages"))


def traceability(chunks: DataFrame, versions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row: versions, purged and missing artifacts, chunks, and law and guidance chunks without a citation."""
    there = versions.join(artifacts.select("artifact", F.lit(True).alias("_there")), "artifact", "left")
    kept = there.agg(F.count("*").alias("versions"), F.count("purged_at").alias("purged"), F.count_if(F.col("purged_at").isNull() & F.col("_there").isNull()).alias("missing"))
    uncited = lambda kind: F.count_if((F.col("source_type") == kind) & F.col("citation").isNull()).alias(f"uncited_{kind}")
    return kept.join(F.broadcast(chunks.agg(F.count("*").alias("chunks"), uncited("law"), uncited("guidance"))))


def repairs(audit: DataFrame) -> DataFrame:
    """What to do about each source: ingest one without chunks, unless that is disabled, and parse anew one with faults.

    ``audit``: slug, chunks, missing_citations, dirty, whole_pages, automated.
    """
    faulty = (F.col("missing_citations") > 0) | (F.col("dirty") > 0) | (F.col("whole_pages") > 0)
    action = F.when((F.coalesce("chunks", F.lit(0)) == 0) & F.col("automated"), "ingest").when(F.coalesce("chunks", F.lit(0)) == 0, "disabled").when(faulty, "parse").otherwise("none")
    return audit.select("slug", action.alias("action"))


def current_version(versions: DataFrame, by: str) -> DataFrame:
    """The current version of each source, or else its newest."""
    return latest_per_key(versions, [by], [F.desc("is_current"), F.desc("retrieved_at"), F.desc("version_id")])


def demoted(versions: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Versions after new ones were found: a new one is current and those of its source before it aren't; a known one stays."""
    fresh = new.join(versions.select("version_id"), "version_id", "left_anti")
    newest = fresh.select(by).distinct().withColumn("_new", F.lit(True))
    older = versions.join(newest, by, "left").withColumn("is_current", F.col("is_current") & F.col("_new").isNull()).drop("_new")
    place = Window.partitionBy(by).orderBy(F.desc("retrieved_at"), F.desc("version_id"))
    return older.select(*versions.columns).unionByName(fresh.withColumn("is_current", F.row_number().over(place) == 1).select(*versions.columns))


def source_types(cited: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """The types of the sources that each answer cites."""
    return cited.join(chunks.select("chunk_id", "source_type"), "chunk_id").groupBy(key).agg(F.sort_array(F.collect_set("source_type")).alias("source_types"))


def any_in_scope(rows: DataFrame, scope: Column) -> bool:
    """Whether there is a row in the scope; one is enough to know."""
    return not rows.filter(scope).limit(1).isEmpty()


def range_sections(sections: DataFrame, first: str, last: str) -> DataFrame:
    """Sections whose number lies between two numbers, both included, by their parts; of those with one citation the longest, in order."""
    number = section_number(F.col("citation"))
    inside = sections.filter(number["chapter"].isNotNull() & (number >= section_number(F.lit(first))) & (number <= section_number(F.lit(last))))
    longest = latest_per_key(inside, ["citation"], [F.desc(F.length("text")), F.asc("place")])
    return longest.orderBy(section_number(F.col("citation")))


def override(base: Column, user: Column) -> Column:
    """Two maps as one; what the user says counts."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(user, k)), user)


def distinct_paths(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """The different paths that any of the tables names."""
    return reduce(DataFrame.unionByName, (df.select(F.col(c).alias("path")) for df, c in tables)).filter(F.col("path").isNotNull()).distinct()


def allowed(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is on the list; with an empty list, all."""
    return rows.filter(F.col(column).isin(values)) if values else rows


def not_hidden(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value isn't on the list; rows without a value stay."""
    return rows.filter(~F.coalesce(F.col(column).isin(values), F.lit(False)))
