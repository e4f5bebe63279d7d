"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import (
    centroid_clusters,
    decontamination,
    language_id,
    mixing,
    near_dedup,
    periodic_runs,
    pii,
    quality_model,
    quality_rules,
    secret_scan,
    token_counts,
    token_output,
    url_filters,
)
from corpusmill.llm.common import table


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; see ``quality_model.classify_quality`` for nulls, repeated rows and empty tables."""
    return quality_model.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; a null text counts as empty. See ``pii.personal_data``."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per encoded length; null and empty texts have length 0. See ``token_counts.length_histogram``."""
    return token_counts.length_histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures of all documents; a null text has no words. See ``quality_rules.quality_rules``."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; ``und`` for null texts. See ``language_id.predict``."""
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files and reads them back; null ids come first. See ``token_output.write_tokens``."""
    return token_output.tokenized(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold; null texts hold none. See ``decontamination.contaminated``."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; null texts have fingerprint 0. See ``near_dedup.near_duplicates``."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", near_dedup.hexadecimal(found["fp"]).alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; a null text counts as empty. See ``secret_scan.scan_secrets``."""
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; a null source is one of its own. See ``mixing.mix_sources``."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds. See ``centroid_clusters.clustered`` for nulls, ties and few vectors."""
    return centroid_clusters.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which are made periodic; null texts have none. See ``periodic_runs.periodic_runs``."""
    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; a null url has an empty host and path. See ``url_filters.filter_urls``."""
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_model,
        op2_personal_data,
        op3_token_counts,
        op4_quality_rules,
        op5_language_id,
        op6_token_output,
        op7_decontamination,
        op8_near_dedup,
        op9_secret_scan,
        op10_mix_sources,
        op11_centroid_clusters,
        op12_periodic_runs,
        op13_url_filters,
    )
}
ORACLES: dict[str, str] = {
    "op4_quality_rules": quality_rules.SQL,
    "op10_mix_sources": mixing.SQL,
    "op11_centroid_clusters": centroid_clusters.sql(),
    "op13_url_filters": url_filters.sql(),
}
