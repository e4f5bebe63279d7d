"""The documents' way to a training set, stage by stage.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as the next one's
documents; all but the last keep the columns of ``documents``, whatever further columns there are. An empty table stays
empty through all stages. A stage's folder is removed once the next stage is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontamination, mixing, near_copies, quality_rules, token_output
from corpusmill.llm.common import new_folder, remove_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, repeated rows stay or go together."""
    return quality_rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by five-word shingles with a similarity of 0.8 or more.

    Texts whose SimHash fingerprints link and texts that share MinHash bands are compared on their whole sets. Null and empty
    texts are copies of one another; of repeated rows one stays; a null id leads only where there is no other.
    """
    return near_copies.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, nor does any text if the benchmark is empty."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: a row for each time, so some go and some repeat.

    Documents without words go; a null source is a source of its own.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files; a row for each document in them: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone; null ids come first; repeated rows are documents of their own.
    """
    return token_output.tokenized(docs)


STAGES = [("quality_rules", keep_good), ("near_dedup", drop_copies), ("decontamination", drop_leaks), ("mix_sources", mix), ("token_output", tokenize)]

#: SQL can't express the fingerprints or the tokens; tests compare the stages with plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over ``documents``. The last stage has written its files by the time it returns."""
    docs, folder = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before, folder = folder, new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove_folder(spark, before)
    result = STAGES[-1][1](spark, docs, sf_dir)
    remove_folder(spark, folder)
    return result
