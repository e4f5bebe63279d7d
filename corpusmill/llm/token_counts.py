"""Token counts: an exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, picked, portions
from corpusmill.llm.encoding import encoder, steps

#: Neighbouring lengths that share a range of the suffix sums.
RANGE = 256


def encoded_lengths(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """doc_id and n_tokens for every row. Null and empty texts have 0 tokens. ``tokenizer``: path of a tokenizer file."""
    rows = picked(docs, doc_id=F.col(key), text=F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for whole in portions(batches):
            for a, z in steps(whole.column(1)):
                batch = whole.slice(a, z - a)
                sizes = pc.binary_length(encode.encode_column(batch.column(1))).to_numpy() // int(encode.kind[2])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64))], ["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """A row for each length that occurs, with the totals for a context limit of that length.

    n_docs: documents of this length; docs_at_least, tokens_at_least: documents of at least this length, and their
    tokens; share_at_most: share of all documents that fit whole, so that a quantile is the first length to reach it;
    truncated_total: tokens left if every document is cut to this length; total: all tokens.

    Suffix sums are taken over ranges of ``RANGE`` lengths, then inside each range; the single window holds a row per
    range. Null lengths are left out; an empty table gives an empty one.
    """
    counts = cut(lengths.filter(F.col(length).isNotNull()).groupBy(F.col(length).cast("long").alias("length")).agg(F.count("*").alias("n_docs")))
    counts = counts.withColumn("_range", F.floor(F.col("length") / RANGE)).withColumn("_tokens", F.col("length") * F.col("n_docs"))
    ranges = counts.groupBy("_range").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    bases = ranges.select(
        "_range",
        (F.sum("_d").over(later) - F.col("_d")).alias("_docs_after"),
        (F.sum("_t").over(later) - F.col("_t")).alias("_tokens_after"),
        F.sum("_d").over(everything).alias("_docs"),
        F.sum("_t").over(everything).alias("total"),
    )
    inside = Window.partitionBy("_range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counts.withColumn("_in_docs", F.sum("n_docs").over(inside)).withColumn("_in_tokens", F.sum("_tokens").over(inside)).join(bases, "_range")
    docs, tokens = F.col("_docs_after") + F.col("_in_docs"), F.col("_tokens_after") + F.col("_in_tokens")
    return summed.select(
        "length",
        "n_docs",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        ((F.col("_docs") - docs + F.col("n_docs")) / F.col("_docs")).alias("share_at_most"),
        (F.col("total") - tokens + F.col("length") * docs).alias("truncated_total"),
        "total",
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share and length: the least length that at least that share of the documents doesn't exceed."""
    wanted = F.explode(F.array(*map(F.lit, shares))).alias("share")
    return histogram.select(wanted, "length", "share_at_most").filter("share_at_most >= share").groupBy("share").agg(F.min("length").alias("length"))


def truncated_total(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit and tokens: the tokens left if every document is cut to the limit, which needn't be a length that occurs."""
    wanted = F.explode(F.array(*map(F.lit, limits))).alias("limit")
    return histogram.select(wanted, "length", "n_docs").groupBy("limit").agg(F.sum(F.col("n_docs") * F.least("length", "limit")).alias("tokens"))
