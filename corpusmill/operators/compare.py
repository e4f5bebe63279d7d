"""Comparison of two versions of a document set."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.functions.text import collapse


@F.arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Unicode normal form C, for which Spark has no built-in function; Arrow's own works on whole columns."""
    return pc.utf8_normalize(texts, form="NFC")


@F.pandas_udf(StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Line diff with three lines of context; null if either side is missing."""

    def one(a: str | None, b: str | None) -> str | None:
        if not isinstance(a, str) or not isinstance(b, str):
            return None
        return "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), fromfile="baseline", tofile="target", lineterm="", n=3))

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)], dtype=object)


def canonical_key(citation: Column, document: Column, stable: Column) -> Column:
    """A section's name over versions: its citation, or else its document and place."""
    cited = F.concat(F.lit("citation:"), F.lower(collapse(citation)))
    other = F.concat(F.lit("stable:"), F.coalesce(F.nullif(document, F.lit("")), F.lit("document")), F.lit("::"), F.coalesce(F.nullif(stable, F.lit("")), F.lit("chunk")))
    return F.when(F.coalesce(citation, F.lit("")) != "", cited).otherwise(other)


def sections(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """Chunks of one key as one section: ids and titles in order, texts joined by line ends, and a hash of the text.

    The key names one section of one document, whose chunks are as many as it takes to print it; they fit a row.
    """
    members = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "chunk_id", "title", "text")))
    grouped = chunks.groupBy(F.col(key).alias("section_key")).agg(members.alias("m"))
    titles = F.array_distinct(F.filter("m.title", lambda t: t.isNotNull() & (t != "")))
    text = F.array_join("m.text", "\n")
    return grouped.select("section_key", F.col("m.chunk_id").alias("chunk_ids"), F.nullif(F.array_join(titles, " / "), F.lit("")).alias("title"), text.alias("text"), F.sha2(text, 256).alias("text_hash"))


def normal(text: Column) -> Column:
    """Texts as they are compared: Unicode normal form C, white space collapsed."""
    return collapse(nfc(text))


def changes(before: DataFrame, after: DataFrame, key: str, text: str, metadata: list[str], parser_changed: bool = False, identical_artifact: bool = False, normalize=normal) -> DataFrame:
    """key, classification, certainty and both sides, by full outer join of two versions.

    Texts are compared by hashes of their normal form, made once on each side. A text found once among the removed and
    once among the added rows marks both as uncertain: they may be one section with a new number. These are counted on
    keys and hashes alone, so the texts move once.
    """
    sides = []
    for v, name in ((before, "old"), (after, "new")):
        form = normalize(F.col(text))
        sides.append(v.withColumn("_form", form).select(F.col(key), F.struct(text, *metadata).alias(name), F.xxhash64(text).alias(f"_{name}_raw"), F.when(F.coalesce("_form", F.lit("")) != "", F.sha2("_form", 256)).alias(f"_{name}_hash")))
    joined = sides[0].join(sides[1], key, "full_outer")
    moved = reduce(lambda a, b: a | b, (~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in metadata), F.lit(False))
    touched = moved | (F.col("_old_raw") != F.col("_new_raw"))
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("_old_hash").eqNullSafe(F.col("_new_hash")), "text_changed")
        .when(F.lit(parser_changed and identical_artifact) & touched, "parser_only")
        .when(moved, "metadata_only")
        .otherwise("unchanged")
    )
    narrow = sides[0].select(key, "_old_hash", F.lit(1).alias("_o")).join(sides[1].select(key, "_new_hash", F.lit(1).alias("_n")), key, "full_outer")
    lone = narrow.filter("_o IS NULL OR _n IS NULL").select(F.coalesce("_old_hash", "_new_hash").alias("_hash"), "_o", "_n").filter("_hash IS NOT NULL")
    pairs = lone.groupBy("_hash").agg(F.count("_n").alias("a"), F.count("_o").alias("r")).filter("a = 1 AND r = 1").select("_hash", F.lit(True).alias("_pair"))
    classed = joined.withColumn("classification", kind)
    hashed = classed.withColumn("_hash", F.when(F.col("classification").isin("added", "removed"), F.coalesce("_old_hash", "_new_hash")))
    marked = hashed.join(pairs, "_hash", "left")
    return marked.select(
        key,
        F.when(F.col("_pair"), "uncertain").otherwise(F.col("classification")).alias("classification"),
        F.when(F.col("_pair"), "low").otherwise("high").alias("certainty"),
        "old",
        "new",
    )


def impacts(items: DataFrame, changed: DataFrame, reviews: DataFrame) -> DataFrame:
    """Saved items whose evidence holds changed chunks, with those chunks and the latest review.

    ``items``: item_id, chunk_ids; ``changed``: chunk_id; ``reviews``: item_id, reviewed_at.
    """
    hit = items.select("item_id", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id")).join(changed.select("chunk_id").distinct(), "chunk_id")
    found = hit.groupBy("item_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("matching_chunk_ids"))
    return found.join(reviews.groupBy("item_id").agg(F.max("reviewed_at").alias("reviewed_at")), "item_id", "left")


def shown(changes: DataFrame, key: str, classes: list[str] | None = None, hide_unchanged: bool = True) -> DataFrame:
    """Changes of some classes, or of all, without those that changed nothing if asked, by key."""
    kept = changes.filter(F.col("classification") != "unchanged") if hide_unchanged else changes
    return (kept.filter(F.col("classification").isin(classes)) if classes else kept).orderBy(key)
