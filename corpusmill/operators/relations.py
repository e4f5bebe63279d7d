"""Relational building blocks: upserts, version choice, closures, snapshots and comparisons of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.shared import shared_folder


def latest_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``; end the order with an id so that ties are settled."""
    window = Window.partitionBy(*key).orderBy(*order)
    name = "_place"
    return rows.withColumn(name, F.row_number().over(window)).filter(F.col(name) == 1).drop(name)


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``old`` with the rows of ``new`` put in place of those of the same key; the first of ``new`` in ``order`` counts."""
    fresh = latest_per_key(new, key, order)
    return old.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh.select(*old.columns))


def upsert_counts(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """created and updated: how many keys of ``new`` are new to ``old`` and how many aren't."""
    keys = new.select(*key).distinct().join(old.select(*key).distinct().withColumn("_old", F.lit(True)), list(key), "left")
    return keys.agg(F.count_if(F.col("_old").isNull()).alias("created"), F.count_if(F.col("_old").isNotNull()).alias("updated"))


def missing(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(right.select(*key), list(key), "left_anti")


def members(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with a partner, each once."""
    return left.join(right.select(*key), list(key), "left_semi")


def unindexed(chunks: DataFrame, generation: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Members of the generation that the index lacks: what an incremental build has to add."""
    return missing(members(chunks, generation, [key]), index, [key])


def stale(chunks: DataFrame, embeddings: DataFrame, key: str, text_hash: str) -> DataFrame:
    """Chunks without an embedding, or with one of another text."""
    known = embeddings.select(key, F.col(text_hash).alias("_known"))
    return chunks.join(known, key, "left").filter(~F.col(text_hash).eqNullSafe(F.col("_known"))).drop("_known")


def closure(modules: DataFrame, versions: DataFrame, documents: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table that the chosen modules reach, by semi-joins along the references."""
    v = members(versions, modules, ["module_id"])
    d = members(documents, v, ["version_id"])
    return {"modules": modules, "versions": v, "documents": d, "chunks": members(chunks, d, ["document_id"])}


def broken_references(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is missing; a sound bundle has none."""
    return children.filter(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")


def conflicts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ between the tables, nulls compared as values."""
    same = None
    joined = old.alias("o").join(new.alias("n"), key)
    for c in (c for c in old.columns if c != key):
        test = F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        same = test if same is None else same & test
    return joined.filter(~same).select(key)


def deletions(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that a full reconciliation no longer finds."""
    return old.select(*key).join(new.select(*key), list(key), "left_anti")


def array_difference(required: Column, present: Column) -> Column:
    return F.array_except(required, present)


def is_subset(small: Column, large: Column) -> Column:
    return F.size(F.array_except(small, large)) == 0


def case_insensitive_distinct(rows: DataFrame, key: str, tag: str, order: str) -> DataFrame:
    """One row per key and lower-cased tag, with the first spelling."""
    return latest_per_key(rows.withColumn("_folded", F.lower(tag)), [key, "_folded"], [F.col(order)]).drop("_folded")


def append_order(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``new`` numbered on from the largest number of its key, from 1 where there is none."""
    last = existing.groupBy(key).agg(F.max("display_order").alias("_last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.join(last, key, "left").withColumn("display_order", F.coalesce("_last", F.lit(0)) + place).drop("_last")


def digests(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """by and a hash of the group's rows, whatever their order: rows are hashed and their hashes added up, so no group is gathered."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("_row", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5)]
    return rows.select(by, row.alias("_row")).groupBy(by).agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256).alias("digest"))


#: Bytes, as JSON, up to which ``few`` marks a table to be broadcast.
FEW_BYTES = 8_000_000


def few(rows: DataFrame) -> DataFrame:
    """``rows``, which should be few, computed once, and marked to be broadcast if their bytes are few indeed."""
    shared_folder(rows.sparkSession)
    rows = rows.checkpoint()
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(rows) if (size or 0) <= FEW_BYTES else rows


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with their place, from 1, in an order over all of them; end the order with an id.

    Rows are dealt out by ranges and sorted inside them; a place is the rows of earlier ranges plus that inside its own,
    so no task sorts the table. The ranges are written to the shared folder, as both parts have to see the same ones.
    """
    spark, mark = rows.sparkSession, f"_{name}"
    shared_folder(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright(mark, 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    bases = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_base"))
    at = F.col("_base") + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_part", part).join(F.broadcast(bases), "_part").select(*rows.columns, at.alias(name))
