"""Mixing sources to target weights.

Every row gets a hash-random key. Rows with one source, id and size are one entry with a count, so a repeated id is no hot
key. Entries are cut into key ranges within their source, sums of the ranges give each range its base, and a window inside
the range gives each entry's prefix sum: no task ever holds a whole source. The budget of a source then falls on one exact
word of that order; budgets above the source's size repeat it by whole epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, cut, fresh, small

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source is repeated at most so many times.
MOST_EPOCHS = 3
#: Hexadecimal digits of the key that name a key range: 3 for 4,096 ranges a source.
RANGE_DIGITS = 3
#: Rows of an entry that a task gives out at a time.
STEP = 4096


def random_key(doc_id: Column) -> Column:
    """A key that looks random and that every run gives alike."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """The source as a key that is never null, so that plain equality joins it."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _targets(sums: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Per source: its size, weight and target. The sources are few against the rows: one window orders them.

    Targets share the total by weight. In order of size over weight, a source stops at its cap if the share of what is
    left over would exceed it; this is where resharing the excess again and again ends.
    """
    sizes = sums.groupBy("_source").agg(F.sum("words").alias("source_size"))
    by_name = Window.orderBy((F.col("_source") == "").cast("int"), "_source")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "_source")
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    total = Window.partitionBy()
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")))
        .withColumn("cap", MOST_EPOCHS * F.col("source_size"))
        .withColumn("left", F.sum("source_size").over(total) - F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.col("cap").cast("double") * F.col("weight_left") <= F.col("left").cast("double") * F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(total) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(total))
        .withColumn("rest_weight", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(total))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("rest")).cast("double") / F.col("rest_weight")))
        .select("_source", "source_size", "target")
    )


def _entries(docs: DataFrame, text: str, key: str, source: str, weights: tuple[int, ...]) -> DataFrame:
    """_source, _key, doc_id, size and n, the rows that share them, with source_size, target, epochs and room: words left where the entry begins."""
    rows = docs.select(_source_key(F.col(source)).alias("_source"), random_key(F.col(key)).alias("_key"), F.col(key).alias("doc_id"), word_count(F.col(text)).alias("size"))
    entries = cut(rows.groupBy("_source", "_key", "doc_id", "size").agg(F.count("*").alias("n")).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS)))
    words = F.col("size") * F.col("n")
    sums = entries.groupBy("_source", "_range").agg(F.sum(words).alias("words"))
    before = F.sum("words").over(Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bases = sums.withColumn("_base", before - F.col("words")).join(_targets(sums, weights), "_source").drop("words")
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size, whole = F.col("source_size"), F.floor("target")
    return (
        entries.withColumn("_here", F.sum(words).over(inside) - words)
        .join(bases, ["_source", "_range"])
        .withColumn("epochs", F.when(size > 0, F.floor(whole / size)).otherwise(0).cast("long"))
        .withColumn("room", (whole - F.col("epochs") * size - F.col("_base") - F.col("_here")).cast("long"))
    )


def mix_sources(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, source_size, target, taken, and the epochs and key behind them.

    Null sources are one source, ordered last. Null or empty texts have size 0 and give nothing. Rows that share an id
    share a key and are ordered by size, so equal rows differ only in which of them meets the cut. An empty table gives
    an empty one. The words taken from a source add up to its target, rounded down.
    """
    steps = _entries(docs, text, key, source, weights).withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STEP))))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = steps.repartition(n, "_key", "doc_id", "size", "_step")  # an entry may stand for very many rows
    rows = spread.withColumn("_number", F.explode(F.sequence(F.col("_step") * STEP, F.least(F.col("n"), (F.col("_step") + 1) * STEP) - 1)))
    room = F.col("room") - F.col("_number") * F.col("size")
    return rows.withColumn("room", room).withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("room")))).select(
        "doc_id", "size", "source_size", "target", "taken", "epochs", "room", "_key", "_source"
    )


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs``, with all their columns, each as many times as the mix takes it.

    Documents stay whole: the one that a source's budget ends in counts as taken if at least half of it fits, so a
    source comes within half a document of its target. Rows with one source, id and size are taken together: all or none
    where the budget ends. Null texts have no words and go; null ids and sources are a value of their own. An empty table
    gives an empty one. The order has one cut per source, so the texts are not moved: the table of cuts is joined to them.
    """
    entries = _entries(docs, text, key, source, WEIGHTS)
    words = F.col("size") * F.col("n")
    last = F.max(F.when((F.col("size") > 0) & (2 * F.col("room") >= words), F.struct("_key", "doc_id", "size")))
    plan = small(entries.groupBy("_source").agg(F.first("epochs").alias("_epochs"), last.alias("_last")))
    names = docs.columns
    key_of, copies = fresh(docs, "_source"), fresh(docs, "_copies")
    plan = plan.select(F.col("_source").alias(key_of), F.col("_epochs").alias(fresh(docs, "_epochs")), F.col("_last").alias(fresh(docs, "_last")))
    epochs, last_col = F.col(plan.columns[1]), F.col(plan.columns[2])
    size = fresh(docs, "_words")
    place = F.struct(random_key(F.col(key)).alias("_key"), F.col(key).alias("doc_id"), F.col(size).alias("size"))
    number = F.when(F.col(size) > 0, epochs + F.when(last_col.isNotNull() & (place <= last_col), 1).otherwise(0)).otherwise(0)
    return (
        docs.withColumn(key_of, _source_key(F.col(source)))
        .withColumn(size, word_count(F.col(text)))
        .join(plan, key_of)
        .withColumn(copies, F.explode(F.array_repeat(F.lit(0), number.cast("int"))))
        .select(*names)
    )


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS BIGINT) AS cap FROM rows GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sizes
), tested AS (
  SELECT *, total - sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS FIRST ROWS UNBOUNDED PRECEDING) + cap AS left_over,
    sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighed
), marked AS (
  SELECT *, CAST(cap AS DOUBLE) * CAST(weight_left AS DOUBLE) <= CAST(left_over AS DOUBLE) * weight AS capped FROM tested
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    CAST(weight * (total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE NOT capped) OVER () AS DOUBLE) END AS target
  FROM marked
), placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS whole,
    CAST(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (whole // source_size) * size + greatest(0, least(size, whole % source_size - before)) END AS BIGINT) AS taken
FROM placed
"""
