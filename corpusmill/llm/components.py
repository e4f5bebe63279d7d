"""Connected components of a graph given as pairs of node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of ``edges`` (two columns of one id type).

    Large-star and small-star steps in turn: each moves the neighbours of a node to the least of them, so that any graph
    ends as stars after a number of rounds that grows with the logarithm of its size, chains included. Aggregations are
    combined before the shuffle and the joins are plain equi-joins, which adaptive execution splits where a node has
    very many neighbours. Self-loops and repeated pairs don't matter; an empty table gives an empty one.
    """
    a, b = edges.columns
    pairs = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs, before = cut(pairs), None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        pairs, before = cut(moved.filter("u != v").distinct()), now
