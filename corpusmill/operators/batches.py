"""Greedy batches in one order over a whole table, however its rows are dealt to tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.relations import numbered

#: Rows of a range. A task holds the sizes of one range, and as many more rows as a batch may have.
STEP = 1 << 16


def _next(sizes: np.ndarray, most_rows: int, most_size: int) -> np.ndarray:
    """For each row, the row after the batch that starts with it: as many rows as fit, and one in any case."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    fits = np.searchsorted(total, total[:-1] + most_size, "right") - 1
    first = np.arange(n)
    return np.minimum(np.maximum(np.minimum(fits, first + most_rows), first + 1), n)


def _crossings(sizes: np.ndarray, step: int, most_rows: int, most_size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Where the batches that follow from each row leave the range, how many they are, and the range's own rows.

    ``sizes`` are those of the range and of the rows that follow it. Pointers are doubled: each round, every row points
    as far again as it did.
    """
    own = min(step, len(sizes))
    to, n = _next(sizes, most_rows, most_size)[:own], np.ones(own, np.int64)
    while (inside := to < own).any():
        n[inside] += n[to[inside]]
        to[inside] = to[to[inside]]
    return to, n, own


def _starts(sizes: np.ndarray, first: int, most_rows: int, most_size: int) -> np.ndarray:
    """Which rows of a range start a batch if ``first`` does, by doubled pointers."""
    n = len(sizes)
    found = np.zeros(n + 1, bool)
    if first < n:
        found[first] = True
        jump = np.append(_next(sizes, most_rows, most_size), n)
        while True:
            found[jump[found]] = True
            if jump[first] == n:
                break
            jump = jump[jump]
    return found[:n]


def greedy_batches(rows: DataFrame, keys: list[str], size: Column, most_rows: int, most_size: int, step: int = STEP) -> DataFrame:
    """keys, place (from 1) and batch (from 0): each batch takes the next rows while it has at most so many and their sizes add up to at most so much.

    A row larger than that is a batch of its own. The order is that of the keys, nulls first, which end with an id. A
    null size counts as 0; an empty table has no batches.

    No task follows the rows from the first to the last. Rows are dealt to ranges by their place; each range finds, for
    every row that a batch may start with, where the batches leave it and how many they are; these steps are joined with
    themselves until they span all ranges, which takes as many rounds as the number of ranges has binary digits; then
    each range marks its batches. Only keys and sizes move.
    """
    assert most_rows > 0
    step = max(step, most_rows)
    sized = rows.select(*keys, F.coalesce(size, F.lit(0)).cast("long").alias("_size"))
    at = F.col("place") - 1
    placed = numbered(sized, [*map(F.col, keys), F.col("_size")], "place").withColumns({"_range": F.floor(at / step), "_at": at % step})
    seen = F.when((F.col("_at") < most_rows) & (F.col("_range") > 0), F.array("_range", F.col("_range") - 1)).otherwise(F.array("_range"))

    def cross(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        to, n, own = _crossings(table["_size"].to_numpy(), step, most_rows, most_size)
        first = min(own, most_rows)
        number = (table["place"][0].as_py() - 1) // step
        return pa.table({"_from": np.full(first, number), "_first": np.arange(first), "_to": np.full(first, number + 1), "_next": to[:first] - own, "_n": n[:first]})

    steps = placed.select(F.explode(seen).alias("_r"), "place", "_size").groupBy("_r").applyInArrow(cross, "_from long, _first long, _to long, _next long, _n long").checkpoint()
    last = steps.agg(F.max("_from").alias("last")).first()["last"]
    entries = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("_range"), F.lit(0).cast("long").alias("_first"), F.lit(0).cast("long").alias("_base"))
    for _ in range((last or 0).bit_length()):
        ahead = entries.join(steps, (F.col("_range") == F.col("_from")) & (entries["_first"] == steps["_first"]))
        entries = entries.unionByName(ahead.select(F.col("_to").alias("_range"), F.col("_next").alias("_first"), (F.col("_base") + F.col("_n")).alias("_base"))).checkpoint()
        then = steps.select(F.col("_from").alias("_to"), F.col("_first").alias("_next"), F.col("_to").alias("_to2"), F.col("_next").alias("_next2"), F.col("_n").alias("_n2"))
        steps = steps.join(then, ["_to", "_next"]).select("_from", "_first", F.col("_to2").alias("_to"), F.col("_next2").alias("_next"), (F.col("_n") + F.col("_n2")).alias("_n")).checkpoint()

    def mark(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        started = _starts(table["_size"].to_numpy(), table["_first"][0].as_py(), most_rows, most_size)
        return table.select([*keys, "place"]).append_column("batch", pa.array(table["_base"][0].as_py() + np.cumsum(started) - 1, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*keys).schema)
    known = placed.join(entries, "_range").select("_range", *keys, "place", "_size", "_first", "_base")
    return known.groupBy("_range").applyInArrow(mark, f"{schema}, place long, batch long")
