"""Greedy batches against a loop."""

import random

import pytest
from corpusmill.operators import batches
from pyspark.sql import functions as F


def plain(sizes, most_rows, most_size):
    out, batch, n, total = [], 0, 0, 0
    for s in sizes:
        if n and (n >= most_rows or total + s > most_size):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + s
        out.append(batch)
    return out


@pytest.mark.parametrize("partitions, step", [(1, 1), (50, 1), (7, 40), (3, 1 << 16)])
def test_batches_equal_a_loop_however_rows_are_dealt(spark, partitions, step):
    r = random.Random(partitions)
    sizes = [r.choice([0, 1, 5, 30, 99, 100, 101, 1000]) for _ in range(500)]
    rows = list(enumerate(sizes))
    r.shuffle(rows)
    table = spark.createDataFrame([(i, "x" * s) for i, s in rows], "id long, text string").repartition(partitions)
    for most_rows, most_size in ((16, 100), (3, 1 << 40)) if step > 1 else ((7, 100), (1, 0)):
        got = batches.greedy_batches(table, ["id"], F.length("text"), most_rows, most_size, step).collect()
        assert [(b["place"], b["batch"]) for b in sorted(got)] == [(i + 1, b) for i, b in enumerate(plain(sizes, most_rows, most_size))], (most_rows, most_size)


def test_batches_of_odd_tables(spark):
    rows = spark.createDataFrame([(None, "abc", 1), (1, None, 2), (2, "", 3), (2, "", 3)], "id long, text string, place int")
    got = batches.greedy_batches(rows, ["id"], F.length("text"), 2, 3).orderBy("place").collect()
    assert [tuple(b) for b in got] == [(None, 1, 0), (1, 2, 0), (2, 3, 1), (2, 4, 1)]
    assert batches.greedy_batches(rows.limit(0), ["id"], F.length("text"), 2, 3).count() == 0
