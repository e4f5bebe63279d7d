"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.shared import new_folder, remove_folder, shared_folder

__all__ = ["by_portion", "chunks", "cut", "fresh", "held_out", "mixed", "new_folder", "picked", "portions", "remove_folder", "small", "table"]

#: Characters of text that one step of a vectorised operator works on; a longer document is a step of its own.
CHUNK_CHARS = 1 << 20

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model may learn from. A null id counts as the empty text, so as held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fresh(df: DataFrame, name: str) -> str:
    """A column name close to ``name`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs a read and not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of an Arrow batch that an operator turns into Python objects at a time. Spark bounds a batch by its bytes; this
#: bounds what a worker makes of it.
PORTION = 1000


def picked(docs: DataFrame, **columns: Column) -> DataFrame:
    """The named columns of ``docs`` only, so that no other is read."""
    return docs.select(*(c.alias(name) for name, c in columns.items()))


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, at most ``PORTION`` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, PORTION):
            yield batch.slice(at, PORTION)


def by_portion(texts: pa.Array, f: Callable[[list[str | None]], list], kind: pa.DataType) -> pa.Array:
    """``f`` of the texts, of at most ``PORTION`` at a time: the body of an Arrow function of a column of texts."""
    parts = [pa.array(f(texts.slice(at, PORTION).to_pylist()), kind) for at in range(0, len(texts), PORTION)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters each; no text is split."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


_GOLDEN, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit value that looks random for each number."""
    x = x.astype(np.uint64) + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Bytes, as JSON, up to which a table is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, which should be a row per source or language, computed once and marked to be broadcast if its bytes are few."""
    df = cut(df)
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df
