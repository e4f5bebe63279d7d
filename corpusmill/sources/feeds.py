"""A feed of records in the order of a key, as a data source: filtered reads, and a stream whose offsets are keys.

A feed is a folder of Parquet files, or one file. ``keyset_feed`` reads it with the filters that Spark pushes down and the
columns that are asked for: whole row groups are left out by their statistics, and each of the rest is a partition. As a
stream, a batch is what lies after one key and up to another, in the order of ``keys``, so a batch that is run again holds
the same rows, and a batch of any size is read in parallel, each row once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

NAME = "keyset_feed"
#: Filter -> its name in a condition; all of them mean the same to Arrow as to Spark, but for floating-point columns. Spark
#: keeps comparisons of times without a zone to itself.
OPERATORS = {EqualTo: "equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}


@dataclass
class RowGroup(InputPartition):
    path: str
    number: int
    lower: list | None = None
    upper: list | None = None


def _plain(value):
    """A key's value as an offset holds it."""
    return value.isoformat() if isinstance(value, dt.date | dt.datetime) else value


def _literal(value, kind: pa.DataType):
    """A filter's value as a column of this type compares it: instants are in UTC, times without a zone have none."""
    if isinstance(value, dt.datetime) and pa.types.is_timestamp(kind):
        utc = value.astimezone(dt.UTC) if value.tzinfo else value.replace(tzinfo=dt.UTC)
        return utc if kind.tz else utc.replace(tzinfo=None)
    return value


class Feed:
    """The files of a feed: plain data, opened where it is needed."""

    def __init__(self, options: dict, schema: StructType | None = None):
        self.path = options["path"]
        self.keys = [k.strip() for k in options.get("keys", "").split(",") if k.strip()]
        self.columns = [c.strip() for c in options.get("columns", "").split(",") if c.strip()] or (schema.names if schema else None)

    def open(self) -> ds.FileSystemDataset:
        at = urlsplit(self.path)
        store, root = (fs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else fs.FileSystem.from_uri(self.path)
        return ds.dataset(root, filesystem=store, format="parquet", exclude_invalid_files=False)

    def schema(self) -> StructType:
        found = self.open().schema
        return from_arrow_schema(pa.schema([found.field(c) for c in self.columns or found.names]), prefer_timestamp_ntz=True)

    def pieces(self, condition: ds.Expression | None) -> Iterator[ds.ParquetFileFragment]:
        """The row groups that may hold a row of this condition, by their statistics."""
        for file in self.open().get_fragments():
            yield from file.split_by_row_group(filter=condition) if condition is not None else file.split_by_row_group()

    def rows(self, part: RowGroup, condition: ds.Expression | None) -> Iterator[pa.RecordBatch]:
        data = self.open()
        file = next(f for f in data.get_fragments() if f.path == part.path)
        for batch in file.subset(row_group_ids=[part.number]).scanner(schema=data.schema, columns=self.columns, filter=condition).to_batches():
            if batch.num_rows:
                yield batch

    def value(self, key: str, value) -> pa.Scalar:
        kind = self.open().schema.field(key).type
        return pc.cast(pa.scalar(value), kind) if isinstance(value, str) else pa.scalar(value, kind)

    def after(self, place: list) -> ds.Expression:
        """Rows whose key comes after a place; a place without its last values stands before all that begin like it."""
        out, same = None, None
        given = [k for k, v in zip(self.keys, place, strict=True) if v is not None]
        for key, v in zip(given, place, strict=False):
            here = ds.field(key) >= self.value(key, v) if key == given[-1] and len(given) < len(self.keys) else ds.field(key) > self.value(key, v)
            here = here if same is None else same & here
            out = here if out is None else out | here
            equal = ds.field(key) == self.value(key, v)
            same = equal if same is None else same & equal
        return out

    def up_to(self, place: list) -> ds.Expression:
        out, same = None, None
        for key, v in zip(self.keys, place, strict=True):
            here = ds.field(key) <= self.value(key, v) if key == self.keys[-1] else ds.field(key) < self.value(key, v)
            here = here if same is None else same & here
            out = here if out is None else out | here
            equal = ds.field(key) == self.value(key, v)
            same = equal if same is None else same & equal
        return out

    def between(self, lower: list | None, upper: list) -> ds.Expression:
        return self.up_to(upper) if not lower else self.after(lower) & self.up_to(upper)

    def last(self) -> list | None:
        """The greatest key: the row groups whose statistics allow the greatest first value are read, and no others."""
        first = self.keys[0]
        place = None
        for file in self.open().get_fragments():
            for group in file.row_groups:
                seen = (group.statistics or {}).get(first, {}).get("max")
                if place is not None and seen is not None and seen < place[0]:
                    continue
                table = file.subset(row_group_ids=[group.id]).to_table(columns=self.keys)
                for key in self.keys:
                    table = table.filter(pc.is_valid(table[key]))
                for key in self.keys:
                    table = table.filter(pc.equal(table[key], pc.max(table[key]))) if table.num_rows else table
                if table.num_rows:
                    best = [table[k][0].as_py() for k in self.keys]
                    place = best if place is None or best > place else place
        return place and [_plain(v) for v in place]


def expression(condition: list[tuple]) -> ds.Expression | None:
    """(operator, column, value) of each, together."""
    out = None
    for name, column, value in condition:
        field = ds.field(column)
        if name in ("is_null", "is_valid"):
            test = getattr(field, name)()
        elif name == "isin":
            test = field.isin(value)
        elif name == "starts_with":
            test = pc.starts_with(field, value)
        else:
            test = getattr(pc, name)(field, value)
        out = test if out is None else out & test
    return out


class FeedReader(DataSourceReader):
    """A filtered read: filters that the feed can answer are taken from Spark, the others stay with it."""

    def __init__(self, feed: Feed):
        self.feed, self.condition = feed, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = self.feed.open().schema
        for f in filters:
            column = ".".join(getattr(f, "attribute", ("?",)))
            known = column in kinds.names and not (pa.types.is_floating(kinds.field(column).type) or pa.types.is_nested(kinds.field(column).type))
            like = lambda v: _literal(v, kinds.field(column).type)  # noqa: E731, B023
            if known and type(f) in OPERATORS:
                self.condition.append((OPERATORS[type(f)], column, like(f.value)))
            elif known and isinstance(f, In):
                self.condition.append(("isin", column, [like(v) for v in f.value if v is not None]))
            elif known and isinstance(f, StringStartsWith):
                self.condition.append(("starts_with", column, f.value))
            elif known and isinstance(f, IsNull | IsNotNull):
                self.condition.append(("is_null" if isinstance(f, IsNull) else "is_valid", column, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [RowGroup(p.path, p.row_groups[0].id) for p in self.feed.pieces(expression(self.condition))] or [RowGroup("", -1)]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        return self.feed.rows(partition, expression(self.condition)) if partition.path else iter(())


class FeedStream(DataSourceStreamReader):
    """Offsets are keys: a batch is what lies after one and up to another, a partition per row group that may hold some of it."""

    def __init__(self, feed: Feed, start: list | None):
        self.feed, self.start = feed, start

    def initialOffset(self) -> dict:
        return {"after": self.start}

    def latestOffset(self) -> dict:
        last = self.feed.last()
        return {"after": last if last is not None else self.start}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lower, upper = start["after"], end["after"]
        if upper is None or None in upper or lower == upper:
            return []
        return [RowGroup(p.path, p.row_groups[0].id, lower, upper) for p in self.feed.pieces(self.feed.between(lower, upper))]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        return self.feed.rows(partition, self.feed.between(partition.lower, partition.upper))

    def commit(self, end: dict) -> None:
        """Nothing to do: the feed keeps its rows."""


class KeysetFeed(DataSource):
    """Options: path; columns, the ones to read (default: all); keys, the order of a stream; start, what its first key begins at.

    Rows with a null in a key have no place in the order: a stream leaves them out, a batch read doesn't. A stream takes
    up rows that come later where their key does; who needs those that came late begins again some time before the last key.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return Feed(self.options).schema()

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(Feed(self.options, schema))

    def streamReader(self, schema: StructType) -> FeedStream:
        feed = Feed(self.options, schema)
        start = self.options.get("start")
        return FeedStream(feed, [start, *[None] * (len(feed.keys) - 1)] if start else None)


def _options(reader, path: str, columns: list[str] | None, **more: str | None):
    for name, value in {"path": path, "columns": ",".join(columns or []), **more}.items():
        reader = reader.option(name, value) if value else reader
    return reader.format(NAME)


def feed(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A feed as it is now; filters on it reach the files."""
    spark.dataSource.register(KeysetFeed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return _options(spark.read, path, columns).load()


def feed_stream(spark: SparkSession, path: str, keys: list[str], start: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A feed as a stream in the order of its keys, from the first or from where the first key reaches ``start``."""
    spark.dataSource.register(KeysetFeed)
    return _options(spark.readStream, path, columns, keys=",".join(keys), start=start).load()
