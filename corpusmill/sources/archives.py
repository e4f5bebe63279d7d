"""One ZIP archive written by many tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.shared import shared_folder

# Fixed values of the ZIP format: version that knows 64-bit offsets, names in UTF-8, deflated, the first day of 1980.
VERSION, FLAGS, DEFLATED, DAY = 45, 1 << 11, 8, 1 << 5 | 1
LOCAL, ENTRY, END64, LOCATOR, END = b"PK\3\4", b"PK\1\2", b"PK\6\6", b"PK\6\7", b"PK\5\6"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
LOCAL_BYTES, ENTRY_BYTES = 30, 46 + 12


#: Members that a worker holds at a time.
PORTION = 1000


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, PORTION) for at in range(0, batch.num_rows, PORTION))


def _head(name: bytes, crc: int, packed: int, size: int) -> bytes:
    return LOCAL + struct.pack("<5H3I2H", VERSION, FLAGS, DEFLATED, 0, DAY, crc, packed, size, len(name), 0) + name


def _entry(name: bytes, crc: int, packed: int, size: int, offset: int) -> bytes:
    fixed = struct.pack("<6H3I5H2I", VERSION, VERSION, FLAGS, DEFLATED, 0, DAY, crc, packed, size, len(name), 12, 0, 0, 0, 0, FULL32)
    return ENTRY + fixed + name + struct.pack("<2HQ", 1, 8, offset)


def _end(entries: int, directory: int, start: int) -> bytes:
    wide = END64 + struct.pack("<Q2H2I4Q", 44, VERSION, VERSION, 0, 0, entries, entries, directory, start)
    return wide + LOCATOR + struct.pack("<IQI", 0, start + directory, 1) + END + struct.pack("<4H2IH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0)


def _disk_path(url: str) -> str:
    parts = urlsplit(url)
    if parts.scheme not in ("", "file"):
        raise ValueError("An archive is written in place, by many tasks at once, which needs a folder on a shared disk.")
    return unquote(parts.path)


def write_archive(members: DataFrame, path: str) -> DataFrame:
    """Writes ``members`` (name, content) as one ZIP archive: name, at, packed, size, crc, one row per member, in the shared folder.

    Tasks deflate their members, a range of names each, and add up the bytes they take; prefix sums over the tasks say
    where each member and its entry in the directory lie, so each task writes its own part of the file. A task that runs
    again writes the same bytes in the same place. Only the 98 bytes at the end come from the driver. ``path`` is on a
    disk that all tasks share.

    Members are in the order of their names; equal names are all kept. A null name counts as empty, null content as no
    bytes; text is written in UTF-8. A name longer than 65,535 bytes fails. No members make an archive without any.
    """
    spark, place = members.sparkSession, _disk_path(path)
    shared_folder(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = entry = 0
        for batch in _portions(batches):
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
                packed, label = deflate.compress(content) + deflate.flush(), name.encode()
                if len(label) > FULL16:
                    raise ValueError(f"a name of {len(label)} bytes")
                out.append({"name": name, "crc": zlib.crc32(content), "size": len(content), "packed": len(packed), "body": packed, "at": at, "entry": entry})
                at, entry = at + LOCAL_BYTES + len(label) + len(packed), entry + ENTRY_BYTES + len(label)
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("name", pa.string()), ("crc", pa.int64()), ("size", pa.int64()), ("packed", pa.int64()), ("body", pa.binary()), ("at", pa.int64()), ("entry", pa.int64())])
    rows = members.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, "name", F.xxhash64("content")).sortWithinPartitions("name", F.xxhash64("content"))
    packed = sorted_rows.mapInArrow(pack, "name string, crc long, size long, packed long, body binary, at long, entry long").withColumn("task", F.spark_partition_id()).checkpoint()

    label = F.octet_length("name")
    taken = packed.groupBy("task").agg(F.sum(LOCAL_BYTES + label + F.col("packed")).alias("bytes"), F.sum(ENTRY_BYTES + label).alias("listed"), F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = taken.select("task", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("listed").over(before), F.lit(0)).alias("list_base"))
    total = taken.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "listed", "n"))).first()
    start = total["bytes"]
    with open(place, "wb") as f:
        f.truncate(start + total["listed"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(place, "r+b") as f:
            for batch in _portions(batches):
                for r in batch.to_pylist():
                    name, about = r["name"].encode(), (r["crc"], r["packed"], r["size"])
                    f.seek(r["at"])
                    f.write(_head(name, *about) + r["body"])
                    f.seek(start + r["entry"])
                    f.write(_entry(name, *about, r["at"]))
                yield batch.select(["name", "at", "packed", "size", "crc"])

    placed = packed.join(F.broadcast(bases), "task").select("name", "crc", "size", "packed", "body", (F.col("at") + F.col("base")).alias("at"), (F.col("entry") + F.col("list_base")).alias("entry"))
    manifest = placed.mapInArrow(write, "name string, at long, packed long, size long, crc long").checkpoint()
    with open(place, "r+b") as f:
        f.seek(start + total["listed"])
        f.write(_end(total["n"], total["listed"], start))
    return manifest


def read_members(manifest: DataFrame, path: str) -> DataFrame:
    """name and content of the members that rows of a manifest (name, at, packed, crc) point to; each is read by its place and checked."""
    place = _disk_path(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(place, "rb") as f:
            for batch in _portions(batches):
                out = []
                for name, at, packed, crc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    f.seek(at + LOCAL_BYTES + len(name.encode()))
                    content = zlib.decompress(f.read(packed), -15)
                    if zlib.crc32(content) != crc:
                        raise ValueError(f"{name} has another checksum")
                    out.append({"name": name, "content": content})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("name", pa.string()), ("content", pa.binary())]))

    return manifest.select("name", "at", "packed", "crc").mapInArrow(read, "name string, content binary")
