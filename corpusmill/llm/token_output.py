"""Token-id output: flat files of unsigned integers with 64-bit document offsets, to be memory-mapped.

Texts are encoded where they are read, and only their ids are dealt out: range-partitioned and sorted by document id, in
as many ranges as their bytes ask for. The ranges' bounds come from a sample of ids taken beforehand, as in any range
partitioning; they decide which task writes what, not what is written. Each task writes its range into files of its own below a shared folder:
``tokens`` (16 bits an id if the vocabulary fits, else 32), ``offsets`` (64 bits, one more than there are documents) and
``docs`` (64-bit document ids). A manifest, one row per range, says which attempt's files count and how many tokens each
holds; prefix sums over it give every range its base in the whole. All numbers are little-endian.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, new_folder, picked, portions
from corpusmill.llm.encoding import encoder, steps
from corpusmill.operators.relations import numbered

END = 0
#: Stands for a null id in ``docs``; such documents come first.
NO_ID = np.iinfo(np.int64).min
MANIFEST = "part int, name string, n_docs long, n_tokens long, width int"
#: Bytes of text in a range, about; smaller data has a range per shuffle partition.
RANGE_BYTES = 256_000_000
#: Sampled rows for each range.
SAMPLED = 100
#: Bytes of ids that a task reads back, about; smaller data is read by a task per shuffle partition.
READ_BYTES = 128_000_000
#: Ids read at a time when a file can't be mapped.
READ_IDS = 1 << 22


def _settings(spark: SparkSession, folder: str) -> dict[str, str]:
    """What Arrow's S3 client needs to know of Hadoop's settings, for folders on such a store."""
    if urlsplit(folder).scheme not in ("s3a", "s3n", "s3"):
        return {}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    names = {"access_key": "access.key", "secret_key": "secret.key", "session_token": "session.token", "endpoint_override": "endpoint", "region": "endpoint.region"}
    return {k: v for k, v in ((k, conf.get(f"fs.s3a.{name}")) for k, name in names.items()) if v}


def store_of(folder: str, settings: dict[str, str]) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a folder as Hadoop names it, and the path in it."""
    at = urlsplit(folder)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), at.path
    if at.scheme in ("s3a", "s3n", "s3"):
        return fs.S3FileSystem(**settings), f"{at.netloc}{at.path}"
    return fs.FileSystem.from_uri(folder)  # hdfs, viewfs, gs, abfs


def _places(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, tie and row: what the documents are ordered by. Rows with one id and text are alike, so any order of them will do."""
    return picked(docs, doc_id=F.col(key).cast("long"), tie=F.xxhash64(F.coalesce(F.col(text), F.lit(""))), row=F.xxhash64(F.monotonically_increasing_id()), text=F.coalesce(F.col(text), F.lit("")))


def _bounds(places: DataFrame, least: int) -> tuple[int, np.ndarray]:
    """The number of ranges, and where each but the first begins, as ascending ``packed`` places.

    The sample is numbered in its order by tasks, and only the bounds themselves, a row per range, come to the driver.
    """
    count, size = places.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(least, -(-(size or 0) // RANGE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.asc("tie"), F.asc("row")]
    sample = cut(places.select("doc_id", "tie", "row").sample(min(1.0, SAMPLED * n / max(count, 1)), seed=7))
    held = sample.count()
    part = lambda place: F.floor(place * n / F.lit(max(held, 1)))
    chosen = numbered(sample, order, "at").filter((F.col("at") > 1) & (part(F.col("at") - 1) > part(F.col("at") - 2)))
    found = chosen.select("doc_id", "tie", "row").toArrow() if held else None
    return n, np.sort(packed(*(found.column(i).combine_chunks() for i in range(3)))) if held else np.zeros(0, dtype="S25")


def packed(ids: pa.Array, tie: pa.Array, row: pa.Array) -> np.ndarray:
    """Places as 25 bytes each, in whose order bytes compare: whether there is an id, the id, tie and row."""
    out = np.zeros((len(ids), 25), dtype=np.uint8)
    out[:, 0] = ids.is_valid().to_numpy(zero_copy_only=False)
    for at, column in zip((1, 9, 17), (ids, tie, row), strict=True):
        values = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, at : at + 8] = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S25").reshape(-1)


def _range_of(bounds: np.ndarray, ids: pa.Array, tie: pa.Array, row: pa.Array) -> np.ndarray:
    """For each document the number of bounds at or before its place."""
    return np.searchsorted(bounds, packed(ids, tie, row), side="right")


def encoded(docs: DataFrame, text: str, key: str, tokenizer: str | None, least: int) -> tuple[int, DataFrame]:
    """The number of ranges, and range, doc_id, tie, row, ids (bytes, with the end id) and width for every document."""
    places = _places(docs, text, key)
    n, found = _bounds(places, least)
    bounds = docs.sparkSession.sparkContext.broadcast(found.tobytes())  # 25 bytes a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([END], dtype=encode.kind).tobytes()
        edges = np.frombuffer(bounds.value, dtype="S25") if bounds.value else np.zeros(0, dtype="S25")
        for whole in portions(batches):
            for a, z in steps(whole.column(3)):
                batch = whole.slice(a, z - a)
                ids = pc.binary_join_element_wise(encode.encode_column(batch.column(3)), end, b"")
                place = [batch.column(i) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_range_of(edges, *place).astype(np.int32)), *place, ids, pa.array(np.full(len(ids), int(encode.kind[2]), dtype=np.int32))],
                    ["range", "doc_id", "tie", "row", "ids", "width"],
                )

    return n, places.mapInArrow(run, "range int, doc_id long, tie long, row long, ids binary, width int")


def write_tokens(docs: DataFrame, folder: str | None = None, text: str = "text", key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """Writes the files and returns the manifest with the columns folder and base, the tokens before each range.

    Every document ends with the id ``END``; a null or empty text is that id alone. Ids are integers; null ones come
    first, and rows that share one are ordered by a hash of their text. An empty table writes files without documents.
    ``folder`` names any store that Arrow and Hadoop both know: a shared disk, HDFS, S3 and their like.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    settings = _settings(spark, folder)
    n, rows = encoded(docs, text, key, tokenizer, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionById(n, "range").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "ids", "width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"  # a task that is tried again writes other files
        store, root = store_of(folder, settings)
        store.create_dir(root, recursive=True)
        at = n_docs = 0
        width = 2
        with store.open_output_stream(f"{root}/{name}.tokens") as tokens, store.open_output_stream(f"{root}/{name}.offsets") as offsets, store.open_output_stream(f"{root}/{name}.docs") as ids:
            offsets.write(np.zeros(1, dtype="<i8").tobytes())
            for batch in batches:
                if batch.num_rows:
                    width = batch.column(2)[0].as_py()
                    rows = batch.column(1).cast(pa.binary())
                    edge = np.frombuffer(rows.buffers()[1], dtype=np.int32)[rows.offset : rows.offset + len(rows) + 1]
                    tokens.write(rows.buffers()[2].slice(int(edge[0]), int(edge[-1] - edge[0])))
                    sizes = np.diff(edge.astype("<i8")) // width
                    offsets.write((at + np.cumsum(sizes)).astype("<i8").tobytes())
                    at += int(sizes.sum())
                    n_docs += len(sizes)
                    ids.write(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": [n_docs], "n_tokens": [at], "width": pa.array([width], pa.int32())})

    manifest = cut(dealt.mapInArrow(run, MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return manifest.withColumn("base", F.sum("n_tokens").over(before) - F.col("n_tokens")).withColumn("folder", F.lit(folder))


class _Numbers:
    """A flat file of numbers, mapped where the store is a disk, else read by ranges."""

    def __init__(self, store: fs.FileSystem, path: str, kind: str):
        self.kind = np.dtype(kind)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.mapped = np.memmap(path, dtype=kind, mode="r") if size and isinstance(store, fs.LocalFileSystem) else None
        self.length = size // self.kind.itemsize

    def read(self, start: int, stop: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[start:stop]
        return np.frombuffer(self.file.read_at((stop - start) * self.kind.itemsize, start * self.kind.itemsize), dtype=self.kind)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids before it in the whole), n_tokens and ids_crc32.

    Ranges without documents give no rows. A document longer than ``READ_IDS`` is a read of its own.
    """
    spark = manifest.sparkSession
    first = manifest.select("folder").first()
    size = manifest.agg(F.sum(F.col("n_tokens") * F.col("width"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // READ_BYTES))
    settings = _settings(spark, first[0]) if first else {}
    files = manifest.select("folder", "name", "base", "width", "part").repartitionByRange(n, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, root = store_of(row["folder"], settings)
                tokens, offsets, docs = (_Numbers(store, f"{root}/{row['name']}.{what}", kind) for what, kind in (("tokens", f"<u{row['width']}"), ("offsets", "<i8"), ("docs", "<i8")))
                for at in range(0, docs.length, 1 << 14):
                    doc = np.array(docs.read(at, min(at + (1 << 14), docs.length)))
                    edge = np.array(offsets.read(at, at + len(doc) + 1))
                    crc, here = [], 0
                    while here < len(doc):  # as many documents as one read may hold, and one at least
                        stop = max(here + 1, int(np.searchsorted(edge, edge[here] + READ_IDS, side="right")) - 1)
                        ids = tokens.read(int(edge[here]), int(edge[stop]))
                        local = (edge[here : stop + 1] - edge[here]).tolist()
                        crc += [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(local[:-1], local[1:], strict=True)]
                        here = stop
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, mask=doc == NO_ID), pa.array(edge[:-1] + row["base"]), pa.array(np.diff(edge)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, folder: str | None = None, text: str = "text", key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """Writes the files and reads them back: a row for each row of ``docs``, as ``write_tokens`` and ``read_tokens`` say.

    Null and empty texts are the end id alone, null ids come first, repeated rows are documents of their own, and an
    empty table gives an empty one. Columns other than the id and the text are left out.
    """
    return read_tokens(write_tokens(docs, folder, text, key, tokenizer))
