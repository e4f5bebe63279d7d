"""Sinks: snapshots with a pointer that is swapped, exports, and content-addressed artifacts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import spreadsheet_safe
from corpusmill.sources.shared import file_system, remove_folder

#: Below it stands a numbered entry for every activation; an entry is never changed, and the last whole one counts.
POINTERS = "pointers"
#: Buckets of a new table that is merged in place, and bytes of files per bucket from which on their number doubles.
BUCKETS, BUCKET_BYTES = 16, 256_000_000


def _write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    fs, to_path = file_system(spark, path)
    stream = fs.create(to_path(path), overwrite)
    stream.write(bytearray(text.encode()))
    stream.close()


def _entry_names(spark: SparkSession, folder: str) -> list[str]:
    fs, to_path = file_system(spark, folder)
    at = to_path(f"{folder}/{POINTERS}")
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def _entry(spark: SparkSession, folder: str, name: str) -> dict | None:
    """What an entry says; None for one whose writer didn't finish."""
    try:
        return json.loads(spark.read.text(f"{folder}/{POINTERS}/{name}", wholetext=True).first()[0])
    except (TypeError, ValueError):
        return None


def exists(spark: SparkSession, path: str) -> bool:
    fs, to_path = file_system(spark, path)
    return fs.exists(to_path(path))


def latest(spark: SparkSession, folder: str) -> dict | None:
    """The newest whole entry."""
    return next((e for n in reversed(_entry_names(spark, folder)) if (e := _entry(spark, folder, n))), None)


def commit(spark: SparkSession, folder: str, entry: dict) -> None:
    """Appends an entry whose number must be free; nothing is overwritten.

    Of two writers with one number one fails and can look again, where the store creates a file only if there is none in
    one step, as HDFS and disks do. A store that looks first and writes then needs one writer at a time.
    """
    names = _entry_names(spark, folder)
    _write_text(spark, f"{folder}/{POINTERS}/{int(names[-1]) + 1 if names else 1:012d}", json.dumps(entry, sort_keys=True), overwrite=False)


def publish(df: DataFrame, folder: str, activate: bool = True) -> str:
    """Writes a new generation below ``folder`` and, if asked, makes it the active one. Readers of older ones aren't disturbed."""
    generation = uuid.uuid4().hex
    df.write.parquet(f"{folder}/generations/{generation}")
    if activate:
        activate_generation(df.sparkSession, folder, generation)
    return generation


def history(spark: SparkSession, folder: str) -> list[str]:
    """Generations in the order of their last activation; the last is active."""
    found = [e["generation"] for n in _entry_names(spark, folder) if (e := _entry(spark, folder, n))]
    return list(reversed(dict.fromkeys(reversed(found))))


def activate_generation(spark: SparkSession, folder: str, generation: str) -> None:
    commit(spark, folder, {"generation": generation})


def roll_back(spark: SparkSession, folder: str) -> str:
    """Makes the generation that was active before this one active again."""
    past = history(spark, folder)
    if len(past) < 2:
        raise ValueError("There is no earlier generation to go back to.")
    activate_generation(spark, folder, past[-2])
    return past[-2]


def active(spark: SparkSession, folder: str) -> DataFrame:
    now = latest(spark, folder)
    if not now:
        raise ValueError("No generation is active.")
    paths = sorted(held[0] for held in now["buckets"].values()) if "buckets" in now else [f"{folder}/generations/{now['generation']}"]
    return spark.read.parquet(*paths)


def _bucket(key: list[str], n: int):
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def _write_buckets(rows: DataFrame, folder: str, key: list[str], n: int) -> tuple[str, dict[str, list]]:
    """A new generation by bucket, and the folder and bytes of each bucket that has rows."""
    spark, generation = rows.sparkSession, uuid.uuid4().hex
    out = f"{folder}/generations/{generation}"
    rows.withColumn("_bucket", _bucket(key, n)).repartition("_bucket").write.partitionBy("_bucket").parquet(out)
    fs, to_path = file_system(spark, out)
    held = [f.getPath() for f in fs.listStatus(to_path(out)) if f.getPath().getName().startswith("_bucket=")]
    return generation, {p.getName().split("=")[1]: [f"{out}/{p.getName()}", fs.getContentSummary(p).getLength()] for p in held}


def merge_buckets(batch: DataFrame, folder: str, key: list[str], merge: Callable[[DataFrame, DataFrame | None], DataFrame]) -> None:
    """Merges a batch into a table of buckets by key: only buckets that it touches are read and written anew.

    ``merge`` gets the batch and the old rows of those buckets, or None if there are none. The new entry names a folder
    and its bytes for every bucket. Where buckets hold more than ``BUCKET_BYTES`` on average, their number doubles first,
    so a row is moved as often as the table has doubled. Files of older entries stay until ``clear_history``.
    """
    spark = batch.sparkSession
    now = latest(spark, folder) or {}
    n, known = now.get("n", BUCKETS), now.get("buckets", {})
    grown = n
    while sum(size for _, size in known.values()) > grown * BUCKET_BYTES:
        grown *= 2
    if grown > n:
        generation, known = _write_buckets(active(spark, folder), folder, key, grown)
        commit(spark, folder, {"generation": generation, "n": grown, "buckets": known})
    touched = [r[0] for r in batch.select(_bucket(key, grown).alias("b")).distinct().collect()]
    if not touched:
        return
    old = [known[str(b)][0] for b in touched if str(b) in known]
    generation, fresh = _write_buckets(merge(batch, spark.read.parquet(*old) if old else None), folder, key, grown)
    kept = {b: held for b, held in known.items() if int(b) not in touched}
    commit(spark, folder, {"generation": generation, "n": grown, "buckets": kept | fresh})


def clear_history(spark: SparkSession, folder: str, keep: int) -> None:
    """Removes bucket files that none of the newest ``keep`` entries names; readers of older entries must be done."""
    names = _entry_names(spark, folder)
    said = lambda some: {held[0] for name in some for held in (_entry(spark, folder, name) or {}).get("buckets", {}).values()}
    for path in said(names[:-keep]) - said(names[-keep:]):
        remove_folder(spark, path)


def export_csv(df: DataFrame, folder: str, columns: list[str], methodology: dict | None = None) -> None:
    """Chosen columns with a header, formulas disarmed; what the figures mean stands in a file beside them."""
    safe = [spreadsheet_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.select(*columns).dtypes]
    df.select(*safe).write.option("header", True).option("escape", '"').csv(f"{folder}/rows")
    if methodology is not None:
        _write_text(df.sparkSession, f"{folder}/methodology.json", json.dumps(methodology, sort_keys=True))


# The columns of a property export, in order.
PROPERTY_COLUMNS = [
    "export_version", "dataset_id", "dataset_url", "connector_version", "fetched_at", "fetch_started_at", "fetch_completed_at", "source_update_time", "cache_status", "stale", "request_scope_json",
    "loaded_scope_complete", "total_count", "has_more", "continuation_available", "violation_id", "building_id", "registration_id", "borough", "house_number", "street_name", "zip_code", "apartment",
    "class", "inspection_date", "current_status", "description",
]


def export_properties(records: DataFrame, folder: str, scope: dict[str, object]) -> None:
    """Property records as CSV in the fixed columns, with what holds for all of them in every row; what is missing is empty."""
    said = {"export_version": 2} | scope
    rows = records.withColumns({c: F.lit(str(v).lower() if isinstance(v, bool) else v).cast("string") for c, v in said.items() if c in PROPERTY_COLUMNS and v is not None})
    export_csv(rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in PROPERTY_COLUMNS)), folder, PROPERTY_COLUMNS)


def append_log(rows: DataFrame, folder: str, *ids: str) -> DataFrame:
    """Appends rows to a log (retrievals, answers, runs, extractions), leaving out those whose id it has; returns the log."""
    spark = rows.sparkSession
    fs, to_path = file_system(spark, folder)
    fresh = rows.dropDuplicates(list(ids))
    if fs.exists(to_path(folder)):
        fresh = fresh.join(spark.read.parquet(folder).select(*ids), list(ids), "left_anti")
    fresh.write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def export_json(df: DataFrame, folder: str) -> None:
    df.write.json(folder)


def store_artifacts(content: DataFrame, folder: str) -> DataFrame:
    """Appends the blobs whose hash isn't stored yet, as (content_hash, content), and returns those it added."""
    spark = content.sparkSession
    fresh = content.select(F.sha2("content", 256).alias("content_hash"), "content").dropDuplicates(["content_hash"])
    fs, to_path = file_system(spark, folder)
    if fs.exists(to_path(folder)):
        fresh = fresh.join(spark.read.parquet(folder).select("content_hash"), "content_hash", "left_anti")
    batch = f"{folder}/batch={uuid.uuid4().hex}"
    fresh.write.parquet(batch)
    return spark.read.parquet(batch)


def export_markdown(rows: DataFrame, folder: str, title: str, text: str, *order: str) -> None:
    """A Markdown file part per partition: a heading and a text for each row, in order."""
    block = F.concat(F.lit("## "), F.coalesce(F.regexp_replace(title, r"\s+", " "), F.lit("")), F.lit("\n\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    rows.orderBy(*order).select(block.alias("value")).write.text(folder)


def back_up(tables: dict[str, DataFrame], folder: str, private: dict[str, list[str]] | None = None) -> DataFrame:
    """Copies tables below ``folder`` with a manifest: table, rows and a digest of its rows. Private tables come without rows.

    ``private``: table -> columns to leave out; an empty list leaves out the rows.
    """
    manifest = None
    for name, df in sorted(tables.items()):
        left_out = (private or {}).get(name)
        kept = df if left_out is None else df.limit(0) if not left_out else df.drop(*left_out)
        kept.write.parquet(f"{folder}/{name}")
        row = checked(kept.sparkSession.read.parquet(f"{folder}/{name}"), name)
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.parquet(f"{folder}/_manifest")
    return manifest.sparkSession.read.parquet(f"{folder}/_manifest")


def checked(df: DataFrame, name: str) -> DataFrame:
    """table, rows and digest, a sum of row hashes that doesn't depend on the order, in one row."""
    digest = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")) if df.columns else F.lit(0)
    return df.agg(F.count("*").alias("rows"), F.coalesce(digest, F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("table"), "rows", "digest")


def restored_backup(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a back-up, if all of them still have the rows that its manifest names; else an error."""
    manifest = {r["table"]: (r["rows"], r["digest"]) for r in spark.read.parquet(f"{folder}/_manifest").collect()}
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in manifest}
    broken = [name for name, df in tables.items() if checked(df, name).first()[1:] != manifest[name]]
    if broken:
        raise ValueError(f"The back-up was changed: {', '.join(broken)}.")
    return tables
