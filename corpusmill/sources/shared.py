"""The folder that driver and executors share, and folders below it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or the context names.

    Where none is named, a session on one machine gets a temporary folder; on a cluster that is an error, since files in
    a machine's own folder are lost with it.
    """
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        folder = f"file://{tempfile.mkdtemp(prefix='corpusmill-')}"
    if not found.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, what: str) -> str:
    """A name, not in use yet, for a folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the function that makes its paths."""
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to_path


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of every file below a path: another one if its data were written anew."""
    fs, to_path = file_system(spark, path)
    files, out = fs.listFiles(to_path(path), True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more, on whatever store it lies."""
    fs, to_path = file_system(spark, path)
    fs.delete(to_path(path), True)
