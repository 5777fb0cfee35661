"""Paths and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_libc = ctypes.CDLL(None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session, which is one process on one machine, gets a folder of
    this machine; on a cluster nothing is guessed and the setting is required.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="objectlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/objectlens/{name}-{uuid.uuid4().hex}"


def frozen(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read back: lineage ends here and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the written files of df, which nothing reads any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        fs, at = open_fs(folder)
        fs.delete_dir(at)


@contextmanager
def small_batches(spark: SparkSession, size: str):
    """Actions inside send Python batches that end with the row that brings them to this size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(spark: SparkSession) -> None:
    """Let go of plans that are done with, so that Spark's cleaner deletes the files of their shuffles now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path for a URI or a plain path."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def write_once(path: str, write) -> None:
    """Let write(stream) fill a file that appears at path as a whole or not at all; a second attempt, which has the same bytes, replaces it or leaves it."""
    fs, at = open_fs(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    context = TaskContext.get()
    part = f"{at}.{context.taskAttemptId() if context else 'driver'}-{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(part) as out:
        write(out)
    try:
        fs.move(part, at)
    except OSError:  # some file systems don't move onto what is there
        if fs.get_file_info(at).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(part)


def give_back() -> None:
    """Hand memory that a worker has freed back to the system; workers live as long as their executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def fields(df: DataFrame, names: list[str]) -> str:
    """Schema text of some columns."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{n}`" for n in names]).schema)


def crc_bucket(column: str, modulus: int):
    """crc32 of a column's text, modulo; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")) % modulus
