"""Cutting lineage through the folder all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="silkmoth-"))
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Unlike ``checkpoint()`` the copy is columnar and compressed, so a later
    reader that needs two columns reads two columns. It survives the loss of
    any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, "tables")
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    _PATHS[copy] = path
    return copy


_CREATED: list[tuple[int, str]] = []


@atexit.register
def _clean() -> None:
    """Delete the tables of a driver that ends, where the folder is mounted."""
    for pid, path in _CREATED:
        mounted = path.removeprefix("file://").removeprefix("file:")
        if pid == os.getpid() and mounted.startswith("/"):
            shutil.rmtree(mounted, ignore_errors=True)


_KEPT: dict[tuple[str, str], str] = {}


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    _CREATED.append((os.getpid(), path))
    return path


def kept(spark: SparkSession, name: str, make: Callable[[str], None]) -> str:
    """Path of a table that ``make(path)`` writes once a session; later calls find it there, or make it again if it is gone."""
    key = (spark.sparkContext.applicationId, name)
    if key in _KEPT:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{_KEPT[key]}/_SUCCESS")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return _KEPT[key]
    path = scratch(spark, "tables")
    make(path)
    _KEPT[key] = path
    return path


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def release(copy: DataFrame) -> None:
    """Delete the files behind a table of :func:`materialise` that nothing reads any more."""
    path = _PATHS.pop(copy, None)
    if path:
        spark = copy.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into parts of at most ``rows``, which bounds what Python holds at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
