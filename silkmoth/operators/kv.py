"""Keyed tables: lookup, scan, put, delete, swap, and sets inside rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lookup(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the keys; keys without a row are left out."""
    return store.join(keys.select(key).distinct(), key, "left_semi")


def scan(store: DataFrame, key: str) -> DataFrame:
    """All keys in order."""
    return store.select(key).orderBy(key)


def put(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``store`` with ``rows`` in place of those of their keys; ``rows`` has a key once."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``store`` without the rows of the keys."""
    return store.join(keys.select(key), key, "left_anti")


def delete_own(store: DataFrame, key: str, value: str, owner: str, who: str) -> DataFrame:
    """``store`` without the row of ``value``, if ``who`` owns it."""
    return store.where(~F.coalesce((F.col(key) == value) & (F.col(owner) == who), F.lit(False)))


def commit(df: DataFrame, path: str) -> str:
    """Write a new version below ``path`` and switch to it; readers see the old or the new one.

    The pointer is a file named by the version's number, made through the file
    system of ``path`` (local, HDFS, an object store) without replacing any; of two
    writers of one number the second fails. Returns the version's folder.
    """
    spark = df.sparkSession
    number = _last(spark, path) + 1
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    fs, at = _file_system(spark, f"{path}/_versions/{number:012d}")
    out = fs.create(at, False)
    out.write(version.rsplit("/", 1)[1].encode())
    out.close()
    return version


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _last(spark: SparkSession, path: str) -> int:
    """Number of the last version below ``path``, 0 if there is none."""
    fs, at = _file_system(spark, f"{path}/_versions")
    return max((int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit()), default=0) if fs.exists(at) else 0


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version last committed below ``path``."""
    number = _last(spark, path)
    if not number:
        raise FileNotFoundError(f"nothing was committed below {path}")
    name = spark.read.text(f"{path}/_versions/{number:012d}").first()[0]
    return spark.read.parquet(f"{path}/{name}")


def subscribe(items: Column, item: Column) -> Column:
    """The array with ``item``, once."""
    base = F.coalesce(items, F.array().cast("array<string>"))
    return F.when(F.array_contains(base, item), base).otherwise(F.array_append(base, item))


def unsubscribe(items: Column, item: Column) -> Column:
    """The array without ``item``."""
    return F.array_remove(F.coalesce(items, F.array().cast("array<string>")), item)


def flagged(all_items: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """``all_items`` with ``subscribed``, whether ``own`` has the key."""
    mark = own.select(key).distinct().withColumn("subscribed", F.lit(True))
    return all_items.join(mark, key, "left").withColumn("subscribed", F.coalesce("subscribed", F.lit(False)))


def show(channels: DataFrame, docs: DataFrame, items: str, key: str) -> DataFrame:
    """Documents of each channel's list; listed documents that do not exist are left out."""
    return channels.withColumn(key, F.explode(items)).drop(items).join(docs, key)


def password_hash(password: Column) -> Column:
    """SHA-256 as hexadecimal text."""
    return F.sha2(password, 256)
