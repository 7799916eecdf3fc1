"""Text sources: lines, whole files, index output, ranks, link lines, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value)``, one row per line; ``path`` may be a glob such as ``output/part*``."""
    return spark.read.text(path)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc, content)``, one row per file, named by the file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.col("value").alias("content"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc, length, content)`` of files as bytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("doc"), "length", "content")


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(term, info)`` of earlier index output: the first run of blanks ends the term."""
    parts = F.split("value", r"\s+", 2)
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("term"), F.get(parts, F.lit(1)).alias("info"))


def joined_text(files: DataFrame, prefix: str) -> DataFrame:
    """One row: contents of the files whose name has the prefix, joined by CRLF in order of the names.

    For reports of a few files; ``files`` is ``(doc, content)``.
    """
    own = files.where(F.startswith("doc", F.lit(prefix)))
    parts = F.array_sort(F.collect_list(F.struct("doc", "content")))
    return own.agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\r\n").alias("content"))


def rank_lines(text: DataFrame, value: str = "value") -> DataFrame:
    """``(url, rank)`` of lines ``(url,rank)``; a second part that is no number gives 1.

    The outer characters go first, then commas cut, so a comma in a url cuts it too.
    """
    inner = F.substring(F.col(value), 2, F.length(value) - 2)
    parts = F.split(inner, ",", -1)
    return text.select(F.get(parts, F.lit(0)).alias("url"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0)).alias("rank"))


def recovered(spark: SparkSession, crawled: str, urlmap: str) -> tuple[DataFrame, DataFrame]:
    """Seen urls and link lists from their logs; lines without two parts are skipped."""
    parts = F.split("value", r"\|", -1)
    seen = spark.read.text(crawled).select(F.col("value").alias("url")).distinct()
    links = spark.read.text(urlmap).where(F.size(parts) >= 2).select(F.get(parts, F.lit(0)).alias("src"), F.get(parts, F.lit(1)).alias("dests"))
    return seen, links


def seed(spark: SparkSession, url: str) -> DataFrame:
    """A frontier of one url-decoded seed; text that cannot be decoded is kept."""
    row = spark.createDataFrame([(1, url)], "seq long, raw string")
    return row.select("seq", F.coalesce(F.try_url_decode("raw"), "raw").alias("url"))


def frontier_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Streaming ``(seq, url)`` from JSON files dropped into a folder."""
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("url", T.StringType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def word_stream(spark: SparkSession, path: str) -> DataFrame:
    """Streaming ``(word)`` from text files, cut at blanks, tabs, commas and dots; empty words stay."""
    return spark.readStream.text(path).select(F.explode(F.split("value", "[ \\t,.]")).alias("word"))


def random_words(spark: SparkSession, words: list[str], per_second: int = 10) -> DataFrame:
    """Endless streaming ``(word)`` drawn from ``words``."""
    choices = F.array(*[F.lit(w) for w in words])
    at = (F.floor(F.rand() * len(words)) + 1).cast("int")
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.element_at(choices, at).alias("word"))
