"""Tokens, stop words and stems."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silkmoth.functions.porter import stem

#: Small default list of English words that say little; pass another to the operators.
STOP_WORDS = (
    "a about after all also an and any are as at be because been before being between both but by can could did do does down during each few for from "
    "further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our "
    "out over own s same she should so some such t than that the their them then there these they this those through to too under until up very was we "
    "were what when where which while who whom why will with would you your"
).split()


def load_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Stop words from text files: blank-separated, any case, as ``(token)``."""
    words = spark.read.text(path).select(F.explode(F.split(F.lower("value"), r"\s+")).alias("token"))
    return words.where("token <> ''").distinct()


def default_stop_words(spark: SparkSession) -> DataFrame:
    """The default list as ``(token)``."""
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "token string").coalesce(1)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in order, then lower-cased; null gives an empty array."""
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower), F.array().cast("array<string>"))


def drop_stop_words(rows: DataFrame, stop: DataFrame, token: str = "token") -> DataFrame:
    """``rows`` whose token is no stop word. The list is joined; Spark broadcasts it when small."""
    return rows.join(stop.select(F.col("token").alias(token)), token, "left_anti")


def stem_vocabulary(vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """``(token, stem)`` of distinct tokens; tokens with a digit are their own stem."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([stem(w) if w.isascii() and w.isalpha() else w for w in words], pa.string())], names=["token", "stem"])

    distinct = vocabulary.select(F.col(token).alias("token")).where("token is not null").distinct()
    return distinct.mapInArrow(each, "token string, stem string")


def term_frequency(count: Column, total: Column) -> Column:
    """Share of a document's tokens in single precision."""
    return (count.cast("float") / total.cast("float")).cast("float")
