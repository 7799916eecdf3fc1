"""Text and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from silkmoth.functions.html import without_controls


def rank_text(ranks: DataFrame) -> DataFrame:
    """Lines ``(url,rank)`` of ranks."""
    return ranks.select(F.concat(F.lit("("), "url", F.lit(","), F.col("rank").cast("string"), F.lit(")")).alias("value"))


def documents(docs: DataFrame) -> DataFrame:
    """Documents as stored: a key from the encoded url, content without control characters."""
    return docs.select(F.concat(F.lit("final/"), F.url_encode("url")).alias("key"), without_controls(F.col("content")).alias("content"), "mime", "last_modified")


def write_text(rows: DataFrame, path: str, append: bool = False) -> None:
    """Lines ``(value)`` as text, one file per partition."""
    rows.write.mode("append" if append else "errorifexists").text(path)


def write_index(postings: DataFrame, path: str, files: int) -> None:
    """Postings ranged and sorted by term, so that a lookup reads few row groups."""
    postings.repartitionByRange(files, "term").sortWithinPartitions("term").write.mode("errorifexists").parquet(path)


def snapshot_every(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest batch of a streaming table as a snapshot; runs until stopped or done."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def printed(rows: DataFrame, name: str = "stream") -> DataFrame:
    """Rows as text ``name: {field: value, ...}``."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in rows.columns]
    return rows.select(F.concat(F.lit(f"{name}: {{"), F.concat_ws(", ", *parts), F.lit("}")).alias("value"))
