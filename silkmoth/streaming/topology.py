"""Linear stream topologies as one Structured Streaming plan.

A spout is a streaming DataFrame, a bolt a function from rows to rows; a grouping
says how rows are spread before the bolt runs. Batch DataFrames run through the
same chain, which is how plans are checked.
"""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from silkmoth.operators.crawl import gate, unseen
from silkmoth.operators.skew import numbered
from silkmoth.plans.lineage import scratch

Bolt = Callable[[DataFrame], DataFrame]


@dataclass
class Topology:
    """A spout and its bolts in order."""

    spout: DataFrame
    steps: list[tuple[str, Bolt, int | None, tuple[str, ...]]] = field(default_factory=list)

    def shuffle(self, name: str, bolt: Bolt, instances: int) -> Topology:
        """Add a bolt whose rows are dealt out in turn."""
        self.steps.append((name, bolt, instances, ()))
        return self

    def fields(self, name: str, bolt: Bolt, instances: int, *keys: str) -> Topology:
        """Add a bolt where rows of one key meet; an unknown key is an error."""
        if not keys:
            raise ValueError("fields grouping needs a field")
        self.steps.append((name, bolt, instances, keys))
        return self

    def plan(self) -> DataFrame:
        """The whole chain as one DataFrame."""
        out = self.spout
        for name, bolt, instances, keys in self.steps:
            missing = [k for k in keys if k not in out.columns]
            if missing:
                raise ValueError(f"{name}: no field {missing[0]}")
            # streaming state shuffles by its own keys; dealing out rows only helps a batch plan
            if not out.isStreaming:
                out = out.repartition(instances, *keys) if keys else out.repartition(instances)
            out = bolt(out)
        return out

    def steps_table(self, spark: SparkSession) -> DataFrame:
        """``(step, name, grouping, instances, keys)``, one row per bolt."""
        rows = [(i, name, "fields" if keys else "shuffle", instances, list(keys)) for i, (name, _, instances, keys) in enumerate(self.steps, 1)]
        return spark.createDataFrame(rows, "step int, name string, grouping string, instances int, keys array<string>")

    def dump(self) -> str:
        """The steps and the plan of the whole chain as text."""
        head = [f"{i}: {name} x {instances} by {'fields ' + ', '.join(keys) if keys else 'shuffle'}" for i, (name, _, instances, keys) in enumerate(self.steps, 1)]
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            self.plan().explain("extended")
        return "\n".join([*head, out.getvalue()])

    def run(self, path: str, mode: str = "append") -> StreamingQuery:
        """Run over what is there, write Parquet, and end; ``path`` holds output and checkpoint."""
        stream = self.plan().writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out")
        return stream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming plan to its end; its result, written by batches below the shared folder until the driver ends."""
    spark = stream.sparkSession
    path = f"{scratch(spark, 'streams')}/{name}"
    holder: dict[str, int] = {}

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        holder["last"] = number

    q = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{scratch(spark, 'streams')}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    last = f"{path}/batch={holder['last']}" if mode == "complete" else f"{path}/batch=*"
    return spark.read.parquet(last) if holder else spark.createDataFrame([], stream.schema)


def stop(query: StreamingQuery, *folders: str, wait_s: float = 30) -> bool:
    """Stop a stream, wait for its last batch and delete its ``folders``; whether it ended in time.

    A stream that has failed, or is stopped already, counts as ended.
    """
    spark = SparkSession.getActiveSession()
    query.stop()
    with contextlib.suppress(Exception):  # the failure of the stream is the caller's to ask for
        query.awaitTermination(int(wait_s))
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return not query.isActive


def round_robin(rows: DataFrame, seq: str, instances: int) -> DataFrame:
    """``rows`` with the instance that gets each in turn, by a sequence number."""
    return rows.withColumn("instance", F.pmod(F.col(seq), F.lit(instances)).cast("int"))


def by_fields(rows: DataFrame, instances: int, *keys: str) -> DataFrame:
    """``rows`` with the instance that gets each, the same for equal keys."""
    return rows.withColumn("instance", F.pmod(F.xxhash64(*keys), F.lit(instances)).cast("int"))


def running_count(rows: DataFrame, word: str, seq: str) -> DataFrame:
    """``(word, seq, count)`` for every row: how often its word has come so far, as text.

    The batch form of the counting bolt. Words are numbered in chunks, so a word
    that holds most rows is no single task.
    """
    placed = numbered(rows.select(F.col(word).alias("word"), F.col(seq).alias("seq")).where("word is not null"), ["word"], ["seq"])
    return placed.select("word", "seq", F.col("pos").cast("string").alias("count"))


def counted(words: DataFrame, word: str = "word") -> DataFrame:
    """``(word, count)`` for every tuple of a stream: how often its word has come so far, as text.

    The state of a word is its count, kept from batch to batch. Null words are left out.
    """

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for frame in frames:
            yield pd.DataFrame({"word": key[0], "count": np.arange(n + 1, n + 1 + len(frame)).astype(str)})
            n += len(frame)
        state.update((n,))

    rows = words.select(F.col(word).alias("word")).where("word is not null")
    return rows.groupBy("word").applyInPandasWithState(count, "word string, count string", "n long", "append", GroupStateTimeout.NoTimeout)


def polite(requests: DataFrame, host: str, at: str, tie: str, delay_s: float, keep_s: float = 86_400) -> DataFrame:
    """Requests of a stream with ``start``: a request that comes before its host is free is put back until it is.

    The state of a host is the time from which it is free; it is given up
    ``keep_s`` after the host was asked last, by the watermark of ``at``. Requests
    without a host or time are left out. A host's requests of one batch are taken
    in order of arrival.
    """
    step = int(delay_s * 1_000_000)

    def plan(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        free = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "tie"])  # one host's requests of one batch
        starts = []
        for t in rows["at"].astype("int64"):
            starts.append(t if free is None else max(t, free))
            free = starts[-1] + step
        state.update((free,))
        state.setTimeoutTimestamp(max(free // 1000, state.getCurrentWatermarkMs()) + int(keep_s * 1000))
        yield pd.DataFrame({"tie": rows["tie"].to_numpy(), "host": key[0], "start": starts})

    rows = requests.select(F.col(host).alias("host"), F.col(at).cast("timestamp").alias("seen"), F.col(tie).cast("long").alias("tie")).where("host is not null and seen is not null")
    kind = rows.schema["host"].dataType.simpleString()
    timed = rows.withWatermark("seen", "1 hour").withColumn("at", F.unix_micros("seen"))
    planned = timed.groupBy("host").applyInPandasWithState(plan, f"tie long, host {kind}, start long", "free long", "append", GroupStateTimeout.EventTimeTimeout)
    return planned.select(F.col("tie").alias(tie), F.col("host").alias(host), F.timestamp_micros("start").alias("start"))


def crawl_chain(frontier: DataFrame, rules: DataFrame, pages: DataFrame, seen: DataFrame, links: Bolt, instances: tuple[int, int, int] = (10, 10, 5)) -> Topology:
    """The crawler's chain: spout of urls, crawl, parse and filter bolts, one plan over a stream or a batch.

    ``frontier`` has ``(seq, url)``. The crawl bolt drops urls that ``rules``
    ``(host_port, rules)`` forbid and brings the page ``(url, fetch_id, mime, content)``
    of the others; urls without a page end there. The parse bolt makes links
    ``(fetch_id, pos, url)`` by ``links``. The filter bolt lets each url pass once,
    unless it is among the ``seen`` ones.
    """
    own = pages.select("url", "fetch_id", "mime", "content")

    def crawled(urls: DataFrame) -> DataFrame:
        once = seen_once(urls.select("url"), "url")  # a url is fetched once, however many rows ask for it
        return gate(once, rules).where("allowed").select("url").join(own, "url")

    def fresh(found: DataFrame) -> DataFrame:
        return seen_once(unseen(found.select("url").where("url is not null"), seen), "url")

    return Topology(frontier).shuffle("crawl", crawled, instances[0]).shuffle("parse", links, instances[1]).shuffle("filter", fresh, instances[2])


def word_counts(words: DataFrame, word: str = "word") -> DataFrame:
    """Counts by word; on a stream in update or complete mode."""
    return words.groupBy(word).agg(F.count("*").alias("count"))


def seen_once(rows: DataFrame, key: str, at: str | None = None, late: str = "1 day") -> DataFrame:
    """First row of every key; with an event time the state of a stream is bounded by ``late``."""
    if at is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
