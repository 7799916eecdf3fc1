"""Per-key results when a few keys hold most rows: exact offset chunking.

Rows are range-partitioned by (key, order), so a hot key spreads over as many
partitions as its rows need. Counts per (key, partition) and a prefix sum over
partitions give every part its exact offset; rows are numbered inside their
part, cut into chunks of one size, processed chunk by chunk, and the ordered
boundary states of the chunks are merged per key. No task ever holds a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silkmoth.plans.lineage import materialise

#: Rows of one key that one chunk holds.
CHUNK = 50_000
#: Bytes of input that one range part is made of, by the planner's estimate.
PART = 512 << 20


def parts_for(df: DataFrame, part: int = PART) -> int:
    """Number of parts for ``df``: the session's, or more where its input is large.

    The input is what the plan's leaves read; where the planner knows no size the
    session's number holds.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(least, -(-size // part)) if size < 1 << 60 else least


def numbered(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``pos`` (from 1 within the key, by ``order``) and ``chunk`` (from 0).

    ``order`` should be total; ties are numbered in an arbitrary but full order.
    Nulls in ``order`` come first. The ranged copy is written to the shared
    folder, so the partition number of a row does not change if a task is redone.
    """
    cols = [*keys, *order]
    n = partitions or parts_for(df)
    ranged = df.repartitionByRange(n, *[F.col(c) for c in cols]).withColumn("__part", F.spark_partition_id())
    rows = materialise(ranged)
    counts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    placed = rows.withColumn("__rn", F.row_number().over(inside))
    same = [placed[k].eqNullSafe(offsets[k]) for k in [*keys, "__part"]]
    cond: Column = same[0]
    for c in same[1:]:
        cond = cond & c
    pos = F.col("__offset") + F.col("__rn")
    drop = [offsets[k] for k in [*keys, "__part"]]
    joined = placed.join(offsets, cond)
    for d in drop:
        joined = joined.drop(d)
    return joined.withColumn("pos", pos).withColumn("chunk", F.floor((F.col("pos") - 1) / F.lit(chunk))).drop("__rn", "__offset", "__part")


def chunk_states(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """State of each chunk: rows, first and last ``at``, longest step inside it in microseconds."""
    inside = Window.partitionBy(*keys, "chunk").orderBy("pos")
    step = F.unix_micros(F.col(at)) - F.lag(F.unix_micros(F.col(at))).over(inside)
    return rows.withColumn("__step", step).groupBy(*keys, "chunk").agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.max("__step").alias("longest_step"))


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows, first, last, longest step — within chunks and across their borders."""
    order = Window.partitionBy(*keys).orderBy("chunk")
    ends = F.max("last_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    border = F.unix_micros("first_at") - F.unix_micros(ends)
    merged = states.withColumn("__border", border)
    return merged.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max(F.greatest("longest_step", "__border")).alias("longest_step"), F.count("*").alias("chunks")
    )


def sides(edges: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Each row once per key column: ``(side, node, *order)``; a null key has no row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("node")) for c in columns])
    return edges.select(F.explode(pairs).alias("__k"), *order).select("__k.side", "__k.node", *order).where(F.col("node").isNotNull())


def per_key(edges: DataFrame, columns: list[str], at: str, tie: str, partitions: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Result per value of every key column, by chunks; see :func:`merge_states`.

    Rows count as delivered, repeats included. The empty string is a key, null
    is none. Rows whose ``at`` is null count but have no place in time. An empty
    table gives no rows; columns not named here are not read.
    """
    keys = ["side", "node"]
    rows = numbered(sides(edges, columns, [at, tie]), keys, [at, tie], partitions, chunk)
    return merge_states(chunk_states(rows, keys, at), keys)


def hot_keys(results: DataFrame, total: int, share: float = 0.01) -> DataFrame:
    """Keys holding at least ``share`` of ``total`` rows."""
    return results.where(F.col("n_rows") >= F.lit(share) * F.lit(total)).where(F.lit(total) > 0)
