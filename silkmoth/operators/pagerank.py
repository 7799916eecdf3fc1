"""Ranks of a link graph: fixed rounds, mass rescaled to the number of sources.

Targets that are no sources never matter after the out-degrees are known, so
their edges go before the first round. The weighted edges are partitioned by
source once and kept so; a round brings only the ranks to them and adds up by
target with partial sums on the map side. Its result is written to the shared
folder, which keeps the plan of a round constant; the one number that rounds
share, the sum, is observed by the write itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from silkmoth.plans.lineage import materialise, release

#: Rounds, damping and base (fixed values).
ROUNDS, DAMPING, BASE = 30, 0.85, 0.15


def weighted(edges: DataFrame) -> DataFrame:
    """``(src, dst, share)`` of the edges that lead to sources; share is 1 / out-degree."""
    degree = edges.groupBy("src").agg((F.lit(1.0) / F.count("*")).alias("share"))
    inner = edges.join(degree.select(F.col("src").alias("dst")), "dst", "left_semi")
    return inner.join(degree, "src").select("src", "dst", "share")


def step(links: DataFrame, ranks: DataFrame, scale: float, damping: float = DAMPING, base: float = BASE) -> DataFrame:
    """Ranks ``(url, rank)`` after one round, not yet rescaled.

    ``scale`` rescales the ranks that come in. Every source keeps at least ``base``.
    """
    given = links.join(ranks, links["src"] == ranks["url"]).select(F.col("dst").alias("url"), (F.col("rank") * F.col("share") * F.lit(scale)).alias("part"))
    every = given.unionByName(ranks.select("url", F.lit(0.0).alias("part")))
    return every.groupBy("url").agg((F.lit(base) + F.lit(damping) * F.sum("part")).alias("rank"))


def pagerank(edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, base: float = BASE) -> DataFrame:
    """``(url, rank)`` of all sources of distinct ``edges`` ``(src, dst)``; ranks sum up to their number.

    Self-links count, edges to other nodes only lower their source's share, and
    their mass is lost. A graph without edges has no ranks.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = materialise(weighted(edges)).repartition(n, "src").persist()  # made again from the written edges if it is lost
    ranks = materialise(edges.select(F.col("src").alias("url")).distinct().withColumn("rank", F.lit(1.0)))
    sources = ranks.count()
    if not sources:
        links.unpersist()
        return ranks
    scale = 1.0
    for _ in range(rounds):
        seen = Observation()
        old, ranks = ranks, materialise(step(links, ranks, scale, damping, base).observe(seen, F.sum("rank").alias("sum")))
        release(old)
        scale = sources / seen.get["sum"]
    links.unpersist()
    return ranks.select("url", (F.col("rank") * F.lit(scale)).alias("rank"))
