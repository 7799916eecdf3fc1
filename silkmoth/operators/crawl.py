"""Crawl state as tables: frontier, seen urls, robots rules, politeness, budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silkmoth.functions.robots import is_disallowed, no_rules
from silkmoth.functions.urls import host_port, parse_url
from silkmoth.operators.skew import numbered


def unseen(candidates: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Candidates that are not among the seen urls; repeats stay."""
    return candidates.join(seen.select(F.col(url)).where(F.col(url).isNotNull()), url, "left_anti")


def known(candidates: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Candidates that have been seen."""
    return candidates.join(seen.select(url), url, "left_semi")


def gate(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``delay_ms`` and ``allowed`` by the rules of their host and port.

    ``rules`` has ``(host_port, rules)``, one row per key; hosts without a row have
    the default rules. A text that is no URL is not allowed.
    """
    parsed = urls.withColumn("__p", parse_url(F.col(url))).withColumn("host_port", host_port(F.col("__p")))
    joined = parsed.join(rules, "host_port", "left").withColumn("__r", F.coalesce("rules", no_rules()))
    allowed = F.coalesce(~is_disallowed(F.col("__p.path"), F.col("__r")), F.lit(False))
    return joined.withColumn("delay_ms", F.col("__r.delay_ms")).withColumn("allowed", allowed).drop("__p", "__r", "rules")


def schedule(requests: DataFrame, host: str, at: str, tie: str, delay_s: float, chunk: int = 50_000) -> DataFrame:
    """Requests with ``start``: the earliest times that keep ``delay_s`` between requests of a host.

    Requests of a host are served in order of arrival. The start of the i-th is
    i x delay plus the greatest arrival so far, each less its own number of
    delays: a running maximum, taken over chunks of a host, so that no task holds
    one host. Requests without a host or time are left out.
    """
    rows = requests.where(F.col(host).isNotNull() & F.col(at).isNotNull())
    placed = numbered(rows, [host], [at, tie], chunk=chunk)
    step = int(delay_s * 1_000_000)
    slack = placed.withColumn("__v", F.unix_micros(at) - F.col("pos") * F.lit(step))
    inside = Window.partitionBy(host, "chunk").orderBy("pos")
    own = slack.withColumn("__m", F.max("__v").over(inside))
    before = Window.partitionBy(host).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    states = slack.groupBy(host, "chunk").agg(F.max("__v").alias("__s")).withColumn("__before", F.max("__s").over(before)).drop("__s")
    joined = own.join(states, [host, "chunk"])
    micros = F.col("pos") * F.lit(step) + F.greatest("__m", "__before")
    return joined.withColumn("start", F.timestamp_micros(micros)).drop("__v", "__m", "__before", "pos", "chunk")


def frontier_step(frontier: DataFrame, seen: DataFrame, found: DataFrame, take: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One transition: ``(to fetch, frontier, seen)``.

    Takes the ``take`` oldest unseen urls, appends the found ones that are not
    seen, and marks the taken as seen. ``frontier`` and ``found`` have ``(seq, url)``.
    """
    batch = unseen(frontier, seen).orderBy("seq").limit(take)
    now_seen = seen.select("url").unionByName(batch.select("url")).distinct()
    later = unseen(frontier.unionByName(found), now_seen).select("seq", "url")
    return batch.select("seq", "url"), later, now_seen


def within_budget(rows: DataFrame, order: str, budget: int) -> DataFrame:
    """The first ``budget`` rows by ``order``; -1 is no limit."""
    return rows if budget < 0 else rows.orderBy(order).limit(budget)
