"""Occurrences and records of every term, by burst tries.

A worker routes terms by prefix into small containers; a container that grows
past its limit bursts into one per next letter. Each worker sends its containers
as compact subtrees. Routes are then chosen from the subtrees' sizes, matching
subtrees meet in one task, are merged, and come out as terms with their counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkmoth.llm.terms import terms_of
from silkmoth.plans.lineage import materialise, slices

#: Terms a container holds before it bursts.
BURST = 2048
#: Terms a worker holds before it sends its trie and starts another.
FLUSH = 400_000
#: Terms (summed over workers) that one merging group may hold.
GROUP = 200_000
#: Letters that routes look at; 36 + 36^2 + 36^3 prefixes at most reach the driver.
ROUTE_DEPTH = 3

#: Redelivered keys that are sent to every task; more are met by a shuffle of all rows.
MAX_AGAIN = 1_000_000

_SUBTREE = "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>, n bigint"


class BurstTrie:
    """Terms with two counters each."""

    __slots__ = ("burst", "root", "size")

    def __init__(self, burst: int = BURST):
        # an inner node is a list [children by letter, counters of the term ending here]; a container is a dict
        self.root: list | dict = {}
        self.burst, self.size = burst, 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        """Add to the counters of ``term``."""
        node, up, at, n = self.root, None, 0, len(term)
        while node.__class__ is list:
            if at == n:
                if node[1] is None:
                    node[1] = [0, 0]
                    self.size += 1
                node[1][0] += occurrences
                node[1][1] += records
                return
            up, letter = node, term[at]
            at += 1
            node = up[0].get(letter)
            if node is None:
                node = up[0][letter] = {}
        rest = term[at:]
        got = node.get(rest)
        if got is None:
            node[rest] = [occurrences, records]
            self.size += 1
            if len(node) > self.burst:
                split = self._split(node)
                if up is None:
                    self.root = split
                else:
                    up[0][term[at - 1]] = split
        else:
            got[0] += occurrences
            got[1] += records

    @staticmethod
    def _split(container: dict) -> list:
        inner: list = [{}, container.pop("", None)]
        for rest, c in container.items():
            inner[0].setdefault(rest[0], {})[rest[1:]] = c
        return inner

    def subtrees(self) -> Iterator[tuple[str, dict]]:
        """The containers with their prefixes; a term that ends at an inner node is one of its own."""
        todo: list[tuple[str, list | dict]] = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if isinstance(node, dict):
                if node:
                    yield prefix, node
                continue
            if node[1] is not None:
                yield prefix, {"": node[1]}
            todo += [(prefix + letter, child) for letter, child in node[0].items()]


def _rows(trie: BurstTrie) -> pa.RecordBatch:
    parts = list(trie.subtrees())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p for p, _ in parts], pa.string()),
            pa.array([list(c) for _, c in parts], pa.list_(pa.string())),
            pa.array([[v[0] for v in c.values()] for _, c in parts], pa.list_(pa.int64())),
            pa.array([[v[1] for v in c.values()] for _, c in parts], pa.list_(pa.int64())),
            pa.array([len(c) for _, c in parts], pa.int64()),
        ],
        names=["prefix", "suffixes", "occurrences", "records", "n"],
    )


def _records(n: int) -> pa.RecordBatch:
    """The row that holds a worker's number of records."""
    return pa.RecordBatch.from_arrays(
        [pa.array([None], pa.string()), pa.array([[]], pa.list_(pa.string())), pa.array([[]], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.int64())), pa.array([n], pa.int64())],
        names=["prefix", "suffixes", "occurrences", "records", "n"],
    )


class _Worker:
    """Counts of the texts of one worker; full tries go out as rows."""

    def __init__(self, burst: int, flush: int):
        self.trie, self.burst, self.flush, self.records = BurstTrie(burst), burst, flush, 0
        self.occurred: Counter = Counter()
        self.held: Counter = Counter()

    def add(self, text: str) -> Iterator[pa.RecordBatch]:
        self.records += 1
        own = Counter(terms_of(text))
        self.occurred.update(own)
        self.held.update(own.keys())
        if len(self.occurred) > self.flush // 4:
            self._drain()
            if self.trie.size > self.flush:
                yield _rows(self.trie)
                self.trie = BurstTrie(self.burst)

    def _drain(self) -> None:
        for term, k in self.occurred.items():
            self.trie.add(term, k, self.held[term])
        self.occurred.clear()
        self.held.clear()

    def end(self) -> Iterator[pa.RecordBatch]:
        self._drain()
        if self.trie.size:
            yield _rows(self.trie)
        yield _records(self.records)


def count_subtrees(rows: DataFrame, key: str, content: str, burst: int = BURST, flush: int = FLUSH) -> DataFrame:
    """Subtrees of every worker; the row with a null prefix holds the worker's number of records.

    Texts are counted where they lie. Only those of keys that come more than once
    are set aside and brought together, so that each counts once.
    """
    got = rows.select(F.col(key).alias("k"), F.col(content).alias("t")).where("k is not null and t is not null")
    again = materialise(got.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"))
    kind = got.schema["k"].dataType.simpleString()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Worker(burst, flush)
        last = None
        for b in slices(batches):
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != last:  # rows of one key follow each other
                    yield from work.add(text)
                last = k
        yield from work.end()

    if again.count() > MAX_AGAIN:
        return got.repartition("k").sortWithinPartitions("k").mapInArrow(alone, _SUBTREE)
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(again.toArrow().column(0).to_pylist()))  # size checked

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Worker(burst, flush)
        several = shared.value
        names = ["prefix", "suffixes", "occurrences", "records", "n", "k", "t"]

        def wide(tries: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in tries:
                yield pa.RecordBatch.from_arrays([*x.columns, pa.nulls(x.num_rows, types[0]), pa.nulls(x.num_rows, pa.string())], names=names)

        types: list = [pa.int64()]
        for b in slices(batches):
            types[0] = b.column(0).type
            later = []
            for i, (k, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if k in several:
                    later.append(i)
                else:
                    yield from wide(work.add(text))
            if later:
                part = b.take(pa.array(later, pa.int64()))
                lists = pa.nulls(len(later), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(later), pa.string()), pa.nulls(len(later), pa.list_(pa.string())), lists, lists, pa.nulls(len(later), pa.int64()), part.column(0), part.column(1).cast(pa.string())], names=names)
        yield from wide(work.end())

    both = materialise(got.mapInArrow(first, f"{_SUBTREE}, k {kind}, t string"))
    rest = both.where("k is not null").select("k", "t").repartition("k").sortWithinPartitions("k")
    return both.where("k is null").drop("k", "t").unionByName(rest.mapInArrow(alone, _SUBTREE))


def choose_routes(masses: dict[str, int], group: int = GROUP, depth: int = ROUTE_DEPTH) -> dict[str, int]:
    """Prefixes to route by, each with the number of parts its terms are hashed into.

    ``masses`` has the number of terms by prefix of at most ``depth`` letters. A
    prefix is split by its next letter while it holds more than ``group`` terms.
    """
    sums: Counter = Counter()
    for p, n in masses.items():
        for k in range(min(len(p), depth) + 1):
            sums[p[:k]] += n
    children: dict[str, list[str]] = {}
    for q in sums:
        if q:
            children.setdefault(q[:-1], []).append(q)
    routes: dict[str, int] = {}
    todo = [""]
    while todo:
        p = todo.pop()
        below = children.get(p, []) if sums[p] > group and len(p) < depth else []
        if below:
            routes[p] = 1  # terms that are no longer than the prefix
            todo += below
        else:
            routes[p] = max(1, -(-sums[p] // group))
    return routes


def longest(term: str, routes: dict[str, int], depth: int = ROUTE_DEPTH) -> str:
    """The longest route that begins ``term``."""
    for k in range(min(depth, len(term)), 0, -1):
        if term[:k] in routes:
            return term[:k]
    return ""


def route_of(term: str, routes: dict[str, int], depth: int = ROUTE_DEPTH) -> str:
    """The longest route that begins ``term``, with the part of its hash."""
    at = longest(term, routes, depth)
    parts = routes.get(at, 1)
    return f"{at}#{zlib.crc32(term.encode()) % parts}" if parts > 1 else at


def merge_subtrees(subtrees: DataFrame, group: int = GROUP, depth: int = ROUTE_DEPTH) -> DataFrame:
    """``(term, occurrences, records)`` of all subtrees together."""
    real = subtrees.where("prefix is not null")
    # a prefix shorter than the depth is completed from its terms; at most 36^depth rows come back
    head = F.substring(F.concat(F.col("prefix"), F.col("s")), 1, depth)
    masses = real.select("prefix", F.explode("suffixes").alias("s")).groupBy(head.alias("p")).count()
    routes = choose_routes({r.p: r["count"] for r in masses.collect()}, group, depth)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out: dict[str, tuple[list, list, list]] = {}
            for row in b.to_pylist():
                p = row["prefix"]
                at = longest(p, routes, depth) if len(p) >= depth else None
                whole = at if at is not None and routes.get(at, 1) == 1 else None
                if whole is not None:
                    t = out.setdefault(whole, ([], [], []))
                    t[0].extend(p + s for s in row["suffixes"])
                    t[1].extend(row["occurrences"])
                    t[2].extend(row["records"])
                    continue
                for s, o, r in zip(row["suffixes"], row["occurrences"], row["records"], strict=True):
                    t = out.setdefault(route_of(p + s, routes, depth), ([], [], []))
                    t[0].append(p + s)
                    t[1].append(o)
                    t[2].append(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(out), pa.string()), pa.array([t[0] for t in out.values()], pa.list_(pa.string())), pa.array([t[1] for t in out.values()], pa.list_(pa.int64())), pa.array([t[2] for t in out.values()], pa.list_(pa.int64()))],
                names=["route", "terms", "occurrences", "records"],
            )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        trie = BurstTrie()
        for terms, occ, rec in zip(pdf["terms"], pdf["occurrences"], pdf["records"], strict=True):
            for t, o, r in zip(terms, occ.tolist(), rec.tolist(), strict=True):
                trie.add(t, o, r)
        got = [(p + s, c[0], c[1]) for p, sub in trie.subtrees() for s, c in sub.items()]
        return pd.DataFrame(got, columns=["term", "occurrences", "records"])

    routed = real.mapInArrow(send, "route string, terms array<string>, occurrences array<bigint>, records array<bigint>")
    return routed.groupBy("route").applyInPandas(merge, "term string, occurrences bigint, records bigint")


def term_counts(rows: DataFrame, key: str, content: str, least: int = 3, most: float = 0.4) -> DataFrame:
    """``(term, occurrences, records, mark)`` of every term of ``content``.

    ``mark`` is ``rare`` below ``least`` records, else ``common`` from the share
    ``most`` of all records on, else null. Rows with one ``key`` count once; rows
    with a null key or null content are left out; an empty text is a record
    without terms; a table without records gives no rows.
    """
    subtrees = materialise(count_subtrees(rows, key, content))
    total = subtrees.where("prefix is null").agg(F.sum("n")).first()[0] or 0
    mark = F.when(F.col("records") < least, "rare").when(F.col("records") >= F.lit(most) * F.lit(total), "common")
    return merge_subtrees(subtrees).withColumn("mark", mark)
