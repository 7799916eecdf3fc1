"""How distinctive a term is for its record: parsimonious language models.

Every record has a mixture of its own model and the background; expectation
maximisation moves the mass of terms that the background explains out of the
record's model. Background counts come by a join on the term, where the few
terms that hold many rows are joined by a broadcast of checked size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkmoth.llm.terms import terms_of
from silkmoth.plans.lineage import materialise, slices

#: Share of a record's mixture that is its own model.
LAMBDA = 0.5
#: Rounds of expectation maximisation; changes beyond are below 1e-4 on test data.
ROUNDS = 15
#: A term is hot from this share of the records on. Each record adds its distinct
#: terms once, so there are at most 1/HOT x (mean distinct terms) hot terms.
HOT = 1 / 64
#: Most hot terms that are broadcast; beyond, they are joined like the others.
MAX_HOT = 200_000


def current_records(docs: DataFrame, url: str = "url", key: str = "fetch_id", at: str = "last_modified", content: str = "content") -> DataFrame:
    """Current record of every url, with its terms: ``(url, key, terms, counts)``.

    Of the rows of a url with non-null content the one with the latest ``at`` is
    current (null is oldest, ties go to the higher ``key``). Rows with a null url
    or key name no record and are left out. Text is turned into term counts before
    anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [Counter(terms_of(t)) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([list(c) for c in own], pa.list_(pa.string())), pa.array([list(c.values()) for c in own], pa.list_(pa.int32()))],
                names=["url", "key", "at", "terms", "counts"],
            )

    rows = docs.select(F.col(url).alias("url"), F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(content).alias("content")).dropna(subset=["url", "key", "content"])
    counted = rows.mapInArrow(count, "url string, key bigint, at timestamp, terms array<string>, counts array<int>")
    newest = F.max_by(F.struct("key", "terms", "counts"), F.struct(F.col("at").isNotNull(), F.col("at"), F.col("key")))
    return counted.groupBy("url").agg(newest.alias("r")).select("url", "r.key", "r.terms", "r.counts")


def hot_background(background: DataFrame, records: int, hot: float = HOT, most: int = MAX_HOT) -> dict[str, tuple[int, int]]:
    """``df`` and ``cf`` of the hot terms; none are hot if they are more than ``most``."""
    got = background.where(F.col("df") >= F.lit(max(2.0, hot * records))).limit(most + 1).collect()
    return {r.term: (r.df, r.cf) for r in got} if len(got) <= most else {}


def fit(offsets: np.ndarray, counts: np.ndarray, back: np.ndarray, lam: float = LAMBDA, rounds: int = ROUNDS) -> np.ndarray:
    """Converged probabilities of the cells of many records; ``offsets`` begins each record."""
    if not len(counts):
        return np.zeros(0)
    sizes = np.diff(np.append(offsets, len(counts)))
    at = np.repeat(np.arange(len(offsets)), sizes)
    full = offsets[sizes > 0]
    sums = np.zeros(len(offsets))

    def normal(x: np.ndarray) -> np.ndarray:
        sums[sizes > 0] = np.add.reduceat(x, full)
        return x / np.maximum(sums, 1e-300)[at]

    p = normal(counts.astype(float))
    for _ in range(rounds):
        own = lam * p
        p = normal(counts * own / np.maximum(own + (1 - lam) * back, 1e-300))
    return p


def fitted(docs: DataFrame, lam: float = LAMBDA, rounds: int = ROUNDS, **names: str) -> tuple[DataFrame, DataFrame, int]:
    """Models ``(rid, t)``, the urls ``(rid, url)`` of the records, and the number of records.

    ``t`` is an array of ``(term, tf, df, prob)``: the term's share of the record's
    occurrences, the records that hold it and its probability in the converged
    model. Records without terms have an empty array; an empty table gives no rows.

    A record stays one row. Its hot terms find their background in a broadcast of
    checked size; only the others are shuffled, to be joined with theirs by term.
    """
    current = materialise(current_records(docs, **names).select(F.xxhash64("url", "key").alias("rid"), "url", "terms", "counts"))
    records = current.count()
    each = current.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("c"))
    background = materialise(each.groupBy("term").agg(F.count("*").cast("int").alias("df"), F.sum("c").alias("cf")))
    total = background.agg(F.sum("cf")).first()[0] or 1
    shared = docs.sparkSession.sparkContext.broadcast(hot_background(background, records))
    cold = background.where(F.col("df") < F.lit(max(2.0, HOT * records))) if shared.value else background

    cells = current.select("rid", F.explode("terms").alias("term")).join(cold, "term")
    # lists of one aggregation keep one order
    rest = cells.groupBy("rid").agg(F.collect_list("term").alias("own"), F.collect_list("df").alias("df"), F.collect_list("cf").alias("cf"))
    rows = current.select("rid", "terms", "counts").join(rest, "rid", "left")

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for b in slices(batches):
            dfs: list[int] = []
            cfs: list[int] = []
            for terms, own, df, cf in zip(*(b.column(k).to_pylist() for k in (1, 3, 4, 5)), strict=True):
                found = dict(zip(own, zip(df, cf, strict=True), strict=True)) if own else {}
                for t in terms:
                    d, c = hot.get(t) or found[t]
                    dfs.append(d)
                    cfs.append(c)
            lists = b.column(1)
            counts = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            prob = fit(ends[:-1], counts, np.array(cfs, float) / total, lam, rounds)
            n = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=counts, minlength=len(sizes))
            tf = counts / np.repeat(n, sizes)
            cells = pa.StructArray.from_arrays([lists.flatten(), pa.array(tf), pa.array(dfs, pa.int32()), pa.array(prob)], names=["term", "tf", "df", "prob"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)], names=["rid", "t"])

    models = rows.mapInArrow(model, "rid bigint, t array<struct<term:string,tf:double,df:int,prob:double>>")
    return models, current.select("rid", "url"), records


def record_models(docs: DataFrame, lam: float = LAMBDA, rounds: int = ROUNDS, **names: str) -> DataFrame:
    """One row per (url, term): ``(url, term, tf, df, prob)``; see :func:`fitted`."""
    models, urls, _ = fitted(docs, lam, rounds, **names)
    return models.join(urls, "rid").select("url", F.explode("t").alias("t")).select("url", "t.term", "t.tf", "t.df", "t.prob")


def distinctive(models: DataFrame, urls: DataFrame, records: int, k: int = 3, floor: float = 1e-4) -> DataFrame:
    """The ``k`` best terms of every record: ``(url, term, weight, prob)``.

    Only terms in at least 2 and at most half of the records qualify. The
    converged model proposes the terms it left a probability of ``floor`` or
    more; the exact weight (0.4 + 0.6 tf) ln(N/df) orders them, ties by the term.
    A qualifying term that the model dropped comes back if its exact weight beats
    the k-th proposed one, so the result equals the exact order. A record is one
    row, so ordering its terms shuffles nothing.
    """
    n = F.lit(float(max(records, 1)))

    def entry(x):
        return F.struct((-((F.lit(0.4) + F.lit(0.6) * x.tf) * F.log(n / x.df))).alias("w"), x.term.alias("term"), x.prob.alias("prob"))

    fit_ = F.filter("t", lambda x: (x.df >= 2) & (x.df <= F.lit(records / 2)))
    rows = models.select("rid", F.transform(fit_, entry).alias("t"))
    best = rows.select("rid", F.slice(F.array_sort(F.filter("t", lambda x: x.prob >= floor)), 1, k).alias("best"), F.filter("t", lambda x: x.prob < floor).alias("dropped"))
    last = F.try_element_at("best", F.lit(k))
    back = F.filter("dropped", lambda x: last.isNull() | (x < last))
    checked = best.select("rid", F.explode(F.slice(F.array_sort(F.concat("best", back)), 1, k)).alias("t"))
    return checked.join(urls, "rid").select("url", F.col("t.term").alias("term"), (-F.col("t.w")).alias("weight"), F.col("t.prob").alias("prob"))
