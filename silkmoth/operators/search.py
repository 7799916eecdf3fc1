"""Scoring and paging of documents for a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silkmoth.functions.text import stem_vocabulary, tokens
from silkmoth.plans.lineage import materialise

#: Weights of the two signals and size of a page (fixed values).
TFIDF_WEIGHT, RANK_WEIGHT, PAGE = 0.99, 0.01, 10
#: Most terms of a query that are pushed to the index as a filter; more are joined.
PUSHED = 1000


def query_terms(spark: SparkSession, query: str, stems: bool = True) -> DataFrame:
    """Distinct terms of a query as ``(term)``; stop words stay in."""
    rows = spark.createDataFrame([(query,)], "q string").select(F.explode(tokens(F.col("q"))).alias("token")).distinct()
    if not stems:
        return rows.select(F.col("token").alias("term"))
    return stem_vocabulary(rows).select(F.col("stem").alias("term")).distinct()


def postings_of(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of ``terms``: read by a pushed filter for the few terms of a query, joined for more."""
    few = [r.term for r in terms.select("term").where("term is not null").distinct().limit(PUSHED + 1).collect()]
    if len(few) <= PUSHED:
        return postings.where(F.col("term").isin(few)) if few else postings.limit(0)
    return postings.join(terms.select("term").distinct(), "term", "left_semi")


def tfidf(postings: DataFrame, terms: DataFrame, documents: Column | float) -> DataFrame:
    """``(doc, tfidf)`` of the documents with any of ``terms``.

    Sums (0.4 + 0.6 tf) ln(N / df) over the terms found; ``documents`` is N. Scores
    fall below zero where df exceeds N. Of an index sorted by term
    (:func:`silkmoth.operators.index.store`) only the row groups of the terms are read.
    """
    hits = postings_of(postings, terms)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    n = documents if isinstance(documents, Column) else F.lit(float(documents))
    idf = df.select("term", F.ln(n / F.col("df")).alias("idf"))
    scored = hits.join(idf, "term")  # one row per term of the query; broadcast by its size
    return scored.groupBy("doc").agg(F.sum((F.lit(0.4) + F.lit(0.6) * F.col("tf").cast("double")) * F.col("idf")).alias("tfidf"))


def harmonic(score: Column, rank: Column) -> Column:
    """Weighted harmonic mean of score and rank; 0 where either is 0."""
    return F.when((score == 0) | (rank == 0), F.lit(0.0)).otherwise(F.lit(1.0) / (F.lit(TFIDF_WEIGHT) / score + F.lit(RANK_WEIGHT) / rank))


def blend(scores: DataFrame, ranks: DataFrame, doc: str = "doc", rank: str = "rank") -> DataFrame:
    """``(doc, tfidf, rank, harmonic)``; documents without a rank have rank 1."""
    own = ranks.select(F.col(doc), F.col(rank).alias("rank"))
    joined = scores.join(own, doc, "left").withColumn("rank", F.coalesce("rank", F.lit(1.0)))
    return joined.withColumn("harmonic", harmonic(F.col("tfidf"), F.col("rank")))


def page_number(page: int | None, total: int, size: int = PAGE) -> int:
    """The page shown for a request: the first if none or too high a one is asked for."""
    p = page or 1
    return 1 if p < 1 or total < (p - 1) * size else p


def page(ranked: DataFrame, number: int, size: int = PAGE, by: str = "harmonic", tie: str = "doc") -> DataFrame:
    """Rows of one page, best first, ties by the document."""
    return ranked.orderBy(F.desc(by), F.asc(tie)).offset((number - 1) * size).limit(size)


def flags(number: int, returned: int, size: int = PAGE) -> tuple[bool, bool]:
    """Whether a page is the first, and the last."""
    return number == 1, returned != size


def shown(ranked: DataFrame, asked: int | None, size: int = PAGE, by: str = "harmonic", tie: str = "doc") -> DataFrame:
    """Rows of the page shown for a request, with ``page``, ``first`` and ``last``.

    The hits are scored once: their number, which decides the page, and the page
    are read from one written result.
    """
    hits = materialise(ranked)
    number = page_number(asked, hits.count(), size)
    rows = page(hits, number, size, by, tie)
    first, last = flags(number, rows.count(), size)
    return rows.select("*", F.lit(number).alias("page"), F.lit(first).alias("first"), F.lit(last).alias("last"))
