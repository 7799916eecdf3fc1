"""Inverted index: build, merge, clean, upsert, and the forms it is stored in.

The index is kept as rows ``(term, doc, tf)``: joins and aggregations prune,
spill and spread over rows. Posting lists are made from the rows in blocks of a
bounded size, so a term that every document holds is no single cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmoth.functions.text import drop_stop_words, stem_vocabulary, term_frequency, tokens
from silkmoth.operators.skew import numbered

#: Postings that one block of a list holds.
BLOCK = 4096
#: Longest value that a key-value item holds inline, in characters (fixed value).
INLINE = 399_000
#: Most stop words that are part of an expression.
MAX_STOP = 20_000
#: Bytes of a row group of a stored index; a lookup reads the groups of its terms.
ROW_GROUP = 1 << 20


def token_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``(doc, token)``, one row per token; a document without tokens has none."""
    return docs.select(F.col(doc).alias("doc"), F.explode(tokens(F.col(text))).alias("token"))


def term_counts(rows: DataFrame) -> DataFrame:
    """``(doc, token, n)``: how often each document holds each token."""
    return rows.groupBy("doc", "token").agg(F.count("*").alias("n"))


def kept_tokens(docs: DataFrame, doc: str, text: str, stop: DataFrame | None) -> DataFrame:
    """``(doc, kept, total)``: tokens of each document that are no stop words, with their number.

    A list of at most :data:`MAX_STOP` words is part of the expression, so nothing
    is shuffled; a longer one is joined.
    """
    rows = docs.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("kept"))
    if stop is not None:
        words = [r.token for r in stop.where("token is not null").select("token").distinct().limit(MAX_STOP + 1).collect()]
        if len(words) > MAX_STOP:
            kept = drop_stop_words(rows.select("doc", F.explode("kept").alias("token")), stop)
            rows = kept.groupBy("doc").agg(F.collect_list("token").alias("kept"))
        elif words:
            rows = rows.withColumn("kept", F.filter("kept", lambda x: ~x.isin(words)))
    return rows.withColumn("total", F.size("kept"))


def build(docs: DataFrame, doc: str, text: str, stop: DataFrame | None = None, stems: bool = True) -> DataFrame:
    """Postings ``(term, doc, tf)``: stop words go first, tokens that stem alike add up.

    ``tf`` is the share of the document's remaining tokens, in single precision.
    The stemmer sees each distinct token once. Null texts give no postings. A
    document is one row (of several rows with one name each has its own ``tf``); its
    tokens are counted where it lies, so one exchange brings its terms together.
    """
    rows = kept_tokens(docs, doc, text, stop)
    each = rows.select("doc", "total", F.explode("kept").alias("token"))
    if stems:
        named = stem_vocabulary(each)
        each = each.join(named, "token").withColumnRenamed("stem", "term")
    else:
        each = each.withColumnRenamed("token", "term")
    counts = each.groupBy("doc", "term", "total").agg(F.count("*").alias("n"))
    return counts.select("term", "doc", term_frequency(F.col("n"), F.col("total")).alias("tf"))


def store(postings: DataFrame, path: str, files: int = 8) -> DataFrame:
    """``postings`` written below ``path``, ranged and sorted by term, in small row groups; returns the stored index."""
    ranged = postings.repartitionByRange(files, "term").sortWithinPartitions("term", "doc")
    ranged.write.mode("errorifexists").option("parquet.block.size", ROW_GROUP).parquet(path)
    return postings.sparkSession.read.schema(postings.schema).parquet(path)


def document_frequency(postings: DataFrame) -> DataFrame:
    """``(term, df)`` of postings without repeated documents."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def merge(*indexes: DataFrame) -> DataFrame:
    """Postings of several runs together; documents may repeat, see :func:`last_wins`."""
    out = indexes[0]
    for other in indexes[1:]:
        out = out.unionByName(other)
    return out


def last_wins(postings: DataFrame, order: str) -> DataFrame:
    """One posting per term and document: that of the highest ``order``."""
    return postings.groupBy("term", "doc").agg(F.max_by("tf", order).alias("tf"))


def posting_lists(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(term, block, postings)``: lists in order of the documents, ``block`` entries at most each."""
    placed = numbered(postings, ["term"], ["doc"], chunk=block)
    lists = placed.groupBy("term", F.col("chunk").alias("block")).agg(F.array_sort(F.collect_list(F.struct("doc", "tf"))).alias("postings"))
    return lists


def from_lists(lists: DataFrame) -> DataFrame:
    """Postings from their lists."""
    return lists.select("term", F.explode("postings").alias("p")).select("term", "p.doc", "p.tf")


def to_json(postings: Column) -> Column:
    """Object text ``{doc: tf}`` of a list of postings."""
    return F.to_json(F.map_from_entries(F.transform(postings, lambda p: F.struct(p["doc"].cast("string").alias("key"), p["tf"].alias("value")))))


def from_json(info: Column) -> Column:
    """Map of documents to tf from an object text."""
    return F.from_json(info, "map<string,float>")


def routed(items: DataFrame, info: str = "info", inline: int = INLINE) -> DataFrame:
    """Items with ``inline`` and ``overflow``: values too long for one item go to the second."""
    fits = F.length(info) < inline
    return items.withColumn("inline", F.when(fits, F.col(info))).withColumn("overflow", F.when(~fits, F.col(info)))


def read_routed(items: DataFrame) -> DataFrame:
    """``info`` back from where it was routed."""
    return items.withColumn("info", F.coalesce("inline", "overflow"))


def to_text(lists: DataFrame) -> DataFrame:
    """Lines ``term<TAB>doc tf doc tf`` for exchange as text."""
    pairs = F.array_join(F.transform("postings", lambda p: F.concat_ws(" ", p["doc"].cast("string"), p["tf"].cast("string"))), " ")
    return lists.select(F.concat_ws("\t", "term", pairs).alias("value"))


def from_text(lines: DataFrame) -> DataFrame:
    """Postings of such lines; blanks may repeat, an odd last entry is left out."""
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("a")).where(F.size("a") > 2)
    at = F.sequence(F.lit(1), F.size("a") - 2, F.lit(2))
    pairs = F.transform(at, lambda i: F.struct(F.get("a", i).alias("doc"), F.get("a", i + 1).try_cast("float").alias("tf")))
    return parts.select(F.get("a", F.lit(0)).alias("term"), F.explode(pairs).alias("p")).select("term", "p.doc", "p.tf")
