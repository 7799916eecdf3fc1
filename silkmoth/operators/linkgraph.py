"""Link graphs: adjacency lines, edges, degrees and link lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmoth.functions.binding import let
from silkmoth.operators.skew import numbered

#: Links that one row of a link list holds.
LINKS = 1000


def adjacency(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(url, dest)`` of lines ``url|dests``; dest is empty without a second part, a third is left out."""
    parts = F.split(F.col(value), r"\|", -1)
    return lines.select(F.get(parts, F.lit(0)).alias("url"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("dest"))


def split_unquoted(text: Column) -> Column:
    """``text`` cut at commas with an even number of double quotes behind them; quotes stay, empty pieces too.

    One pass: the pieces between quotes are told by their number, commas of the
    outer ones become a mark (marks in the text are escaped meanwhile), and the
    whole is cut at the marks. Time is linear in the length.
    """
    safe = F.replace(F.replace(text, F.lit("\x02"), F.lit("\x02b")), F.lit("\x01"), F.lit("\x02a"))

    def marked(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda x, i: F.when(F.pmod(F.size(pieces) - 1 - i, F.lit(2)) == 0, F.replace(x, F.lit(","), F.lit("\x01"))).otherwise(x)), '"')

    cut = F.split(let(F.split(safe, '"', -1), marked), "\x01", -1)
    return F.transform(cut, lambda x: F.replace(F.replace(x, F.lit("\x02a"), F.lit("\x01")), F.lit("\x02b"), F.lit("\x02")))


def edges(adjacent: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)``: ``dest`` cut at commas outside quotes, empty targets kept.

    Null ``url`` or ``dest`` gives no edge; an empty ``dest`` is an edge to ``""``.
    """
    rows = adjacent.select(F.col("url").alias("src"), F.explode(split_unquoted(F.col("dest"))).alias("dst"))
    return rows.where("src is not null").distinct()


def link_lists(links: DataFrame, src: str, dst: str, seq: str, size: int = LINKS) -> DataFrame:
    """``(src, part, dests)``: targets in order of arrival, repeats kept, in parts of ``size`` links."""
    rows = links.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(seq).alias("seq")).where("src is not null and dst is not null")
    placed = numbered(rows, ["src"], ["seq", "dst"], chunk=size)
    lists = placed.groupBy("src", F.col("chunk").alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("a"))
    return lists.select("src", "part", F.array_join(F.col("a.dst"), ",").alias("dests"))


def to_lines(lists: DataFrame) -> DataFrame:
    """Lines ``src|d1,d2`` of link lists, one per part."""
    return lists.select(F.concat_ws("|", "src", "dests").alias("value"))


def graph_stats(edge_rows: DataFrame) -> DataFrame:
    """One row: numbers of sources, edges and of edges that lead to a source."""
    sources = edge_rows.select(F.col("src").alias("dst")).distinct()
    inner = edge_rows.join(sources, "dst", "left_semi").agg(F.count("*").alias("inner_edges"))
    whole = edge_rows.agg(F.countDistinct("src").alias("sources"), F.count("*").alias("edges"))
    return whole.join(inner, F.lit(True))
