"""Mixing sources to target weights by hierarchical budgeting.

Leaf sizes are summed on the cluster; the tree, whose levels (source, language,
domain or others, in any order) are a parameter and whose size is checked, is
budgeted on the driver: a node's budget goes to its children by what they want,
what a child cannot take goes to its siblings, and only what the whole subtree
cannot take goes to the ancestor's other children. Each leaf then takes whole
epochs and, of one more, the prefix in a seeded order that fits.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkmoth.plans.lineage import materialise

#: Most leaves that the driver budgets; more is an error, never a cut.
MAX_LEAVES = 50_000
#: Where the public vocabulary lies; a parameter, nothing of it is copied.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the 50k byte-level vocabulary splits text before merging (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Levels of the budget tree, from its root; targets name the weighted one.
LEVELS, WEIGHTED = ("source", "domain", "lang"), "source"


def word_size(text: Column) -> Column:
    """Number of blank-separated words; null counts 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[^ \\t\\n\\r]+"), F.lit(0))), F.lit(0)).cast("long")


def clean_name(name: Column) -> Column:
    """A source name without case and outer blanks."""
    return F.lower(F.regexp_replace(name, r"^[ \t\n\r]+|[ \t\n\r]+$", ""))


def label_code(label: Column) -> Column:
    """Language part of a label: ``en-GB`` -> ``en``; ``und`` where there is none."""
    code = F.regexp_extract(F.lower(F.trim(label)), "^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when(label.isNull() | (code == ""), F.lit("und")).otherwise(code)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level encoding stored at ``path``, once per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, keep: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """``keep`` columns plus ``size``, the tokens of ``text`` (null: 0)."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("size", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            # ten thousand characters at a time, cut at blanks, keep one encode call short
            sizes = [0 if t is None else sum(len(enc.encode_ordinary(p)) for p in pieces(t)) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "size"])

    return df.select(*keep, text).mapInArrow(count, schema)


def pieces(text: str, most: int = 10_000) -> Iterator[str]:
    """``text`` in parts of about ``most`` characters, cut before blanks."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def domain_of(host: Column) -> Column:
    """Last label of a host name, empty for null."""
    return F.coalesce(F.lower(F.regexp_extract(host, r"([^.:/]+)(?::\d+)?\.?$", 1)), F.lit(""))


@dataclass
class Node:
    """A node of the budget tree."""

    size: int = 0
    capacity: float = 0.0
    wanted: float = 0.0
    budget: float = 0.0
    #: how often the documents of a leaf may be used
    repeats: int = 0
    children: dict[str, Node] = field(default_factory=dict)


def share_out(budget: float, wants: list[float], caps: list[float]) -> list[float]:
    """Split ``budget`` by ``wants``; what one cannot take goes to the others by their wants."""
    got = [0.0] * len(wants)
    open_, left = [i for i in range(len(wants)) if caps[i] > 0 and wants[i] > 0], budget
    while open_ and left > 1e-9:
        total = sum(wants[i] for i in open_)
        full = [i for i in open_ if got[i] + left * wants[i] / total >= caps[i]]
        if not full:
            for i in open_:
                got[i] += left * wants[i] / total
            break
        for i in full:
            left -= caps[i] - got[i]
            got[i] = caps[i]
        open_ = [i for i in open_ if i not in full]
    return got


def build_tree(leaves: list[tuple[tuple[str, ...], int]], weights: dict[str, float], repeats: dict[str, int], total: float, at: int = 0) -> Node:
    """Tree of ``leaves`` (path, size); level ``at`` names what ``weights`` and ``repeats`` are given for.

    A name wants its weight of ``total``, spread over its leaves by size; other names have no place in the tree.
    """
    sizes: dict[str, int] = {}
    for path, size in leaves:
        sizes[path[at]] = sizes.get(path[at], 0) + size
    root = Node()
    for path, size in leaves:
        name = path[at]
        if name not in weights:
            continue
        node = root
        for part in path:
            node = node.children.setdefault(part, Node())
        node.size, node.repeats, node.capacity = size, repeats[name], float(repeats[name] * size)
        node.wanted = weights[name] * total * size / sizes[name] if sizes[name] else 0.0

    def up(node: Node) -> None:
        if node.children:
            for child in node.children.values():
                up(child)
            for x in ("size", "capacity", "wanted"):
                setattr(node, x, sum(getattr(c, x) for c in node.children.values()))

    up(root)
    return root


def set_budgets(root: Node, total: float) -> None:
    """Propagate ``total`` down the tree; see the module's text for the order."""

    def down(node: Node) -> None:
        kids = list(node.children.values())
        for k, got in zip(kids, share_out(node.budget, [k.wanted for k in kids], [k.capacity for k in kids]), strict=True):
            k.budget = got
            down(k)

    root.budget = min(max(total, root.wanted), root.capacity)
    down(root)


def sized(documents: DataFrame, size: Column | None, id_: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", host: str | None = "host", tokenizer: str = TOKENIZER, **levels: Column) -> DataFrame:
    """``(doc_id, source, lang, domain, ..., size)`` of every document, written once.

    ``levels`` adds columns for levels of the tree by name; null is the empty name.
    Without a column ``host`` the domain is empty.
    """
    domain = domain_of(F.col(host)) if host in documents.columns else F.lit("")
    every = {"source": F.coalesce(clean_name(F.col(source)), F.lit("")), "lang": label_code(F.col(lang)), "domain": domain} | {k: F.coalesce(c.cast("string"), F.lit("")) for k, c in levels.items()}
    names = ["doc_id", *every]
    keep = documents.select(F.col(id_).alias("doc_id"), *[c.alias(k) for k, c in every.items()], F.col(text).alias("text"))
    if size is None:
        return materialise(token_sizes(keep, names, "text", tokenizer))
    return materialise(keep.select(*names, size.alias("size")))


@dataclass
class Plan:
    """A budgeted mix."""

    root: Node
    total: int
    levels: tuple[str, ...]
    at: int
    weights: dict[str, float]
    repeats: dict[str, int]

    def every(self) -> list[tuple[tuple[str, ...], Node]]:
        """The leaves with their paths."""
        todo: list[tuple[tuple[str, ...], Node]] = [((), self.root)]
        out = []
        while todo:
            path, node = todo.pop()
            if len(path) == len(self.levels):
                out.append((path, node))
            todo += [((*path, name), child) for name, child in node.children.items()]
        return sorted(out, key=lambda x: x[0])

    def report(self, spark) -> DataFrame:
        """Per source (or what else is weighted): wanted and reached size and share, and whether it falls short.

        A source is ``short`` where its budget is all it can give and less than its share of the size of all documents.
        """
        sums = {name: [0, 0.0, 0.0] for name in self.weights}
        for path, leaf in self.every():
            x = sums[path[self.at]]
            x[0], x[1], x[2] = x[0] + leaf.size, x[1] + leaf.capacity, x[2] + leaf.budget
        reached = sum(x[2] for x in sums.values())
        rows = []
        for name, (size, capacity, budget) in sorted(sums.items()):
            wanted = float(self.weights[name] * self.total)
            rows.append((name, self.weights[name], self.repeats[name], size, wanted, capacity, budget, budget / reached if reached else 0.0, bool(budget >= capacity and budget < wanted)))
        schema = "source string, target_share double, max_repeats int, size bigint, wanted double, capacity double, budget double, share double, short boolean"
        return spark.createDataFrame(rows, schema).coalesce(1)

    def leaves(self, spark) -> DataFrame:
        """Per leaf: whole epochs and the size still wanted of one more."""
        rows = []
        for path, leaf in self.every():
            whole = min(int(leaf.budget // leaf.size), leaf.repeats) if leaf.size else leaf.repeats
            rows.append((*path, whole, float(leaf.budget - whole * leaf.size) if leaf.size and whole < leaf.repeats else 0.0))
        names = ", ".join(f"{x} string" for x in self.levels)
        return spark.createDataFrame(rows, f"{names}, epochs int, rest double").coalesce(1)


def plan_mix(sizes: DataFrame, targets: DataFrame, levels: Sequence[str] = LEVELS, weighted: str = WEIGHTED) -> Plan:
    """Budget tree of ``sizes`` for ``targets`` ``(source, target_share, max_repeats)``.

    ``levels`` names columns of ``sizes`` from the root down; ``weighted`` is the one
    whose names the targets have. Targets with a null name, share or cap are left
    out; of targets that name one source twice the shares add up and the greater
    cap holds. Documents of other sources, or without one, count in the total only.
    """
    levels = tuple(levels)
    t = targets.select(clean_name(F.col("source")).alias("source"), F.col("target_share"), F.col("max_repeats")).dropna()
    named = t.groupBy("source").agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r"))
    got = named.limit(MAX_LEAVES + 1).collect()
    leaves = sizes.groupBy(*levels).agg(F.sum("size").alias("size")).limit(MAX_LEAVES + 1).collect()
    if max(len(leaves), len(got)) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves; group the tree's levels more coarsely")
    weights, repeats = {r.source: r.w for r in got}, {r.source: r.r for r in got}
    total = sum(r.size for r in leaves)
    at = levels.index(weighted)
    root = build_tree([(tuple(r[x] for x in levels), r.size) for r in leaves], weights, repeats, float(total), at)
    set_budgets(root, float(total))
    return Plan(root, total, levels, at, weights, repeats)


def select_mix(sizes: DataFrame, plan: Plan, seed: int = 7) -> DataFrame:
    """``(doc_id, levels..., size, repeats)`` of the documents taken at least once.

    A leaf's order in its partial epoch is a seeded hash of the id. Sizes are summed
    per hash bucket, so only the bucket at the border is ordered row by row.
    """
    spark = sizes.sparkSession
    leaf = list(plan.levels)
    leaves = F.broadcast(plan.leaves(spark))  # at most MAX_LEAVES rows
    h = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    rows = sizes.join(leaves, leaf).withColumn("__h", h).withColumn("__b", F.shiftrightunsigned("__h", 52).cast("int"))
    order = Window.partitionBy(*leaf).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy(*leaf, "__b").agg(F.sum("size").alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(order), F.lit(0)))
    border = buckets.withColumn("__whole", F.col("__before") + F.col("__s"))
    joined = rows.join(border, [*leaf, "__b"])
    some = F.col("rest") > 0
    on_border = some & (F.col("__before") < F.col("rest")) & (F.col("__whole") > F.col("rest"))
    # whole buckets are taken or left without ordering their rows
    plain = joined.where(~on_border).withColumn("__in", (some & (F.col("__whole") <= F.col("rest"))).cast("int"))
    inside = Window.partitionBy(*leaf, "__b").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = joined.where(on_border).withColumn("__in", (F.col("__before") + F.sum("size").over(inside) <= F.col("rest")).cast("int"))
    out = plain.unionByName(cut).withColumn("repeats", (F.col("epochs") + F.col("__in")).cast("int"))
    return out.where(F.col("repeats") > 0).select("doc_id", *leaf, "size", "repeats")
