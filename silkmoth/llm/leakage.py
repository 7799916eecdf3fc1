"""Evaluation passages in documents: an FM-index a shard, searched with phrases of the items.

Every worker indexes its documents shard by shard. All phrases of four words of
all items are searched at once by backward search and located; a document and an
item whose hits lie closely on one diagonal are aligned word by word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkmoth.llm.fm_index import FMIndex
from silkmoth.plans.lineage import materialise

#: Words of a phrase that is searched.
PHRASE = 4
#: Words of a passage that a document must repeat.
LEAST = 20
#: One word in so many may be changed, dropped or added.
PER_EDIT = 8
#: A phrase is common beyond this share of all words (and this number) outside the documents found with its item.
COMMON, COMMON_LEAST = 5e-6, 5
#: Share of a stretch's phrases that are not common in a leak.
RARE = 0.25
#: Words that one index holds.
SHARD = 300_000
#: Most items; they are broadcast, so more is an error.
MAX_ITEMS = 100_000
#: Pairs of a hit and an item's phrase that are looked at together.
TOGETHER = 2_000_000

_WORDS = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff\ufe20-\ufe2f\u00ad\u200b-\u200f\u2060\ufeff]+")
# letters that do not decompose (fixed values)
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i"})


def words_of(text: str) -> list[str]:
    """Words without case, accents and punctuation."""
    flat = text.casefold()
    if not flat.isascii():
        flat = _MARKS.sub("", unicodedata.normalize("NFKD", flat)).translate(_PLAIN)
    return _WORDS.findall(flat)


@dataclass
class Items:
    """Texts of items as sequences of word numbers, with their distinct phrases.

    Items of one text are one entry; ``ids`` has the ids of each.
    """

    ids: list[list[int]]
    words: list[np.ndarray]
    whole: list[bool]
    numbers: dict[str, int]

    def __post_init__(self) -> None:
        grams: dict[tuple, list[tuple[int, int]]] = {}
        #: texts shorter than a phrase: length -> numbers of the texts
        self.short: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            t = w.tolist()
            if len(t) < PHRASE:
                self.short.setdefault(len(t), []).append(i)
            for p in range(len(t) - PHRASE + 1):
                grams.setdefault(tuple(t[p : p + PHRASE]), []).append((i, p))
        self.phrases = np.array(list(grams), np.int64).reshape(-1, PHRASE)
        sizes = np.array([len(v) for v in grams.values()], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = [x for v in grams.values() for x in v]
        self.item = np.array([x[0] for x in flat], np.int64)
        self.place = np.array([x[1] for x in flat], np.int64)
        self._order = np.argsort(self.item, kind="stable")
        self._phrase = np.repeat(np.arange(len(sizes)), sizes)[self._order]
        self._first = np.searchsorted(self.item[self._order], np.arange(len(self.words) + 1))

    def of(self, i: int) -> np.ndarray:
        """Numbers of the phrases of text ``i``."""
        return self._phrase[self._first[i] : self._first[i + 1]]

    def of_short(self, i: int) -> int:
        """Number that stands for text ``i`` as a phrase of its own."""
        return len(self.phrases) + i


def load_items(items: DataFrame, most: int = MAX_ITEMS) -> Items:
    """Passages (or questions, where the passage is null) as :class:`Items`.

    Items without an id, with fewer than ``LEAST`` words in the passage, or with
    neither passage nor question, cannot be found and are left out; a question may
    be of any length. Word 1 stands for all words that no item has, 2 ends a document.
    """
    rows = items.select("item_id", "passage", "question").where("item_id is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} items; search them in parts")
    numbers: dict[str, int] = {}
    texts: dict[tuple[bool, tuple[int, ...]], set[int]] = {}
    for r in sorted({(r.item_id, r.passage, r.question) for r in rows}, key=repr):
        w = words_of(r[1] if r[1] is not None else r[2] or "")
        if len(w) < (LEAST if r[1] is not None else 1):
            continue
        texts.setdefault((r[1] is None, tuple([numbers.setdefault(x, len(numbers) + 3) for x in w])), set()).add(r[0])
    return Items([sorted(v) for v in texts.values()], [np.array(w, np.int64) for _, w in texts], [q for q, _ in texts], numbers)


def align(item: list[int], doc: list[int], whole: bool, seeds: list[tuple[int, int]]) -> tuple[int, int] | None:
    """Range of ``doc`` that repeats the item closely enough, else None.

    A passage needs a stretch of at least ``LEAST`` of its words that begins and
    ends with equal words; a question is needed whole. ``seeds`` are (item, doc)
    positions of phrases they share.
    """
    n, m = len(item), len(doc)
    if whole:
        most = n // PER_EDIT
        best = None
        tried: list[int] = []
        for p, q in seeds:
            if any(abs(q - p - d) <= most for d in tried):
                continue  # the window tried has it whole
            tried.append(q - p)
            lo, hi = max(0, q - p - 2 * most), min(m, q - p + n + 2 * most)
            # edit distance of the whole item to any part of the window
            part = doc[lo:hi]
            prev = [(0, j) for j in range(len(part) + 1)]
            for i in range(1, n + 1):
                cur = [(i, 0)]
                a = item[i - 1]
                for j in range(1, len(part) + 1):
                    d, s = prev[j - 1]
                    x = (d + (a != part[j - 1]), s)
                    y = (prev[j][0] + 1, prev[j][1])
                    z = (cur[j - 1][0] + 1, cur[j - 1][1])
                    cur.append(min(x, y, z))
                prev = cur
            j = min(range(len(prev)), key=lambda k: prev[k][0])
            if prev[j][0] <= most and (best is None or prev[j][0] < best[0]):
                best = (prev[j][0], lo + prev[j][1], lo + j)
            if best:
                return best[1], best[2]
        return None
    done: list[tuple[int, int, int]] = []
    best = None
    for p, q in seeds:
        if any(lo <= p < hi and q - p == d for lo, hi, d in done):
            continue  # in an equal run that was extended already
        lo, hi = p, p
        while lo and q - p + lo and item[lo - 1] == doc[q - p + lo - 1]:
            lo -= 1
        while hi < n and q - p + hi < m and item[hi] == doc[q - p + hi]:
            hi += 1
        done.append((lo, hi, q - p))
        got = _stretch(item, doc, p, q)
        if got and (best is None or got[1] - got[0] > best[1] - best[0]):
            best = got
    return best


def _stretch(item: list[int], doc: list[int], p: int, q: int) -> tuple[int, int] | None:
    """The longest stretch through item word ``p`` at document word ``q``, extended both ways."""
    most = len(item) // PER_EDIT
    after = _reach(item[p:], doc[q : q + len(item) - p + most], most)
    before = _reach(item[:p][::-1], doc[max(0, q - p - most) : q][::-1], most)
    best = None
    for e, (i, j) in enumerate(after):
        for f, (k, h) in enumerate(before):
            if i + k >= LEAST and e + f <= (i + k) // PER_EDIT and (best is None or i + k > best[0]):
                best = (i + k, q - h, q + j)
    return best[1:] if best else None


def _reach(item: list[int], doc: list[int], most: int) -> list[tuple[int, int]]:
    """For each number of edits, the most item words repeated from the beginning on, and document words.

    Each ends with equal words, or is empty.
    """
    n, m = len(item), len(doc)
    out: list[tuple[int, int]] = []
    # furthest-reaching words by edits: reach[d] = item words matched on diagonal d
    reach = {0: 0}
    top = (0, 0)
    for edits in range(most + 1):
        if edits:
            step: dict[int, int] = {}
            for d, i in reach.items():
                for dd, ii in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):  # changed, dropped, added
                    if ii <= n and 0 <= ii + dd <= m and step.get(dd, -1) < ii:
                        step[dd] = ii
            reach = step
        for d, i in reach.items():
            start = i
            while i < n and i + d < m and item[i] == doc[i + d]:
                i += 1
            reach[d] = i
            if i > start and i > top[0]:
                top = (i, i + d)
        out.append(top)
        if top[0] == n or not reach:
            break
    return out


@dataclass
class Found:
    """Stretches ``(document, item, from word, to word)`` of a shard, and how often each phrase occurs in it.

    ``inside`` has the item's phrases in the stretch's document, ``held`` those in the stretch.
    """

    stretches: list[tuple[int, int, int, int]]
    inside: list[list[int]]
    held: list[list[int]]
    phrases: np.ndarray
    counts: np.ndarray


def search_shard(index: FMIndex, text: np.ndarray, starts: np.ndarray, items: Items) -> Found:
    """What repeats items in one shard, common or not.

    Hits are paired with the items that have their phrase by blocks of documents,
    so that phrases of many items, found often, do not fill the memory.
    """
    none = np.zeros(0, np.int64)
    out = Found([], [], [], none, none)
    ends = np.append(starts[1:], len(text))
    for length, own in items.short.items():
        lo, hi = index.search(np.array([items.words[i] for i in own], np.int64).reshape(-1, length))
        some = np.flatnonzero(hi > lo)
        out.phrases = np.append(out.phrases, [items.of_short(own[k]) for k in some]).astype(np.int64)
        out.counts = np.append(out.counts, hi[some] - lo[some]).astype(np.int64)
        for k in some.tolist():
            place = np.sort(index.locate(np.arange(lo[k], hi[k])))
            docs, first, times = np.unique(np.searchsorted(starts, place, side="right") - 1, return_index=True, return_counts=True)
            for d, at, n in zip(docs.tolist(), place[first].tolist(), times.tolist(), strict=True):
                out.stretches.append((d, own[k], at - int(starts[d]), at - int(starts[d]) + length))
                out.inside.append([])
                out.held.append([items.of_short(own[k])])
    if not len(items.phrases):
        return out
    lo, hi = index.search(items.phrases)
    found = np.flatnonzero(hi > lo)
    n = hi[found] - lo[found]
    out.phrases, out.counts = np.append(out.phrases, found), np.append(out.counts, n)
    at = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    place = index.locate(at)
    phrase = np.repeat(found, n)
    order = np.argsort(place)
    place, phrase = place[order], phrase[order]
    hit_doc = np.searchsorted(starts, place, side="right") - 1
    uses = items.starts[phrase + 1] - items.starts[phrase]
    size = np.array([len(w) for w in items.words])
    whole = np.array(items.whole, bool)
    # blocks of whole documents with a bounded number of pairs
    last = np.flatnonzero(np.append(hit_doc[1:] != hit_doc[:-1], True)) + 1 if len(hit_doc) else none
    sums = np.concatenate([[0], np.cumsum(uses)])
    a = 0
    while a < len(place):
        b = int(last[max(np.searchsorted(sums[last], sums[a] + TOGETHER, side="right") - 1, np.searchsorted(last, a, side="right"))])
        _pair(place[a:b], phrase[a:b], uses[a:b], text, starts, ends, items, size, whole, out)
        a = b
    return out


def _pair(place: np.ndarray, phrase: np.ndarray, uses: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: Items, size: np.ndarray, whole: np.ndarray, out: Found) -> None:
    """Add the stretches of the documents with the hits ``place``, in order, of ``phrase``."""
    k = np.repeat(items.starts[phrase] - np.concatenate([[0], np.cumsum(uses)[:-1]]), uses) + np.arange(uses.sum())
    where = np.repeat(place, uses)
    doc = np.searchsorted(starts, where, side="right") - 1
    item, ip = items.item[k], items.place[k]
    dp = where - starts[doc]
    keep = dense(doc, item, ip, dp, size, whole)
    if not len(keep):
        return
    doc, item, ip, dp = doc[keep], item[keep], ip[keep], dp[keep]
    order = np.lexsort((dp, ip, item, doc))
    doc, item, ip, dp = doc[order], item[order], ip[order], dp[order]
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(doc)).tolist(), strict=True):
        d, i = int(doc[a]), int(item[a])
        own = text[starts[d] : ends[d]]
        got = align(items.words[i].tolist(), own.tolist(), items.whole[i], list(zip(ip[a:b].tolist(), dp[a:b].tolist(), strict=True)))
        if got:
            lo, hi = np.searchsorted(place, [starts[d], ends[d]])
            mine = np.isin(phrase[lo:hi], items.of(i))
            here, at = phrase[lo:hi][mine], place[lo:hi][mine] - starts[d]
            out.stretches.append((d, i, got[0], got[1]))
            out.inside.append(here.tolist())
            out.held.append(here[(at >= got[0]) & (at + PHRASE <= got[1])].tolist())


def uncommon(parts: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start, end)``: the stretches of :func:`leaks`' parts without those of common phrases.

    At least ``RARE`` of a leak's phrases hardly occur in all documents outside those
    found with the item, however many these are. Other items with the same words
    do not matter. A question shorter than a phrase is a phrase of its own, which must
    be rare in all documents.
    """
    counts = parts.where("kind = 1").groupBy("phrase").agg(F.sum("n").alias("n"))
    words = parts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    found = parts.where("kind = 0")
    inside = found.select("item", F.explode("inside").alias("phrase")).groupBy("item", "phrase").agg(F.count("*").alias("own"))
    bound = F.greatest(F.lit(float(COMMON_LEAST)), COMMON * F.col("words"))
    held = found.select("row", "item", F.explode("held").alias("phrase"))
    # a short question is held by its documents without being inside
    every = inside.unionByName(held.select("item", "phrase").distinct().join(inside, ["item", "phrase"], "left_anti").withColumn("own", F.lit(0).cast("long")))
    rare = every.join(counts, "phrase").crossJoin(F.broadcast(words)).select("item", "phrase", (F.col("n") - F.col("own") <= bound).cast("int").alias("rare"))
    share = held.join(rare, ["item", "phrase"]).groupBy("row").agg(F.avg("rare").alias("share"))
    leaks_ = found.join(share.where(F.col("share") >= RARE), "row").select("doc_id", F.explode("item_ids").alias("item_id"), "start", "end")
    return leaks_


def _need(words: int) -> int:
    """Phrases that survive the edits allowed in a stretch of ``words``."""
    return max(1, words - PHRASE + 1 - PHRASE * (words // PER_EDIT))


def dense(doc: np.ndarray, item: np.ndarray, ip: np.ndarray, dp: np.ndarray, size: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Numbers of the hits that may lie in a stretch.

    ``size`` has the words of each item. Of a document and an item, hits in one band
    of diagonals must be at as many places as the edits allowed in a stretch of some
    length leave within that length.
    """
    slack = np.maximum(1, size // PER_EDIT)
    least = np.array([_need(int(n)) for n in size]) if len(size) else size
    floor = np.where(whole, least, min(_need(LEAST), _need(-(-LEAST // PER_EDIT) * PER_EDIT)))
    band = (dp - ip) // (slack[item] + 1)
    keep = np.zeros(len(ip), bool)
    for shift in (0, 1):  # a band and its neighbour, so that no stretch is cut
        both = (band + shift) // 2
        order = np.lexsort((ip, both, item, doc))
        d, t, k, at = doc[order], item[order], both[order], ip[order]
        first = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        group = np.cumsum(first) - 1
        fresh = np.concatenate([[True], first[1:] | (at[1:] != at[:-1])])
        enough = np.bincount(group, fresh, minlength=group[-1] + 1 if len(group) else 0)[group] >= floor[t] if len(group) else first[:0]
        keep[order[enough & whole[t]]] = True
        near = enough & ~whole[t]
        order, t, at, group, fresh = order[near], t[near], at[near], group[near], fresh[near]
        if not len(order):
            continue
        total = np.concatenate([[0], np.cumsum(fresh)])
        key = group * (1 << 32) + at
        steps = range(LEAST // PER_EDIT, int(size[t].max()) // PER_EDIT + 1)
        for edits in steps:  # the longest stretch with so many edits has the most room, the shortest the least need
            words = max(LEAST, edits * PER_EDIT)
            to = np.searchsorted(key, key + (edits + 1) * PER_EDIT, side="right")
            ok = (total[to] - total[:-1] + ~fresh >= _need(words)) & (size[t] >= words)
            # all hits of the window pass, as any of them may be the seed
            mark = np.zeros(len(key) + 1, np.int64)
            np.add.at(mark, np.flatnonzero(ok), 1)
            np.add.at(mark, to[ok], -1)
            keep[order[np.cumsum(mark[:-1]) > 0]] = True
    return np.flatnonzero(keep)


_SCHEMA = "kind int, row bigint, doc_id bigint, item_ids array<bigint>, item bigint, start bigint, end bigint, inside array<bigint>, held array<bigint>, phrase bigint, n bigint"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [pa.int32()] + [pa.list_(pa.int64()) if "array" in x else pa.int64() for x in _SCHEMA.split(", ")[1:]]


def leaks(docs: DataFrame, items: Items, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """``(doc_id, item_id, start, end)``: documents with the items they repeat.

    ``start`` and ``end`` count the words of the document (letters and digits,
    without accents) and are what to remove. Rows with a null key or text are left
    out; a row delivered again gives its leaks again; empty texts hold none. A text
    of any length is indexed whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(items)  # size bounded by MAX_ITEMS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sigma = len(own.numbers) + 3
        keys: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 36

        def flush() -> pa.RecordBatch:
            nonlocal row
            starts = np.cumsum([0, *[len(p) for p in parts[:-1]]]).astype(np.int64)
            whole = np.concatenate(parts)
            got = search_shard(FMIndex(whole, sigma), whole, starts, own)
            rows = [(0, row + k, keys[g[0]], own.ids[g[1]], g[1], g[2], g[3], x, y, None, None) for k, (g, x, y) in enumerate(zip(got.stretches, got.inside, got.held, strict=True))]
            row += len(rows)
            rows += [(1, *[None] * 8, p, n) for p, n in zip(got.phrases.tolist(), got.counts.tolist(), strict=True)]
            rows.append((2, *[None] * 9, len(whole)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = np.fromiter((own.numbers.get(x, 1) for x in words_of(t)), np.int64)
                keys.append(k)
                parts.append(np.append(w, 2))
                held += len(w) + 1
                if held >= shard:
                    yield flush()
                    keys, parts, held = [], [], 0
        if parts:
            yield flush()

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return uncommon(materialise(rows.mapInArrow(search, _SCHEMA)))


def removal_spans(found: DataFrame) -> DataFrame:
    """``(doc_id, start, end, items)``: the leaks of each document with overlaps merged."""
    per = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "item_id"))).alias("s"))  # at most one entry an item
    zero = F.array().cast("array<struct<start:bigint,end:bigint,items:array<bigint>>>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last.start.alias("start"), F.greatest(last.end, x.end).alias("end"), F.array_union(last["items"], F.array(x.item_id)).alias("items"))
        fresh = F.struct(x.start.alias("start"), x.end.alias("end"), F.array(x.item_id).alias("items"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)).end >= x.start), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    return per.select("doc_id", F.explode(F.aggregate("s", zero, step)).alias("m")).select("doc_id", "m.start", "m.end", "m.items")
