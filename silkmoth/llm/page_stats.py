"""Parsed pages and their corpus statistics, shared by the operators on whole pages."""

from __future__ import annotations

import marshal
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkmoth.llm.pages import Line, Page, is_page, parse
from silkmoth.plans.lineage import materialise, release, slices

#: Longest lines of a main part that tell its copies.
TELLING = 2
#: Share of the pages (and number) from which on a word or a pair of neighbouring words is known.
#: Pages are different main parts here: copies of one count once, see :func:`statistics`.
#: Each page adds each of its pairs once, so at most 1/SEEN x (mean words of a page) pairs qualify.
SEEN, SEEN_LEAST = 0.0006, 3
#: A word on so many times the least number of pages is known well enough to miss its neighbours.
WELL = 10
#: Information of neighbours that the corpus never has together; it lies between -1 and 1.
FLOOR = -1.0
#: Rows that are copies whose numbers are sent to every task (eight bytes each); more are joined.
MAX_COPIES = 2_000_000
#: Hashes a worker holds before it sends its counts, and words whose hashes it remembers.
FLUSH, REMEMBERED = 2_000_000, 400_000
#: Most qualifying hashes that are broadcast (twelve bytes each); more is an error, as it is far beyond the bounds above.
MAX_HASHES = 20_000_000

_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_MASK = (1 << 63) - 1
# a pair is told by the low bits of its words' hashes
_LOW, _HIGH = (1 << 32) - 1, (1 << 31) - 1

SCHEMA = "fetch_id bigint, url string, host string, html boolean, head int, lines binary, row bigint, body bigint, kind byte, h bigint, n bigint"
_COUNTS = "kind byte, h bigint, n bigint"


def normal(low: str) -> str:
    """Words of a line; letters beyond ASCII are blanks in mostly ASCII text."""
    if not low.isascii() and len(low.encode("ascii", "ignore")) > 0.6 * len(low):
        return " ".join(_FOREIGN.sub(" ", low).split())
    return low


def unit_of(line: Line) -> str:
    """The line's words as a unit, made once."""
    if not line.unit:
        line.unit = normal(line.text)
    return line.unit


def mark(text: str, kind: int) -> int:
    """A hash of ``text`` for one kind of count."""
    return xxhash.xxh3_64_intdigest(text, seed=kind) & _MASK


def main_texts(page: Page) -> list[str]:
    """Texts of the lines of the main part, of all lines if that is not known."""
    main = main_of(page)
    depth = len(main)
    return [x.text for x in page.lines if x.path[:depth] == main]


def main_of(page: Page) -> tuple[str, ...]:
    """The containers around the headline, none if there is no headline."""
    return page.lines[page.head].path if page.head >= 0 else ()


def body_of(page: Page) -> int:
    """A hash of the main part by its longest lines beside the headline.

    Navigation, headline and small changes do not matter, so copies on other sites,
    pages fetched again and rows delivered again have the same.
    """
    main = main_of(page)
    inside = [x for i, x in enumerate(page.lines) if i != page.head and x.path[: len(main)] == main] or page.lines
    texts = {x.own for x in inside if x.own} or {x.text for x in inside}  # links to other pages differ between copies
    return mark("\n".join(sorted(texts, key=lambda t: (-len(t), t))[:TELLING]), BODY)


def packed(page: Page) -> bytes:
    """The lines of a page as one value, which only workers of the same job read."""
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}
    return marshal.dumps([(x.no, x.text, x.own if x.links else None, x.links, paths.setdefault(x.path, x.path), x.element, x.cuts, x.own_cuts, x.flags, x.label) for x in page.lines])


def pages_of(batch: pa.RecordBatch) -> Iterator[tuple[int, str, str, Page]]:
    """``(fetch_id, url, host, page)`` of the rows of :func:`parsed`."""
    names = batch.schema.names
    columns = (batch.column(names.index(n)).to_pylist() for n in ("fetch_id", "url", "host", "html", "head", "lines"))
    for f, url, host, is_html, head, lines in zip(*columns, strict=True):
        yield f, url or "", host, _page(lines, is_html, head)


def _page(lines: bytes, is_html: bool, head: int) -> Page:
    own = [Line(no, text, text if own is None else own, links, path, element, cuts, own_cuts, flags, label) for no, text, own, links, path, element, cuts, own_cuts, flags, label in marshal.loads(lines)]
    return Page(own, is_html, head)


LINE, WORD, PAIR, PAGES, BODY = range(5)


def information(c, x, y, pages, least):
    """Normalised pointwise mutual information of pairs on ``c`` of ``pages``, words on ``x`` and ``y``; discounted.

    The information log2(c pages / (x y)) is divided by its greatest value
    log2(pages / c). As few pages tell little, ``least`` pages without the pair
    are added, which count as :data:`FLOOR`.
    """
    c, x, y = (np.asarray(v, float) for v in (c, x, y))
    pages = max(float(pages), 2.0)
    own = np.log2(pages / np.minimum(c, pages - 0.5))
    value = np.clip(np.log2(c * pages / (x * y)) / own, -1.0, 1.0)
    return (c * value + least * FLOOR) / (c + least)


@dataclass
class Stats:
    """Words and pairs known to the corpus, with the numbers of their pages."""

    pages: int
    least: float
    #: mean information of all neighbours of all pages
    mean: float
    #: hash of a word -> pages, and of a pair -> information
    word_keys: np.ndarray
    word_pages: np.ndarray
    pair_keys: np.ndarray
    pair_values: np.ndarray

    def pair(self, keys: np.ndarray) -> np.ndarray:
        """Information of pairs by their hashes."""
        if not len(self.pair_keys):
            return np.full(len(keys), FLOOR, np.float32)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_values[at], np.float32(FLOOR))

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Whether words, by their hashes, are on so many pages that their neighbours are known too."""
        if not len(self.word_keys):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.word_keys, keys), len(self.word_keys) - 1)
        return (self.word_keys[at] == keys) & (self.word_pages[at] >= WELL * self.least)


def joined(texts: list[str]) -> list[str]:
    """Words of lines in order, an empty word between lines that are no neighbours.

    Lines of one word each (a list of addresses, of tags) are neighbours.
    """
    out: list[str] = []
    single = False
    for t in texts:
        one = " " not in t
        if out and not (one and single):
            out.append("")
        if one:
            out.append(t)
        else:
            out += t.split(" ")
        single = one
    return out


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of all neighbours in a sequence of word hashes."""
    return ((h[:-1] & _HIGH) << 32) | (h[1:] & _LOW)


class Hashes:
    """Hashes of words, remembered up to a bound; the empty word has 0."""

    def __init__(self, most: int = REMEMBERED):
        self.most = most
        self.own: dict[str, int] = {"": 0}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.own) > self.most:
            self.own = {"": 0}
        own = self.own
        got = [own.get(w) for w in words]
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = own.setdefault(words[i], mark(words[i], WORD))
        return np.array(got, np.int64)


class Counts:
    """Numbers of main parts with each word and each pair of neighbours, as a worker counts them."""

    def __init__(self) -> None:
        self.hashes = Hashes()
        self.words: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []
        self.held = self.pages = 0

    def add(self, texts: list[str]) -> None:
        """Count a page of lines."""
        h = self.hashes(joined(texts))
        own = np.unique(h)
        self.words.append(own[1:] if len(own) and own[0] == 0 else own)
        self.pairs.append(np.unique(pair_hashes(h)[(h[:-1] != 0) & (h[1:] != 0)]))
        self.held += len(self.words[-1]) + len(self.pairs[-1])
        self.pages += 1

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(kind, hash, number)`` counted since the last time."""
        for k, got in ((WORD, self.words), (PAIR, self.pairs)):
            if got:
                h, n = np.unique(np.concatenate(got), return_counts=True)
                yield np.full(len(h), k, np.int8), h, n
        if self.pages:
            yield np.array([PAGES], np.int8), np.zeros(1, np.int64), np.array([self.pages])
        self.words, self.pairs, self.held, self.pages = [], [], 0, 0


@dataclass
class Parsed:
    """Pages with their visible lines, and counts of words and pairs of all of them."""

    rows: DataFrame
    counts: DataFrame


def parsed(docs: DataFrame, key: str = "fetch_id", url: str = "url", mime: str = "mime", content: str = "content") -> Parsed:
    """One row per HTML or plain text page with its visible lines; written once, with the words counted on the way.

    Rows with a null key or content, empty contents and other kinds of documents
    have no row. Redelivered rows stay. ``row`` numbers the rows, ``body`` is the
    same for copies of one main part.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        n = (task.partitionId() if task else 0) << 36
        counts = Counts()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

        def flush() -> Iterator[pa.RecordBatch]:
            for columns in counts.take():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(columns[0]), t) for t in types), *(pa.array(c) for c in columns)], names=names)

        for b in slices(batches):
            at, pages = [], []
            for i, (m, c) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if is_page(m, c):
                    at.append(i)
                    pages.append(parse(c, m))
                    counts.add(main_texts(pages[-1]))
            take = pa.array(at, pa.int64())
            urls = b.column(1).take(take)
            no = pa.array(range(n, n + len(at)), pa.int64())
            n += len(at)
            hosts = [re.sub(r"^[a-z]+://", "", u or "").split("/")[0].split(":")[0] for u in urls.to_pylist()]
            none = [pa.nulls(len(at), t) for t in (pa.int8(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), urls, pa.array(hosts, pa.string()), pa.array([p.html for p in pages], pa.bool_()), pa.array([p.head for p in pages], pa.int32()), pa.array([packed(p) for p in pages], pa.binary()), no, pa.array([body_of(p) for p in pages], pa.int64()), *none],
                names=names,
            )
            if counts.held > FLUSH:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(key).alias("fetch_id"), F.col(url).alias("url"), F.col(mime).alias("mime"), F.col(content).alias("content"))
    both = materialise(rows.where("fetch_id is not null and content is not null and content <> ''").mapInArrow(read, SCHEMA))
    return Parsed(both.where("kind is null").drop("kind", "h", "n"), both.where("kind is not null").select("kind", "h", "n"))


def statistics(pages_: Parsed) -> Stats:
    """Numbers of pages whose main part has each word and pair of neighbours, and the information of pairs.

    Rows with one id count once, and so do copies of one main part: of them the
    first row stands for all, however many they are. All rows were counted when
    they were parsed; what the copies added is counted again and taken off.
    """
    rows = pages_.rows
    ids = rows.groupBy("fetch_id").agg(F.min(F.struct("row", "body")).alias("x"))
    first = ids.groupBy("x.body").agg(F.min("x.row").alias("row")).select("row")
    copies = materialise(rows.select("row").join(first, "row", "left_anti"))
    own: np.ndarray | None = None
    if copies.count() <= MAX_COPIES:
        own = np.sort(copies.toArrow().column(0).to_numpy())
        again = rows.select("row", "lines", "head", "html")
    else:
        again = rows.select("row", "lines", "head", "html").join(copies.hint("shuffle_hash"), "row", "left_semi")
    shared = rows.sparkSession.sparkContext.broadcast(own)  # size checked

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        few = shared.value
        for b in slices(batches):
            if few is not None:
                b = b.filter(pa.array(np.isin(b.column(0).to_numpy(), few)))
            for x, head, is_html in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                counts.add(main_texts(_page(x, is_html, head)))
            if counts.held > FLUSH:
                yield from taken(counts)
        yield from taken(counts)

    def taken(counts: Counts) -> Iterator[pa.RecordBatch]:
        for kind, h, n in counts.take():
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(h), pa.array(-n)], names=["kind", "h", "n"])

    every = pages_.counts if own is not None and not len(own) else pages_.counts.unionByName(again.mapInArrow(count, _COUNTS))
    sums = materialise(every.groupBy("kind", "h").agg(F.sum("n").alias("n")))
    release(copies)
    totals = {r.kind: r.n for r in sums.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    pages = totals.get(PAGES, 0)
    least = max(SEEN_LEAST, SEEN * pages)
    kept = sums.where((F.col("kind") != PAGES) & (F.col("n") >= least))
    if kept.count() > MAX_HASHES:
        raise ValueError("more words and pairs qualify than may be broadcast")
    got = kept.toArrow()
    release(sums)
    kind, h, n = (got.column(c).to_numpy() for c in ("kind", "h", "n"))
    order = np.argsort(h, kind="stable")
    kind, h, n = kind[order], h[order], n[order]
    wh, wn, ph, pn = h[kind == WORD], n[kind == WORD], h[kind == PAIR], n[kind == PAIR]

    def pages_of_word(part: np.ndarray, mask: int) -> np.ndarray:
        by = np.argsort(wh & mask, kind="stable")
        at = np.searchsorted((wh & mask)[by], part)
        return wn[by][np.minimum(at, max(len(wn) - 1, 0))]

    # a pair's words are on its pages and so are known themselves
    values = information(pn, np.maximum(pages_of_word(ph >> 32, _HIGH), pn), np.maximum(pages_of_word(ph & _LOW, _LOW), pn), pages, least).astype(np.float32) if len(ph) else np.zeros(0, np.float32)
    every = max(totals.get(PAIR, 0), 1)
    mean = float((pn * values).sum() + (every - pn.sum()) * FLOOR) / every
    return Stats(pages, least, mean, wh, wn, ph, values)
