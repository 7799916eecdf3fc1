"""Keyword-stuffed and link-list pages: coherence of neighbouring words.

A line is coherent where the mean pointwise mutual information of its
neighbouring words, normalised and discounted by corpus counts, is nearer to the
corpus's mean than to that of words never seen together, and where it is no
excessive repetition of collocations of its page. A page whose main part holds
more incoherent text than sentences is spam.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from silkmoth.llm.page_stats import FLOOR, Hashes, Stats, main_of, pages_of, pair_hashes, parsed, statistics
from silkmoth.llm.pages import ENDS, FILED, GARBLED, Line, Page
from silkmoth.plans.lineage import slices

#: A collocation is excessive from so many times and this share of the main part on.
TIMES, SHARE = 5, 0.01
#: A word beyond ASCII that a page has so often is no name, known or not.
OFTEN = 3
#: Share of excessive collocations that makes a line incoherent.
EXCESS = 0.6
#: Where Cyrillic letters begin (fixed value).
CYRILLIC = "Ѐ"
#: Share of the main part that is incoherent on a spam page at least, besides more than its sentences.
GREATER = 0.25
#: Elements of table and list rows (fixed values); their cells need not go together.
ROWS = frozenset(["table", "tr", "td", "th", "ul", "ol", "li", "dl", "dt", "dd"])


def main_lines(page: Page) -> list[Line]:
    """Lines of the main part beside the headline: of its container, or of the whole page without a headline."""
    main = main_of(page)
    rows = (x for i, x in enumerate(page.lines) if i != page.head and not (page.html and x.path[: len(main)] != main))
    return [x for x in rows if not x.flags & (FILED | GARBLED)]


def in_rows(line: Line, main: int) -> bool:
    """Whether a line is of a table or list inside the main part, which ``main`` containers hold."""
    return line.element in ROWS or any(x.split(" ", 1)[0] in ROWS for x in line.path[main:])


class Judge:
    """Judges pages by the corpus statistics; remembers hashes of words up to a bound."""

    def __init__(self, stats: Stats):
        self.stats = stats
        self.hashes = Hashes()
        #: half way from the corpus's mean to neighbours that never go together
        self.least = (stats.mean + FLOOR) / 2

    def lines(self, pages: list[list[Line]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each line of ``pages``: mean information of its neighbours, how many of them tell something, and the share of excessive ones."""
        words: list[str] = []
        sizes: list[int] = []
        own: list[int] = []
        for k, lines in enumerate(pages):
            single = False
            for line in lines:
                new = line.text.split(" ")
                one = len(new) == 1
                if words and not (one and single):
                    words.append("")
                    sizes[-1] += 1
                words += new
                sizes.append(len(new))
                own.append(k)
                single = one
            if words and words[-1]:
                words.append("")
                sizes[-1] += 1
        k = len(sizes)
        at = np.repeat(np.arange(k), sizes)
        page = np.array(own, np.int64)[at]
        h, first, which = np.unique(self.hashes(words), return_index=True, return_inverse=True)
        # rare names with letters beyond ASCII, and unknown Cyrillic words, say nothing
        latin = np.fromiter((words[i].isascii() for i in first.tolist()), bool, len(first))
        tells = (latin | self.stats.known(h))[which]
        foreign = [i for i in np.flatnonzero(~tells).tolist() if max(words[i]) < CYRILLIC]
        often = Counter((own[at[i]], words[i]) for i in foreign)
        tells[[i for i in foreign if often[own[at[i]], words[i]] >= OFTEN]] = True
        real = h[which] != 0
        p = np.flatnonzero(real[:-1] & real[1:])
        keys, same = np.unique(pair_hashes(h[which])[p], return_inverse=True)
        value = self.stats.pair(keys)[same]
        tells = (tells[p] & tells[p + 1]) | (value > FLOOR)
        _, same, times = np.unique(page[p] * (len(keys) + 1) + same, return_inverse=True, return_counts=True)
        size = np.bincount(page, real, len(pages))
        much = times[same] >= np.maximum(TIMES, SHARE * size + 1e-9)[page[p]]
        # neighbours across lines count for both
        a, b = at[p], at[p + 1]
        across = a != b
        both = np.concatenate([b, a[across]])
        tells, value, much = (np.concatenate([x, x[across]]) for x in (tells, value, much))
        n = np.bincount(both, tells, k)
        mean = np.bincount(both, tells * value, k) / np.maximum(n, 1)
        return mean, n, np.bincount(both, much, k) / np.maximum(np.bincount(both, minlength=k), 1)

    def pages(self, pages: list[Page]) -> list[tuple[int, int, int]]:
        """Letters of sentences, of incoherent lines, and of all lines, in the main part of each page."""
        rows = [main_lines(p) for p in pages]
        if not any(rows):
            return [(0, 0, 0)] * len(pages)
        told = zip(*(x.tolist() for x in self.lines(rows)), strict=True)
        out = []
        for page, lines in zip(pages, rows, strict=True):
            inner = len(main_of(page))
            good = bad = every = 0
            for line in lines:
                mean, n, excess = next(told)
                size = len(line.text)
                every += size
                excessive = excess >= EXCESS
                if excessive or (mean < self.least if n else not line.own):
                    # cells of rows outside links need not go together
                    if not line.own or excessive or not in_rows(line, inner):
                        bad += size
                elif line.flags & ENDS and line.own.count(" ") >= 3:
                    good += size
            out.append((good, bad, every))
        return out


def is_spam(good: int, bad: int, every: int) -> bool:
    """Whether more than the sentences, and enough of the main part, is incoherent."""
    return bad > good and bad > GREATER * every


def spam_pages(docs: DataFrame, **names: str) -> DataFrame:
    """``(fetch_id, sentence_letters, incoherent_letters, spam)`` of every page.

    Pages are HTML and plain text; other kinds, null and empty contents and rows
    with a null id have no row. Rows with one id come out once. Corpus counts are
    those of all different main parts.
    """
    pages = parsed(docs, **names)
    shared = docs.sparkSession.sparkContext.broadcast(statistics(pages))  # size checked

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for b in slices(batches):
            own = [(f, page) for f, _, _, page in pages_of(b)]
            got = [(f, *x) for (f, _), x in zip(own, judge.pages([p for _, p in own]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([is_spam(*g[1:]) for g in got], pa.bool_())], names=["fetch_id", "sentence_letters", "incoherent_letters", "spam"])

    return pages.rows.mapInArrow(find, "fetch_id bigint, sentence_letters bigint, incoherent_letters bigint, spam boolean").dropDuplicates(["fetch_id"])
