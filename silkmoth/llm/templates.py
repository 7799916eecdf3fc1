"""The article of a page: template deduction from pages of one host.

Units of a page (lines, their segments, text beside links) get occurrence
vectors over the different pages of a block of the host's pages. Units sharing
one vector are an equivalence class; a class is valid if its units keep their
order and nest in the gaps of greater classes. Valid classes, and units alone
that are on enough pages, are the host's template. What remains in the slot that
holds the headline is the article, but for units that are template of several
other hosts and rare on this one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkmoth.llm.page_stats import main_of, mark, normal, pages_of, parsed, statistics, unit_of
from silkmoth.llm.pages import ABOUT, CLOSED, FILED, Line, Page
from silkmoth.llm.word_salad import Judge, is_spam
from silkmoth.plans.lineage import materialise, slices

#: Pages of a host that one template is deduced from; a host of more has several blocks.
BLOCK = 300
#: Blocks that one task takes of a host one after the other; a greater host is spread by url.
BLOCKS = 4
#: A unit alone in its class needs this share of the block's urls.
ALONE = 0.1
#: A class of several units that stand only in the headline's slot needs this share (and number).
FEW, FEW_LEAST = 0.02, 3
#: Greater classes that a class must nest in.
GREATER = 8
#: Pages whose units beside their headline are the same by this share of their characters are copies.
SAME = 0.9
#: Hosts of so many different pages tell what hosts share, by units on so many of them.
SURE, SURE_PAGES = 8, 3
#: A unit is shared by hosts if it is template of this share (and number) of them. Each host counts
#: a unit of its template once, so at most 1/SHARED x (mean template of a host) units are shared.
SHARED, SHARED_LEAST = 0.002, 3
#: Most shared units that are broadcast (eight bytes each); more is an error, far beyond the bound above.
MAX_SHARED = 5_000_000
#: Hosts of more than one task's pages that are sent to every task; more are joined.
MAX_HOT = 100_000
#: Kinds of hashes.
UNIT, LABEL = 11, 12


def segments(text: str, cuts: tuple[int, ...]) -> list[str]:
    """The segments of a line's words, normalised; the whole if there is one."""
    if not cuts:
        return [x] if (x := normal(text)) else []
    words, at, out = text.split(" "), 0, []
    for n in cuts:
        if x := normal(" ".join(words[at : at + n])):
            out.append(x)
        at += n
    return out


def units(page: Page) -> list[list[str]]:
    """Normalised units of each line: the whole, its segments, its text outside links and the segments of that."""
    out = []
    for line in page.lines:
        u = [unit_of(line)]
        if line.cuts:
            u += segments(line.text, line.cuts)
        if line.links and line.own:
            u.append(normal(line.own))
            if line.own_cuts:
                u += segments(line.own, line.own_cuts)
        out.append(u if all(u) else [x for x in u if x])
    return out


def slot_units(page: Page, own: list[list[str]]) -> set[str]:
    """Units of lines without links in the container of the headline; ``own`` has those of each line."""
    main = main_of(page)
    out: set[str] = set()
    for i, x in enumerate(page.lines):
        if i != page.head and not x.links and x.path[: len(main)] == main:
            out.update(own[i])
    return out


def labels(page: Page) -> set[str]:
    """Headings right over links."""
    out = set()
    for a, b in zip(page.lines, page.lines[1:], strict=False):
        if b.links and a.element[:1] == "h" and a.element[1:].isdigit():
            out.add(unit_of(a))
    return out


def bodies(block: list[tuple[str, set[str]]]) -> list[int]:
    """Number of the body of each page ``(url, units in the slot)``; pages of one url, and copies, have the same.

    Every pair of copies is found: with units ranked from the rarest on, those before the
    first that two copies share are at most ``1 - SAME`` of either, so that it is among the
    leading units of both, which pages are looked up by.
    """
    body = list(range(len(block)))

    def root(k: int) -> int:
        while body[k] != k:
            body[k] = body[body[k]]
            k = body[k]
        return k

    pages = Counter(u for _, own in block for u in own)
    sizes = [sum(map(len, own)) for _, own in block]
    urls: dict[str, int] = {}
    by_unit: dict[str, list[int]] = defaultdict(list)
    for k, (url, own) in enumerate(block):
        body[root(k)] = root(urls.setdefault(url, k))
        spare = sizes[k] - SAME * sizes[k]
        alone = sum(len(u) for u in own if pages[u] == 1)
        if alone > spare:
            continue  # no other page has these
        common = sorted((u for u in own if pages[u] > 1), key=lambda u: (pages[u], -len(u), u))
        rare = [u for u, n in zip(common, accumulate(map(len, common), initial=alone), strict=False) if n <= spare]
        for other in sorted({j for u in rare for j in by_unit[u]}):
            if root(other) != root(k) and lacks_at_most(sizes[k] - SAME * max(sizes[k], sizes[other]) - alone, common, block[other][1]):
                body[root(k)] = root(other)
        for u in rare:
            by_unit[u].append(k)
    return [root(k) for k in range(len(block))]


def lacks_at_most(most: float, units_: list[str], theirs: set[str]) -> bool:
    """Whether those of ``units_`` that are not of ``theirs`` have at most so many characters."""
    if most < 0:
        return False
    for u in units_:
        if u not in theirs:
            most -= len(u)
            if most < 0:
                return False
    return True


@dataclass
class Template:
    """Units of a host's template with the number of bodies each is on, and the headings over links."""

    units: dict[str, int] = field(default_factory=dict)
    labels: dict[str, int] = field(default_factory=dict)
    bodies: int = 0
    #: the last two words of units, and their first two -> their numbers of words
    ends: dict[str, set[int]] | None = None
    starts: dict[str, set[int]] | None = None

    def without(self, text: str) -> str:
        """``text`` without the units it ends and begins with, unless nothing would be left."""
        if self.ends is None:
            self.ends, self.starts = {}, {}
            for u in self.units:
                if " " in u:
                    w = u.split(" ")
                    self.ends.setdefault(f"{w[-2]} {w[-1]}", set()).add(len(w))
                    self.starts.setdefault(f"{w[0]} {w[1]}", set()).add(len(w))
        words = text.split(" ")
        while len(words) > 2:
            sizes = self.ends.get(f"{words[-2]} {words[-1]}")
            n = max((n for n in sizes if n < len(words) and " ".join(words[-n:]) in self.units), default=0) if sizes else 0
            if not n:
                break
            del words[-n:]
        while len(words) > 2:
            sizes = self.starts.get(f"{words[0]} {words[1]}")
            n = max((n for n in sizes if n < len(words) and " ".join(words[:n]) in self.units), default=0) if sizes else 0
            n = n or words[0] in self.units
            if not n:
                break
            del words[: int(n)]
        return " ".join(words)


def deduce(block: list[tuple[str, list[list[str]]]], alone: float = ALONE, slots: list[set[str]] | None = None, known: list[bool] | None = None, heads: list[set[str]] | None = None) -> Template:
    """Template of pages ``(url, units by line)`` of one host.

    Pages of one url count once, by their union, as a page fetched again repeats
    its own article; so do copies at several urls. ``slots`` has the units of each
    page that stand in the headline's slot (:func:`slot_units`): classes of these
    alone, found on few pages, are text that several articles have. Where the
    headline is not ``known`` (plain text), nothing tells such text from the site's.
    ``heads`` has the headings over links of each page.
    """
    at_of = bodies([(url, own) for (url, _), own in zip(block, slots or [set()] * len(block), strict=True)])
    first: dict[str, int] = {}
    shared: set[str] = set()
    outside: set[str] = set()
    places: list[dict[str, int]] = []  # line of the first occurrence of each unit, page by page
    times: list[dict[str, int]] = []
    for k, (_, lines) in enumerate(block):
        at = at_of[k]
        place: dict[str, int] = {}
        many: dict[str, int] = {}
        for i, line in enumerate(lines):
            for u in line:
                if place.setdefault(u, i) != i or u in many:
                    many[u] = many.get(u, 1) + 1
        places.append(place)
        times.append(many)
        outside |= place.keys() - slots[k] if slots and (known is None or known[k]) else place.keys()
        for u in place:
            if first.setdefault(u, at) != at:
                shared.add(u)
    # only units of several bodies need a vector
    vectors: dict[str, dict[int, int]] = {u: {} for u in shared}
    sample: dict[int, int] = {}  # a page of each body
    for k, place in enumerate(places):
        at, many = at_of[k], times[k]
        sample.setdefault(at, k)
        for u in shared & place.keys():
            v = vectors[u]
            n = many.get(u, 1)
            if v.get(at, 0) < n:
                v[at] = n
    classes: dict[tuple, list[str]] = defaultdict(list)
    for u, v in vectors.items():
        classes[tuple(sorted(v.items()))].append(u)
    count = len(sample)
    need, few = max(2, alone * count), max(FEW_LEAST, FEW * count)
    out = Template(bodies=count)
    great: list[tuple[tuple, list[str]]] = []
    for v, group in sorted(classes.items(), key=lambda x: (-len(x[0]), x[0])):
        rows = [[places[sample[at]].get(u, -1) for u in group] for at, _ in v]
        if len(v) >= need:
            out.units.update(dict.fromkeys(group, len(v)))
            if len(great) < GREATER and len(group) > 1 and ordered(rows):
                great.append((v, group))
        elif len(set(rows[0])) > 1 and (len(v) >= few or not outside.isdisjoint(group)) and ordered(rows) and nested(v, rows, great, places, sample):
            out.units.update(dict.fromkeys(group, len(v)))
    if heads:
        on: dict[str, set[int]] = defaultdict(set)
        for k, own in enumerate(heads):
            for u in own:
                on[u].add(at_of[k])
        out.labels = {u: len(x) for u, x in on.items() if u and len(x) >= need}
    return out


def ordered(rows: list[list[int]]) -> bool:
    """Whether units whose lines on each page are ``rows`` keep one order; -1 is a unit of another copy."""
    order = sorted(range(len(rows[0])), key=lambda i: rows[0][i])
    for row in rows[1:]:
        last = -1
        for i in order:
            if row[i] >= 0:
                if row[i] < last:
                    return False
                last = row[i]
    return True


def nested(vector: tuple, rows: list[list[int]], great: list[tuple[tuple, list[str]]], places: list[dict[str, int]], sample: dict[int, int]) -> bool:
    """Whether a class lies in one gap of each greater class on all its pages, or around all of it."""
    for at, row in zip((a for a, _ in vector), rows, strict=True):
        own = [x for x in row if x >= 0]
        if not own:
            continue
        lo, hi = min(own), max(own)
        place = places[sample[at]]
        for _, group in great:
            theirs = [place[u] for u in group if u in place]
            inside = sum(lo < x < hi for x in theirs)
            if inside and inside < len(theirs):
                return False
    return True


def slot_of(block: list[tuple[int, str, Page]]) -> tuple[str, ...] | None:
    """The container that most headlines of the block stand in."""
    votes: dict[tuple[str, ...], int] = defaultdict(int)
    for _, _, page in block:
        if page.html and page.head >= 0:
            votes[page.lines[page.head].path] += 1
    return max(sorted(votes), key=lambda p: votes[p]) if votes else None


def rest(text: str, cuts: tuple[int, ...], template: dict[str, int], own: list[str] | None = None) -> list[str]:
    """Segments of ``text`` that are not of the template; none if the whole is. ``own`` has the whole and its segments, if known."""
    if own is None:
        own = [normal(text), *(segments(text, cuts) if cuts else [])]
    if not own or not own[0] or own[0] in template:
        return []
    return [x for x in (own[1:] if cuts else own) if x not in template]


#: A line that may be of the article, with what would make it the site's: hashes that must all be shared, by alternative.
Candidate = tuple[int, list[list[int]]]


def article(page: Page, template: Template, slot: tuple[str, ...] | None, own: list[list[str]]) -> list[Candidate]:
    """Lines of the page that the host's template leaves to the article; ``own`` has the units of each line."""
    return _html(page, template, slot, own) if page.html else _plain(page, template, own)


def _left(line: Line, template: Template, units_: list[str]) -> list[list[int]] | None:
    """What of a line must be shared by hosts for it to be the site's; None if it is the site's already."""
    if line.flags & (ABOUT | FILED):
        return None
    text = rest(line.text, line.cuts, template.units, units_[: len(line.cuts) + 1])
    if not text:
        return None
    ways = [[mark(x, UNIT) for x in text]]
    less = [y for x in text if (y := template.without(x)) not in template.units]
    if not less:
        return None
    if less != text:
        ways.append([mark(x, UNIT) for x in less])
    if line.cuts:
        ways.append([mark(unit_of(line), UNIT)])
    if line.links:
        own = rest(line.own, line.own_cuts, template.units)
        if not own:
            return None
        ways.append([mark(x, UNIT) for x in own])
    if line.label and (line.links or not line.path):
        label = normal(line.label)
        if label in template.labels:
            return None
        ways.append([mark(label, LABEL)])
    return ways


def _html(page: Page, template: Template, slot: tuple[str, ...] | None, own: list[list[str]]) -> list[Candidate]:
    head = page.head
    main = page.lines[head].path if head >= 0 else slot
    out: list[Candidate] = []
    for i, line in enumerate(page.lines):
        if main is not None and line.path[: len(main)] != main:
            continue
        if i == head:
            out.append((line.no, []))
            continue
        if line.label and not line.links:
            line.label = ""
        ways = _left(line, template, own[i])
        if ways is not None:
            out.append((line.no, ways))
    return out


def _plain(page: Page, template: Template, own: list[list[str]]) -> list[Candidate]:
    out: list[Candidate] = []
    under, last = False, 0
    over: str | None = None  # the first line of the paragraph, if it may head a list
    for line, units_ in zip(page.lines, own, strict=True):
        text = unit_of(line)
        near = line.no == last + 1
        last = line.no
        if text in template.labels:
            under, over = True, None
            continue
        if under and near and not line.flags & CLOSED and text not in template.units:
            continue  # a title in a list under its heading
        under = False
        if not near:
            over = None
        ways = _left(line, template, units_)
        if ways is not None:
            ways.append([mark(text, LABEL)])
            if over is not None and not line.flags & CLOSED:
                ways.append([mark(over, LABEL)])
            out.append((line.no, ways))
        if not near and not line.flags & CLOSED:
            over = text
        elif line.flags & CLOSED:
            over = None
    return out


_SCHEMA = "host string, fetch_id bigint, line_no int, ways array<array<bigint>>, shared array<bigint>"


def candidates(docs: DataFrame, **names: str) -> DataFrame:
    """Lines that the hosts' own templates leave, and the hashes of these templates by host and block; written once."""
    pages = parsed(docs, **names)
    rows = pages.rows.drop("row", "body")
    judged = docs.sparkSession.sparkContext.broadcast(statistics(pages))  # size checked
    most = BLOCK * BLOCKS
    hot = rows.groupBy("host").agg(F.count("*").alias("__n")).where(F.col("__n") > most).select("host", F.ceil(F.col("__n") / F.lit(most)).alias("__k"))
    hot = F.broadcast(hot) if hot.count() <= MAX_HOT else hot  # a great number is joined, hot hosts split by the skew join
    placed = rows.join(hot, "host", "left").withColumn("__part", F.pmod(F.xxhash64("url"), F.coalesce("__k", F.lit(1)))).drop("__k")
    grouped = placed.repartition("host", "__part").sortWithinPartitions("host", "__part", "url", "fetch_id")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(judged.value)
        held: list[tuple[int, str, Page]] = []
        at: tuple | None = None

        def work(host: str, block: list[tuple[int, str, Page]]) -> pa.RecordBatch:
            every = [units(page) for _, _, page in block]
            template = deduce(
                [(url, own) for (_, url, _), own in zip(block, every, strict=True)],
                slots=[slot_units(page, own) for (_, _, page), own in zip(block, every, strict=True)],
                known=[page.head >= 0 for _, _, page in block],
                heads=[labels(page) for _, _, page in block],
            )
            slot = slot_of(block)
            ids, nos, ways = [], [], []
            for (f, _, page), units_, judged_ in zip(block, every, judge.pages([page for _, _, page in block]), strict=True):
                if is_spam(*judged_):
                    continue
                for no, way in article(page, template, slot, units_):
                    ids.append(f)
                    nos.append(no)
                    ways.append(way)
            own = []
            if template.bodies >= SURE:
                own = [mark(u, UNIT) for u, n in template.units.items() if n >= SURE_PAGES] + [mark(u, LABEL) for u, n in template.labels.items() if n >= SURE_PAGES]
            return pa.RecordBatch.from_arrays(
                [pa.array([host] * (len(ids) + 1), pa.string()), pa.array([*ids, None], pa.int64()), pa.array([*nos, None], pa.int32()), pa.array([*ways, None], pa.list_(pa.list_(pa.int64()))), pa.array([*[None] * len(ids), own], pa.list_(pa.int64()))],
                names=["host", "fetch_id", "line_no", "ways", "shared"],
            )

        for b in slices(batches):
            part = b.column(b.schema.names.index("__part")).to_pylist()
            for i, (f, url, host, page) in enumerate(pages_of(b)):
                if (host, part[i]) != at:
                    if held:
                        yield work(at[0], held)
                    held, at = [], (host, part[i])
                if held and held[-1][0] == f:
                    continue  # delivered again
                held.append((f, url, page))
                if len(held) >= 2 * BLOCK:
                    yield work(at[0], held[:BLOCK])
                    held = held[BLOCK:]
        if held:
            yield work(at[0], held)

    return materialise(grouped.mapInArrow(find, _SCHEMA))


def shared_units(left: DataFrame) -> DataFrame:
    """``(h)``: units that are template of several hosts."""
    own = left.where("shared is not null")
    hosts = own.where(F.size("shared") > 0).select("host").distinct().count()
    each = own.select("host", F.explode("shared").alias("h")).distinct()
    return each.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= max(SHARED_LEAST, SHARED * hosts)).select("h")


def _sums(values: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Sums of ``values``, the flattened ones of ``lists``, by list."""
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros(0)


def articles(docs: DataFrame, **names: str) -> DataFrame:
    """``(fetch_id, line_no)``: the lines of each page that carry its article.

    Pages are HTML and plain text; spam pages, other kinds, null and empty contents
    and rows with a null id have none. Redelivered rows count once. Pages with a
    null url share one nameless host. A host's pages are taken in blocks of
    bounded size, so no task holds a host.
    """
    left = candidates(docs, **names)
    units_ = shared_units(left)
    if (most := units_.count()) > MAX_SHARED:
        raise ValueError(f"{most} units are shared by hosts, too many to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(units_.toArrow().column(0).to_numpy()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site = shared.value
        for b in batches:
            ways = b.column(2)
            each = ways.flatten()
            other = ~np.isin(each.flatten().to_numpy(), site)
            # a way makes the line the site's if none of its units is another
            way = _sums(other, each) == 0
            yield b.select(["fetch_id", "line_no"]).filter(pa.array(_sums(way, ways) == 0))

    return left.where("fetch_id is not null").select("fetch_id", "line_no", "ways").mapInArrow(keep, "fetch_id bigint, line_no int")
