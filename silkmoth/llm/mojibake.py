"""Garbled text from wrong decoding: improbable runs, and inverse mappings inside them.

Adjacent character pairs get their share of the corpus's mutual information;
maximum-scoring segments of pairs with hardly any share are improbable runs.
Only in these runs inverse mappings are tried: bytes of an encoding that was
wrongly taken for another must decode, and the restored characters must fit.
What no mapping restores counts as lost, in these runs only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkmoth.plans.lineage import materialise, slices

#: Encodings that UTF-8 is wrongly read with (names known to Python).
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac-roman", "cp850", "cp437", "cp1254", "iso8859-15")
#: Single-byte pairs (read as, truly) of Cyrillic text.
SINGLE = (("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1252", "cp866"), ("cp1251", "iso8859-5"), ("iso8859-5", "cp1251"), ("koi8-r", "cp866"), ("mac-cyrillic", "cp1251"), ("cp1251", "mac-cyrillic"))
#: Pairs with less than this part of the mutual information a row (log2 of millionths of a bit and one) are improbable: a fifth of a bit.
IMPROBABLE = 17.6
#: A pair counts from this part of the number that chance would give on (in bits), as pairs of common characters
#: that go together less than by chance are no less right.
SLACK = 6.0
#: Rows that must have a pair before it tells anything.
LEAST = 3
#: Most weight of one source (host) in the statistics, so that one garbled throughout does not make its garbage look right.
#: At most 1/SOURCE hosts have more rows, and are sent to every task.
SOURCE = 0.01
#: Letters that a run needs before a single-byte mapping is tried, and the gain a pair.
LETTERS, GAIN = 5, 2.5

#: Classes of characters: two ranges by character, the rest in two lumps; bounds the pair table to K x K.
_A, _B0, _B1 = 0x530, 0x2000, 0x2300
K = _A + (_B1 - _B0) + 2
_CLASS = np.full(0x110000, K - 1, np.uint16)
_CLASS[:_A] = np.arange(_A)
_CLASS[_B0:_B1] = _A + np.arange(_B1 - _B0)
_CLASS[0x2500:0x25A0] = K - 2

#: What a restored character may be (fixed values): Latin-1 letters and signs, a few letters beyond, Cyrillic, punctuation.
_FIT = frozenset([*range(0xA0, 0xB8), *range(0xB9, 0x100), 0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E, *range(0x400, 0x460), 0x490, 0x491, *range(0x2010, 0x203B), 0x20AC, 0x2116, 0x2122, 0x2212])


def codes(text: str) -> np.ndarray:
    """Code points of ``text``."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def plain(content: str) -> str:
    """``content`` with character references resolved."""
    return html.unescape(content) if "&" in content else content


def host_weights(rows: DataFrame, url: str, share: float = SOURCE) -> dict[str, float]:
    """Weights of the rows of hosts with more than ``share`` of all rows, at most 1/share hosts; all others weigh 1."""
    host = F.regexp_extract(F.col(url), "^[a-zA-Z]+://([^/:?#]*)", 1)
    per = rows.groupBy(F.coalesce(host, F.lit("")).alias("host")).agg(F.count("*").alias("n"))
    n = rows.count()
    return {r.host: share * n / r.n for r in per.where(F.col("n") > share * n).collect()}


def pair_counts(rows: DataFrame, text: str, url: str | None = None) -> np.ndarray:
    """Weighted numbers of rows with each pair of neighbours that are not both ASCII, and of rows with any.

    Every worker counts into one array of K x K numbers and sends its non-zero
    cells, so the driver gets at most K x K sums.
    """
    weights = host_weights(rows, url) if url else {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(K * K + 1)
        for b in slices(batches):
            hosts = b.column(1).to_pylist() if weights else [""] * b.num_rows
            for t, host in zip(b.column(0).to_pylist(), hosts, strict=True):
                t = plain(t)
                if not t.isascii():
                    c = _CLASS[codes(t)].astype(np.int64)
                    odd = c >= 128
                    at = np.flatnonzero(odd[:-1] | odd[1:])
                    w = weights.get(host, 1.0) if weights else 1.0
                    pairs[np.unique(c[at] * K + c[at + 1])] += w
                    pairs[-1] += w
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(pairs[at])], names=["cell", "n"])

    host = F.coalesce(F.regexp_extract(F.col(url), "^[a-zA-Z]+://([^/:?#]*)", 1), F.lit("")) if url else F.lit("")
    sums = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), host.alias("h")).mapInArrow(count, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    out = np.zeros(K * K + 1)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


def pair_scores(counts: np.ndarray) -> np.ndarray:
    """log2 of one plus each pair's part of the mutual information a row, in millionths of a bit; see :data:`SLACK` and :data:`LEAST`."""
    pairs, rows = counts[:-1].reshape(K, K), max(counts[-1], 1.0)
    n = max(pairs.sum(), 1.0)
    i, j = np.nonzero(pairs >= LEAST)
    pmi = np.log2(pairs[i, j] * n / (pairs.sum(axis=1)[i] * pairs.sum(axis=0)[j]))
    out = np.zeros((K, K), np.float16)
    out[i, j] = np.log2(1 + 1e6 * pairs[i, j] / rows * np.maximum(pmi + SLACK, 0))
    return out


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """Disjoint maximum-scoring segments of ``scores``, in linear time.

    A segment begins with a positive score and ends where its sum was greatest
    before it fell back to zero.
    """
    out: list[tuple[int, int]] = []
    start, end, total, best = -1, 0, 0.0, 0.0
    for i, s in enumerate(scores):
        if start < 0:
            if s <= 0:
                continue
            start, total, best = i, 0.0, 0.0
        total += s
        if total > best:
            best, end = total, i + 1
        elif total <= 0:
            out.append((start, end))
            start = -1
    if start >= 0:
        out.append((start, end))
    return out


def improbable_runs(text: str, scores: np.ndarray, below: float = IMPROBABLE) -> list[tuple[int, int]]:
    """Ranges of ``text`` that are improbable runs; plain ASCII text has none."""
    if text.isascii():
        return []
    u = codes(text)
    c = _CLASS[u].astype(np.int64)
    odd = c >= 128
    at = np.flatnonzero(odd[:-1] | odd[1:])
    lost = (u == 0xFFFD) | ((u >= 0x80) & (u < 0xA0))  # no characters of any text
    hits = at[(scores[c[at], c[at + 1]] < below) | lost[at] | lost[at + 1]]
    if not len(hits):
        return [(0, 1)] if len(u) == 1 and lost[0] else []
    rare = np.zeros(len(c), bool)
    rare[hits] = True
    # a run ends where probable pairs outweigh what it scored, so gaps longer than its hits split the work
    out = []
    cuts = np.flatnonzero(np.diff(hits) > 24)
    for a, b in zip(np.append(0, cuts + 1), np.append(cuts, len(hits) - 1), strict=True):
        todo = [(int(hits[a]), int(hits[b]) + 1)]
        while todo:
            lo, hi = todo.pop()
            found = [(lo + x, lo + y) for x, y in segments(np.where(rare[lo:hi], 1.0, -0.6).tolist())]
            out += [(x, y + 1) for x, y in found]
            # what follows a segment before its sum is used up has segments of its own
            ends = [x for x, _ in found[1:]] + [hi]
            todo += [(y, z) for (_, y), z in zip(found, ends, strict=True) if rare[y:z].any()]
    return sorted(out)


@lru_cache(maxsize=1)
def _tables() -> list[tuple[dict[int, int], re.Pattern]]:
    """For each encoding: character to byte, and what UTF-8's sequences look like when read with it."""
    out = []
    for enc in READ_AS:
        to_byte = {}
        for b in range(0x80, 0x100):
            try:
                to_byte[ord(bytes([b]).decode(enc))] = b
            except UnicodeDecodeError:
                to_byte[b] = b  # unused places are read as control characters
        by = {b: chr(c) for c, b in to_byte.items()}

        def chars(lo: int, hi: int, by: dict[int, str] = by) -> str:
            return "[" + "".join(re.escape(by[b]) for b in range(lo, hi + 1) if b in by) + "]"

        more = chars(0x80, 0xBF)
        one = f"(?:{chars(0xC2, 0xDF)}{more}|{chars(0xE0, 0xEF)}{more}{{2}}|{chars(0xF0, 0xF4)}{more}{{3}})"
        out.append((to_byte, re.compile(f"{one}+")))
    return out


def _latin(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _cyrillic(c: str) -> bool:
    return "Ѐ" <= c <= "ӿ"


def _fits(got: str, before: str, after: str, garbled: str) -> bool:
    """Whether ``got`` may stand between ``before`` and ``after`` in place of ``garbled``."""
    if not all(ord(c) in _FIT for c in got):
        return False
    if _cyrillic(got[0]) or _cyrillic(got[-1]):
        alone = sum(map(_cyrillic, got)) == 1
        return not alone or not any(map(_cyrillic, garbled)) and (_cyrillic(before) or _cyrillic(after) or any("\x80" <= c <= "\x9f" for c in garbled))
    if any(map(_cyrillic, garbled)):
        # Latin letters and signs read as Cyrillic stand apart from Cyrillic words
        foreign = any(not ("А" <= c <= "я" or c in "Ёё") for c in garbled)
        return (foreign and not _cyrillic(before) and not _cyrillic(after)) or (_latin(before) and not _cyrillic(after))
    first = got[0]
    if first.islower() and before.isupper() and not after.islower() and not any("\x80" <= c <= "\x9f" for c in garbled):
        return False  # a capital with a closing mark
    return True


def _once(text: str, lo: int, hi: int, floor: int) -> tuple[str, int, int] | None:
    """The range with its best inverse mapping undone, or None; also where it really lies, not before ``floor``."""
    lo, hi = max(floor, lo - 2), min(len(text), hi + 2)
    part = text[lo:hi]
    best: tuple[int, str] | None = None
    for to_byte, pattern in _tables():
        undone, changed, at = [], 0, 0
        for m in pattern.finditer(part):
            g = m.group()
            try:
                got = bytes(to_byte[ord(c)] for c in g).decode("utf-8")
            except (UnicodeDecodeError, KeyError):
                continue
            before = part[m.start() - 1] if m.start() else text[lo - 1] if lo else " "
            after = part[m.end()] if m.end() < len(part) else text[hi] if hi < len(text) else " "
            if not _fits(got, before, after, g):
                continue
            undone += [part[at : m.start()], got]
            at = m.end()
            changed += len(g)
        if changed and (best is None or changed > best[0]):
            best = (changed, "".join([*undone, part[at:]]))
    return (best[1], lo, hi) if best else None


def _mean(text: str, scores: np.ndarray) -> tuple[float, int]:
    """Mean score of the pairs with a letter beyond ASCII, and their number."""
    c = _CLASS[codes(text)].astype(np.int64)
    if len(c) < 2:
        return 0.0, 0
    at = np.flatnonzero((c[:-1] >= 128) & (c[1:] >= 128))
    return (float(scores[c[at], c[at + 1]].mean()), len(at)) if len(at) else (0.0, 0)


def _single(part: str, scores: np.ndarray) -> str | None:
    """``part`` as Cyrillic text of another single-byte encoding, where that fits far better."""
    letters = sum(1 for c in part if ord(c) > 0xBF and c.isalpha())
    if letters < LETTERS:
        return None
    now, pairs = _mean(part, scores)  # no ceiling: a source that is garbled throughout raises it itself
    if not pairs:
        return None
    best = None
    for read, true in SINGLE:
        try:
            got = part.encode(read).decode(true)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if sum(1 for c in got if _cyrillic(c)) < 0.9 * letters:
            continue
        s, n = _mean(got, scores)
        if n and s > now + GAIN and (best is None or s > best[0]):
            best = (s, got)
    return best[1] if best else None


# what is left of general punctuation without its last byte, read as cp1252, latin-1, cp1251, cp437, cp850 (fixed values)
_LOST = re.compile("\ufffd+|\u00e2\u20ac|\u00e2\x80|\u0432\u0402|\u0393\u00c7|\u00d4\u00c7")
_WORDS = re.compile(r"[^\x00-\x7f]+(?:[ .,:;!?()-]+[^\x00-\x7f]+)*")


#: Single-byte encodings of Latin text (read as, truly), in order of trial.
LATIN = (("cp1252", "mac-roman"), ("cp1252", "cp850"), ("latin-1", "cp850"), ("cp850", "cp1252"), ("mac-roman", "cp1252"), ("cp437", "cp1252"))
# one sign or capital beyond ASCII where a small letter must stand: inside a word, or a capital at the end of one
_LONE = re.compile(r"[\x80-\x9f¡-¬®-¶¸-¿×÷‚„ƒ†‡ˆ‰‹›•˜™Œ€√∫≈◊∂Ω∏π∞À-ÖØ-ÞŠŽŸ│┤╡╢╖╕╣║╗╝┐└┴┬├─┼╚╔╩╦╠═╬┘┌█▄▌▐▀](?:(?<=[a-zß-öø-ÿ].)(?=[a-zß-öø-ÿ])|(?<=[a-z]{2}[À-ÖØ-ÞŠŽŸŒ])(?!\w))")
# the rest of UTF-8 read as a single-byte encoding, with its last byte replaced; other scripts inside a Latin word
_HALF = re.compile(r"[ÃÂ](?=[? \xa0])(?:(?<=[a-zß-öø-ÿ].)|(?<=Ã)(?<!\S.))")
_ALIEN = re.compile(r"[\u0370-\u03ff\u0590-\u06ff\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uff61-\uff9f](?<=[a-z]{2}.)[\u0370-\u03ff\u0590-\u06ff\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uff61-\uff9f]{0,3}(?=[a-z]|[^\w]|$)")
_SCRIPTS = re.compile(r"[\u0370-\u03ff\u0590-\u06ff\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uff61-\uff9f]")


def _inside(pattern: re.Pattern, text: str, runs: list[tuple[int, int]]) -> list[re.Match]:
    """Matches of ``pattern`` that touch a run."""
    out: list[re.Match] = []
    for lo, hi in runs:
        for m in pattern.finditer(text, max(0, lo - 2, out[-1].end() if out else 0), min(len(text), hi + 8)):
            if m.start() < hi and m.end() > lo:
                out.append(m)
    return out


def _lone(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """``text`` with lone wrong characters in runs restored, and the numbers of those restored and lost.

    All of a text are restored by the one pair of encodings that fits most of them.
    """
    at = _inside(_LONE, text, runs)
    best: dict[str, str] = {}
    for read, true in LATIN if at else ():
        to = {}
        for c in {m.group() for m in at}:
            try:
                got = c.encode(read).decode(true)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if "ß" <= got <= "ÿ" and got != "÷":
                to[c] = got
        if len(to) > len(best):
            best = to
    fixed = [m for m in at if m.group() in best]
    if fixed:
        whole = list(text)  # one character for one
        for m in fixed:
            whole[m.start()] = best[m.group()]
        text = "".join(whole)
    return text, len(fixed), len(at) - len(fixed)


def _unmapped(text: str, runs: list[tuple[int, int]]) -> int:
    """Sequences of wrong decoding in runs that no mapping restores."""
    n = len(_inside(_LOST, text, runs)) + len(_inside(_HALF, text, runs))
    alien = _inside(_ALIEN, text, runs)
    if alien and 4 * len(_SCRIPTS.findall(text)) < len(text):  # not a text in such a script
        n += len(alien)
    return n


def repair(content: str, scores: np.ndarray, below: float = IMPROBABLE) -> tuple[str, int, int]:
    """``content`` restored, with the numbers of runs restored and of those lost.

    Character references are resolved where that is needed to restore. Text may
    have been garbled more than once: mappings are undone until none is left, each
    of which makes the text's non-ASCII part shorter or its pairs more probable.
    U+FFFD, characters whose last byte is missing, and letters of other scripts
    inside Latin words are lost: what stood there is unknown.
    """
    text, fixed = plain(content), 0
    if text.isascii():
        return content, 0, 0
    while runs := improbable_runs(text, scores, below):
        out, at, changed = [], 0, 0
        for lo, hi in runs:
            if hi <= at:
                continue
            got = _once(text, max(lo, at), hi, at)
            if got is None:
                # single-byte mappings need whole words
                a, b = max(lo, at), hi
                while a > at and not text[a - 1].isascii():
                    a -= 1
                while b < len(text) and not text[b].isascii():
                    b += 1
                for m in _WORDS.finditer(text[a:b]):
                    whole = _single(m.group(), scores)
                    if whole is not None:
                        out += [text[at : a + m.start()], whole]
                        at = a + m.end()
                        changed += 1
                continue
            part, lo, hi = got
            out += [text[at:lo], part]
            at = hi
            changed += 1
        if not changed:
            break
        fixed += changed
        text = "".join([*out, text[at:]])
    text, lone, lost = _lone(text, runs)
    fixed += lone
    lost += _unmapped(text, runs)
    return (text if fixed else content), fixed, lost


def garbled(rows: DataFrame, key: str = "fetch_id", content: str = "content", below: float = IMPROBABLE, url: str = "url") -> DataFrame:
    """``(fetch_id, restored, runs, lost)`` of the rows with garbled text.

    ``restored`` is the text with ``runs`` runs undone; ``lost`` counts what no mapping
    restores, which stays. Rows with a null key or null content are left out, empty
    texts are never garbled, rows with one key come out once. The pair statistics
    are those of all rows as delivered; a host, where there is a column ``url``,
    weighs no more than :data:`SOURCE`.
    """
    source = url if url in rows.columns else None
    use = rows.select(F.col(key).alias("fetch_id"), F.col(content).alias("content")).where("fetch_id is not null and content is not null")
    shared = rows.sparkSession.sparkContext.broadcast(pair_scores(pair_counts(rows.where(F.col(key).isNotNull()), content, source)))  # K x K half floats

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value
        for b in slices(batches):
            out = []
            for i, t in enumerate(b.column(1).to_pylist()):
                got, runs, lost = repair(t, scores, below)
                if runs or lost:
                    out.append((i, got, runs, lost))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int32())],
                names=["fetch_id", "restored", "runs", "lost"],
            )

    found = use.mapInArrow(find, "fetch_id bigint, restored string, runs int, lost int")
    return materialise(found).dropDuplicates(["fetch_id"])
