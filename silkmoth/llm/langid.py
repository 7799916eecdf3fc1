"""Language of documents and of their segments: words first, then shorter n-grams.

A word seen in training counts by its log frequency in every language; a word
only seen without its accents counts by that form; any other word falls back to
its longest known character n-grams, then to shorter ones. Sentences are scored
as sums, and neighbouring sentences of one language form a segment.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silkmoth.llm.mixing import label_code

#: Most labelled rows the model is fitted on, the same number of each language (those of the lowest ids, if there are more).
MAX_SAMPLES = 20_000
#: Longest character n-gram.
NGRAM = 5
#: Smoothing of word and n-gram counts.
ADD = 0.1
#: Weight of a word scored by n-grams, against one scored as a word.
BACKOFF_WEIGHT = 0.3
#: A sentence leaves the document's language only with this many nats and known words.
MARGIN, KNOWN = 6.0, 3
#: Words a worker remembers beyond the model's own.
CACHE = 200_000

_WORD = re.compile(r"[^\W\d_]+")
# a sentence ends at its mark with the closing quotes after it, or at a blank line
_END = re.compile(r"[.!?…]+[\"”»’')\]]*(?=\s)|\n[ \t>|]*\n")
_MARKS = re.compile(r"^[>|#*\s]+", re.M)


def fold(word: str) -> str:
    """``word`` without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def grams(word: str, n: int) -> list[str]:
    """The n-grams of ``word`` with its borders marked."""
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """Log frequencies by language of words, accent-free words and n-grams."""

    def __init__(self, samples: list[tuple[str, str]], add: float = ADD, longest: int = NGRAM):
        self.langs = sorted({lang for lang, _ in samples})
        k = len(self.langs)
        counts: dict[str, np.ndarray] = {}
        folded: dict[str, np.ndarray] = {}
        parts: list[dict[str, np.ndarray]] = [{} for _ in range(longest + 1)]
        for lang, text in samples:
            at = self.langs.index(lang)
            for word, c in Counter(_WORD.findall(text.lower())).items():
                counts.setdefault(word, np.zeros(k))[at] += c
                folded.setdefault(fold(word), np.zeros(k))[at] += c
                for n in range(1, longest + 1):
                    for g in grams(word, n):
                        parts[n].setdefault(g, np.zeros(k))[at] += c

        def logs(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            whole = sum(table.values(), np.zeros(k)) + add * len(table)
            return {w: np.log((c + add) / whole) for w, c in table.items()}

        self.words, self.folded, self.grams = logs(counts), logs(folded), [logs(t) for t in parts]

    def score(self, word: str) -> tuple[np.ndarray, bool]:
        """Log score of a lower-cased word by language (centred), and whether it is known."""
        got = self.words.get(word)
        if got is None:
            got = self.folded.get(word)
        if got is not None:
            return got - got.mean(), True
        for n in range(len(self.grams) - 1, 0, -1):
            found = [self.grams[n][g] for g in grams(word, n) if g in self.grams[n]]
            # an n-gram length is used where it covers at least half of the word
            if found and 2 * len(found) >= len(word) + 3 - n:
                s = np.mean(found, axis=0)
                return BACKOFF_WEIGHT * (s - s.mean()), False
        return np.zeros(len(self.langs)), False


def sentences(text: str) -> list[tuple[int, int]]:
    """Ranges of the sentences of ``text``; a line break alone ends none."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append((at, m.end()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


class Labeller:
    """Segments of texts; keeps scores of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs)))
        self.known = np.zeros(1024, bool)

    def _id(self, word: str) -> int:
        got = self.ids.get(word)
        if got is None:
            got = self.ids[word] = len(self.ids)
            if got == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            self.table[got], self.known[got] = self.model.score(word)
        return got

    def segments(self, text: str) -> list[tuple[int, int, int, float]]:
        """``(start, end, language index, confidence)`` of the segments of ``text``."""
        if len(self.ids) > CACHE:
            self.reset()
        spans = sentences(text)
        scores = np.zeros((len(spans), len(self.model.langs)))
        known = np.zeros(len(spans), int)
        words = [[self._id(w) for w in _WORD.findall(text[a:b].lower())] for a, b in spans]
        for i, w in enumerate(words):
            if w:
                scores[i] = self.table[w].sum(axis=0)
                known[i] = self.known[w].sum()
        if not any(words):
            return []
        # sentences that speak for one language decide which is the document's
        whole = np.zeros(scores.shape[1])
        best = scores.argmax(axis=1)
        order = np.sort(scores, axis=1)
        sure = (known >= KNOWN) & (order[:, -1] - (order[:, -2] if order.shape[1] > 1 else 0) >= MARGIN)
        for i in np.flatnonzero(sure):
            whole[best[i]] += len(words[i])
        main = int(whole.argmax()) if sure.any() else int(scores.sum(axis=0).argmax())
        lang = np.where(sure, best, main)
        out: list[tuple[int, int, int, float]] = []
        i = 0
        while i < len(spans):
            j = i
            while j + 1 < len(spans) and lang[j + 1] == lang[i]:
                j += 1
            s = scores[i : j + 1].sum(axis=0)
            n = max(1, sum(len(w) for w in words[i : j + 1]))
            # mean score a word, at the weight of at most twenty words
            e = np.exp((s - s.max()) / n * min(n, 20))
            out.append((spans[i][0], spans[j][1], int(lang[i]), float(e[lang[i]] / e.sum())))
            i = j + 1
        return out


def train(samples: DataFrame, lang: str = "lang", text: str = "text", key: str = "sample_id", most: int = MAX_SAMPLES) -> Model:
    """A model of at most ``most`` labelled rows; rows without text or label are left out."""
    rows = samples.select(F.col(key).alias("k"), label_code(F.col(lang)).alias("lang"), F.col(text).alias("text")).where("text is not null and lang <> 'und'")
    langs = rows.select("lang").distinct().count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("k", "text"))
    got = rows.withColumn("at", place).where(F.col("at") <= max(1, most // max(langs, 1))).orderBy("at", "lang").limit(most).collect()
    if not got:
        raise ValueError("no labelled rows to fit a language model on")
    return Model([(r.lang, r.text) for r in got])


def segments(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per segment: ``(doc_id, label, seg, start, end, lang, confidence)``.

    ``start`` and ``end`` are character positions, ``seg`` counts from 1, ``label``
    is the code of the given label (``und`` if there is none). Rows with a null
    key or text, and texts without a letter, have no segments. Texts of any length
    are read whole, in linear time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size bounded by MAX_SAMPLES

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Labeller(shared.value)
        langs = shared.value.langs
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                got = work.segments(t)
                at += [i] * len(got)
                out += [(n, *g) for n, g in enumerate(got, 1)]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([langs[o[3]] for o in out], pa.string()), pa.array([o[4] for o in out], pa.float64())],
                names=["doc_id", "label", "seg", "start", "end", "lang", "confidence"],
            )

    rows = docs.select(F.col(key).alias("doc_id"), label_code(F.col(lang)).alias("label"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(label, "doc_id bigint, label string, seg int, start int, end int, lang string, confidence double")


def mislabelled(segs: DataFrame) -> DataFrame:
    """``(doc_id, lang)`` of documents with no, a wrong or more than one language."""
    per = segs.groupBy("doc_id", "label").agg(F.collect_set("lang").alias("langs"))  # at most one entry a language
    case = (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return per.where(case).select("doc_id", F.explode("langs").alias("lang")).distinct()
