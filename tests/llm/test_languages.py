from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from silkmoth.llm import langid
from silkmoth.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def samples(spark):
    return [(r.lang, r.text) for r in table(spark, SF, "lang_samples").orderBy("sample_id").collect()]


def test_held_out_accuracy(samples):
    rows = list(samples)
    random.Random(3).shuffle(rows)
    work = langid.Labeller(langid.Model(rows[70:]))
    right = sum({work.model.langs[s[2]] for s in work.segments(text)} == {lang} for lang, text in rows[:70])
    assert right >= 69


def test_backoff_to_ngrams(samples):
    model = langid.Model(samples)
    score, known = model.score("wettervorhersagedienst")
    assert not known and model.langs[score.argmax()] == "de"
    score, known = model.score("reparacion")  # without its accent
    assert known and model.langs[score.argmax()] == "es"
    assert not model.score("zzqx")[1]


def test_segments(spark, samples):
    en = "The museum approved the vaccination plan in early spring. The clinic opened the exhibition hall last week."
    fr = "Le musée a approuvé le plan de vaccination au début du printemps."
    rows = [(1, en, "en-US", 0), (2, en + " " + fr, "EN", 0), (3, fr, "de", 0), (4, fr, " ", 0), (5, None, "en", 0), (6, "", "en", 0), (7, "123 --", "en", 0), (None, en, "en", 0), (8, fr, "fr_FR", 0), (9, en.replace("plan", "“plan de vaccination”"), "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, seg int")
    model = langid.train(table(spark, SF, "lang_samples"))
    got = langid.segments(docs, model)
    assert {(r.doc_id, r.lang) for r in langid.mislabelled(got).collect()} == {(2, "en"), (2, "fr"), (3, "fr"), (4, "fr")}
    two = got.where("doc_id = 2").orderBy("seg").collect()
    assert [(r.seg, r.lang) for r in two] == [(1, "en"), (2, "fr")] and all(r.confidence > 0.9 for r in two) and two[0].end == two[1].start
    assert langid.segments(docs.limit(0), model).collect() == []


def test_sentences():
    text = "One (two). “Three?” Four\nfive!\n\nSix 3.5"
    assert [text[a:b].strip() for a, b in langid.sentences(text)] == ["One (two).", "“Three?”", "Four\nfive!", "Six 3.5"]
    assert langid.sentences("") == []
    assert len(langid.sentences("a. " * 100_000)) == 100_000


def test_training_needs_rows(spark):
    with pytest.raises(ValueError, match="no labelled rows"):
        langid.train(table(spark, SF, "lang_samples").where(F.lit(False)))


def test_every_language_is_in_a_bounded_sample(spark):
    rows = [(i, "en", "the cat") for i in range(50)] + [(100 + i, "fr", "le chat") for i in range(3)]
    model = langid.train(spark.createDataFrame(rows, "sample_id long, lang string, text string"), most=6)
    assert model.langs == ["en", "fr"]


def test_short_sentences(samples):
    rows = list(samples)
    random.Random(4).shuffle(rows)
    work = langid.Labeller(langid.Model(rows[70:]))
    right = every = 0
    for lang, text in rows[:70]:
        for a, b in langid.sentences(text):
            short = " ".join(text[a:b].split()[:4])
            if len(short.split()) == 4:
                every += 1
                right += {work.model.langs[s[2]] for s in work.segments(short)} == {lang}
    assert right >= 0.9 * every
