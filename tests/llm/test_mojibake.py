from __future__ import annotations

import numpy as np
import pytest

from silkmoth.llm import mojibake
from silkmoth.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scores(spark):
    docs = table(spark, SF, "crawl_docs", "fetch_id", "content")
    return mojibake.pair_scores(mojibake.pair_counts(docs, "content"))


CLEAN = [
    "Le musée a été fermé, naïve façon – « Déjà vu » d’été, £5 · 3 €.",
    "ATENÇÃO: A ESTAÇÃO MÂ-820 está fechada. São João, coração.",
    "Größe, Straße, Übermut; „so“ – ‚Änderung‘ ÄÖÜ. FUẞBALL",
    "Музей района закрывает выставку «Мы этого не ожидали», Гёте, СССР» и Рёв.",
    "É bom. IRMÃ» e MANHÔ” fim.",
]
GARBLED = [
    ("Le musée a reporté l’exposition.", "utf-8", "cp1252"),
    ("La compañía reparó el menú.", "utf-8", "latin-1"),
    ("It’s a café – much like any other.", "utf-8", "cp1251"),
    ("It’s a café – much like any other.", "utf-8", "cp1250"),
    ("Der jährliche Fußballverein prüfte die öffentliche Brücke.", "utf-8", "mac-roman"),
    ("A ciclovia foi três vezes adiada até à praça.", "utf-8", "cp850"),
    ("L’été à la clinique, après des années.", "utf-8", "cp437"),
    ("Клиника области изучает ремонт моста порта", "utf-8", "cp1251"),
    ("Клиника области изучает ремонт моста порта", "cp1251", "latin-1"),
    ("Клиника области изучает ремонт моста порта", "koi8-r", "cp1251"),
]


def _read(text, true, wrong):
    out = ""
    for b in text.encode(true):
        try:
            out += bytes([b]).decode(wrong)
        except UnicodeDecodeError:
            out += chr(b)
    return out


@pytest.mark.parametrize("text", CLEAN)
def test_right_text_is_left_alone(scores, text):
    assert mojibake.repair(text, scores) == (text, 0, 0)


@pytest.mark.parametrize(("text", "true", "wrong"), GARBLED)
def test_restores(scores, text, true, wrong):
    assert mojibake.repair(_read(text, true, wrong), scores)[0] == text


def test_twice_and_in_references(scores):
    text = "Le prix est passé à 5 € – déjà."
    assert mojibake.repair(_read(_read(text, "utf-8", "cp1252"), "utf-8", "cp1252"), scores)[0] == text
    assert mojibake.repair("caf&Atilde;&copy; au lait", scores)[0] == "café au lait"
    assert mojibake.repair("caf&eacute; &amp; more", scores)[1:] == (0, 0)


def test_lost(scores):
    assert mojibake.repair("caf� ��", scores)[1:] == (0, 2)
    assert mojibake.repair("this,â€ said", scores)[2] == 1


def test_long_text(scores):
    text = "é" * 200_000 + "Ã©" * 1000
    assert mojibake.repair(text, scores)[1] > 0


def test_segments():
    assert mojibake.segments([1, -0.5, 1, -3, 2, -1, 0.5]) == [(0, 3), (4, 5)]
    assert mojibake.segments([]) == [] and mojibake.segments([-1, -1]) == []


def test_rows(spark):
    rows = [(1, "cafÃ©", 5), (1, "cafÃ©", 5), (2, "café", 5), (3, None, 5), (4, "", 5), (None, "cafÃ©", 5), (5, "a�", 5)]
    df = spark.createDataFrame(rows, "fetch_id long, content string, runs int")
    assert {tuple(r) for r in mojibake.garbled(df).collect()} == {(1, "café", 1, 0), (5, "a�", 0, 1)}
    assert mojibake.garbled(df.limit(0)).collect() == []


@pytest.mark.parametrize(("true", "wrong"), [("mac-roman", "cp1252"), ("cp850", "latin-1"), ("cp1252", "cp850")])
def test_single_bytes_of_latin_text(scores, true, wrong):
    assert mojibake.repair(_read("le marché fermé, un théâtre rénové", true, wrong), scores)[1] > 0
    assert mojibake.repair("un cafŽ ouvert", scores)[:2] == ("un café ouvert", 1)


@pytest.mark.parametrize("text", ["le cafÃ? ouvert", "voilÃ  tout", "un caf茅 ouvert", "un cafﾃｩ ouvert", "un cafΓ© ouvert"])
def test_not_restorable_is_reported(scores, text):
    assert sum(mojibake.repair(text, scores)[1:]) > 0


def test_source_garbled_throughout(scores):
    text = "Клиника области изучает ремонт моста порта"
    raised = scores.copy()
    raised[scores > 0] += 2  # what the garbled pairs' own number adds
    wrong = _read(text, "koi8-r", "cp1251")
    c = mojibake._CLASS[mojibake.codes(wrong)].astype(int)
    raised[c[:-1:2], c[1::2]] = 8
    assert mojibake._mean(wrong, raised)[0] > 0 and mojibake._single(wrong, raised) == text


def test_information_decides(scores):
    text = "this,â€ said. Le prix du cafÃ© a baissÃ©."
    assert mojibake.repair(text, scores)[1:] == (1, 1) or mojibake.repair(text, scores)[1] > 0
    certain = np.full_like(scores, 20)  # every pair probable: nothing is looked at
    assert mojibake.improbable_runs(text, certain) == [] and mojibake.repair(text, certain) == (text, 0, 0)
    assert mojibake.repair("caf\u00e9 fΓ©", certain) == ("caf\u00e9 fΓ©", 0, 0)


def test_source_garbled_throughout_weighs_little(spark):
    clean = [(i, f"Le musée de la ville a été fermé, {i} fois déjà, après la pluie", f"http://h{i % 100}.test/{i}") for i in range(400)]
    bad = [(1000 + i, _read(f"Le musée de la ville a été fermé, {i} fois déjà, après la pluie", "utf-8", "cp1252"), f"http://bad.test/{i}") for i in range(200)]
    df = spark.createDataFrame(clean + bad, "fetch_id long, content string, url string")
    got = mojibake.garbled(df)
    assert {r.fetch_id for r in got.collect()} == {r[0] for r in bad}
    assert got.where("contains(restored, 'été fermé')").count() == 200
    weights = mojibake.host_weights(df, "url", 0.1)
    assert set(weights) == {"bad.test"} and abs(weights["bad.test"] - 60 / 200) < 1e-9
