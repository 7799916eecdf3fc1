from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from silkmoth.llm import leakage
from silkmoth.llm.fm_index import FMIndex, suffix_array


@given(st.lists(st.integers(2, 5), max_size=80), st.lists(st.integers(2, 5), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_index_against_scan(text, pattern):
    index = FMIndex(np.array(text, np.int64), 6)
    lo, hi = index.search(np.array([pattern], np.int64))
    want = [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]
    assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_suffix_array():
    s = [3, 1, 2, 1, 2, 1, 0]
    assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_words():
    assert leakage.words_of("L’été, ÉTÉ! > naïve-ß") == ["l", "ete", "ete", "naive", "ss"]


PASSAGE = [f"w{i}" for i in range(40)]
QUESTION = [f"q{i}" for i in range(16)]


def _items(spark):
    rows = [(1, " ".join(PASSAGE), "never " * 30), (2, None, " ".join(QUESTION)), (3, "too short", None), (4, None, None), (None, " ".join(PASSAGE), None), (1, " ".join(PASSAGE), "never " * 30)]
    return spark.createDataFrame(rows, "item_id long, passage string, question string")


def _filler(seed, n=60):
    return [f"f{random.Random(seed).randrange(50)}{i % 7}" for i in range(n)]


def test_leaks(spark):
    few = list(PASSAGE[5:29])
    few[7], few[15] = "other", "WORDS"
    added = PASSAGE[3:20] + ["new"] + PASSAGE[20:29]
    many = [w if i % 4 else "other" for i, w in enumerate(PASSAGE)]
    docs = {
        10: _filler(1) + PASSAGE + _filler(2),
        11: [w.upper() + "," for w in PASSAGE[8:28]],
        12: _filler(3) + few,
        13: added + _filler(4),
        14: _filler(5) + PASSAGE[8:27],  # nineteen words
        15: many,
        16: _filler(6) + QUESTION,
        17: QUESTION[:12],
        18: [w if i != 6 else "x" for i, w in enumerate(QUESTION)],
        19: PASSAGE + QUESTION,
    }
    rows = [(k, " ".join(w), "", 0) for k, w in docs.items()] + [(20, None, "", 0), (None, " ".join(PASSAGE), "", 0), (21, "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string, start int")
    items = leakage.load_items(_items(spark))
    found = leakage.leaks(df, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(10, 1), (11, 1), (12, 1), (13, 1), (16, 2), (18, 2), (19, 1), (19, 2)}
    spans = {r.doc_id: (r.start, r.end) for r in found.where("doc_id in (10, 12)").collect()}
    assert spans == {10: (60, 100), 12: (60, 84)}
    small = leakage.leaks(df, items, shard=50)
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in found.collect()}
    assert leakage.leaks(df.limit(0), items).collect() == []
    assert leakage.leaks(df, leakage.load_items(_items(spark).limit(0))).collect() == []


def test_item_copied_into_a_third_of_all_documents(spark):
    rows = [(i, " ".join(_filler(i, 30) + (PASSAGE if i % 3 == 0 else []))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = leakage.leaks(df, leakage.load_items(_items(spark)))
    assert {r.doc_id for r in got.collect()} == set(range(0, 300, 3))


def test_stretch_of_common_phrases_is_no_leak(spark):
    rows = [(i, " ".join(PASSAGE[k % 40] for k in range(i, i + 14))) for i in range(200)] + [(999, " ".join(PASSAGE))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in leakage.leaks(df, leakage.load_items(_items(spark))).collect()} == set()


def test_removal_spans(spark):
    found = spark.createDataFrame([(1, 7, 0, 10), (1, 8, 5, 20), (1, 9, 30, 40), (2, 7, 3, 4)], "doc_id long, item_id long, start long, end long")
    got = {(r.doc_id, r.start, r.end, tuple(r["items"])) for r in leakage.removal_spans(found).collect()}
    assert got == {(1, 0, 20, (7, 8)), (1, 30, 40, (9,)), (2, 3, 4, (7,))}


def test_edit_near_the_beginning_of_the_shortest_stretch(spark):
    passage = [*PASSAGE, *(f"v{i}" for i in range(40))]
    early = PASSAGE[8:28]
    early[2] = "other"
    long = [w if i not in (10, 14, 18, 22) else "other" for i, w in enumerate(PASSAGE[:32])]
    docs = {1: _filler(1) + early + _filler(2), 2: _filler(3) + long + _filler(4), 3: _filler(5) + early[:19] + _filler(6)}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    items = leakage.load_items(spark.createDataFrame([(1, " ".join(passage), None)], "item_id long, passage string, question string"))
    assert {(r.doc_id, r.start, r.end) for r in leakage.leaks(df, items).collect()} == {(1, 60, 80), (2, 60, 92)}


def test_items_that_share_a_passage_and_copies_of_a_shorter_overlap(spark):
    text = " ".join(PASSAGE)
    items = leakage.load_items(spark.createDataFrame([(1, text, "a"), (2, text, "b"), (3, None, " ".join(QUESTION)), (4, None, " ".join(QUESTION))], "item_id long, passage string, question string"))
    docs = {1: _filler(1) + PASSAGE, 2: QUESTION + _filler(2)} | {100 + i: _filler(3) + PASSAGE[:15] + _filler(4) for i in range(200)} | {3: PASSAGE[:26]}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    found = leakage.leaks(df, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (1, 2), (3, 1), (3, 2), (2, 3), (2, 4)}
    assert {tuple(r) for r in leakage.leaks(df, items, shard=50).collect()} == {tuple(r) for r in found.collect()}


def test_items_over_one_vocabulary_in_any_shard(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(500)]
    passages = {i: [rng.choice(vocabulary) for _ in range(40)] for i in range(300)}
    rows = [(i, " ".join(w), None) for i, w in passages.items()] + [(1000 + i, " ".join(w), None) for i, w in passages.items()]
    items = leakage.load_items(spark.createDataFrame(rows, "item_id long, passage string, question string"))
    docs = spark.createDataFrame([(i, " ".join([rng.choice(vocabulary) for _ in range(30)] + w)) for i, w in passages.items()], "doc_id long, text string")
    want = {(i, i) for i in passages} | {(i, 1000 + i) for i in passages}
    for shard in (3_000, 300_000):
        assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items, shard=shard).collect()} == want


def test_short_questions(spark):
    rows = [(1, None, "Quid novi?"), (2, None, "Why"), (3, None, ""), (4, None, "Ubi est Roma")]
    items = leakage.load_items(spark.createDataFrame(rows, "item_id long, passage string, question string"))
    docs = {1: "so quid novi then", 2: "ubi est, Roma! ubi est roma", 3: "ubi est"} | {10 + i: f"why not {i}" for i in range(20)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.start, r.end) for r in leakage.leaks(df, items).collect()} == {(1, 1, 1, 3), (2, 4, 0, 3)}


def test_phrase_of_many_items_found_often(spark, monkeypatch):
    monkeypatch.setattr(leakage, "TOGETHER", 500)
    opening = "read the text below and then answer".split()
    items = leakage.load_items(spark.createDataFrame([(i, " ".join(opening + [f"i{i}w{k}" for k in range(20)]), None) for i in range(200)], "item_id long, passage string, question string"))
    rows = [(i, " ".join(opening + [f"i{i}w{k}" for k in range(20)])) for i in range(0, 200, 10)] + [(1000 + i, " ".join(opening)) for i in range(300)]
    got = leakage.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i in range(0, 200, 10)}
