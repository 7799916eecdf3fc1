from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from silkmoth.llm import parsimonious, trie_counts
from silkmoth.llm.terms import strip_tags, terms_of
from silkmoth.llm.trie_counts import BurstTrie, choose_routes, merge_subtrees, route_of


def test_terms():
    assert terms_of("<b>Ab</b>c &amp; é9 < x> y") == ["ab", "c", "amp", "9", "y"]
    assert strip_tags("a < b") == "a < b"
    assert terms_of("") == []
    assert len(terms_of("<" * 300_000 + "a")) == 1


def test_trie_against_counter():
    random.seed(0)
    words = ["".join(random.choices("ab", k=random.randrange(0, 9))) for _ in range(5000)]
    trie = BurstTrie(burst=4)
    for w in words:
        trie.add(w, 1, 2)
    got = {p + s: c[0] for p, sub in trie.subtrees() for s, c in sub.items()}
    assert got == Counter(words) and trie.size == len(got)


def test_routes_split_by_size():
    routes = choose_routes({"a": 5, "ab": 300, "abc": 900, "b": 3}, group=100, depth=3)
    assert routes["abc"] == 9 and routes["b"] == 1
    assert route_of("b9", routes) == "b" and route_of("abcd", routes).startswith("abc#") and route_of("zz", routes) == ""
    assert choose_routes({}) == {"": 1}


def _docs(spark, rows):
    return spark.createDataFrame(rows, "fetch_id long, url string, last_modified timestamp, content string, term string, records int")


def test_counts(spark):
    rows = [(i, "u", None, f"<a>The cat{i % 3}", "clash", 0) for i in range(10)] + [(0, "u", None, "<a>The cat0", "clash", 0), (None, "u", None, "the", "", 0), (11, None, None, None, "", 0), (12, None, None, "", "", 0)]
    got = {r.term: (r.occurrences, r.records, r.mark) for r in trie_counts.term_counts(_docs(spark, rows), "fetch_id", "content").collect()}
    assert got == {"the": (10, 10, "common"), "cat0": (4, 4, None), "cat1": (3, 3, None), "cat2": (3, 3, None)}
    assert trie_counts.term_counts(_docs(spark, []), "fetch_id", "content").collect() == []


def test_counts_with_small_tries(spark):
    random.seed(1)
    texts = [" ".join("".join(random.choices("abc", k=random.randrange(1, 7))) for _ in range(60)) for _ in range(80)]
    rows = _docs(spark, [(i, "u", None, t, "", 0) for i, t in enumerate(texts)])
    subtrees = trie_counts.count_subtrees(rows, "fetch_id", "content", burst=5, flush=100).cache()
    occ, held = Counter(), Counter()
    for t in texts:
        occ.update(t.split())
        held.update(set(t.split()))
    got = {r.term: (r.occurrences, r.records) for r in merge_subtrees(subtrees, group=50, depth=2).collect()}
    assert got == {t: (occ[t], held[t]) for t in occ}


def test_em_moves_mass_to_rare_terms():
    counts = np.array([5, 5, 3, 3])
    p = parsimonious.fit(np.array([0, 2]), counts, np.array([0.2, 1e-6, 0.5, 0.5]))
    assert p[1] > 0.59 > 0.41 > p[0] and math.isclose(p[2], 0.5) and math.isclose(p.sum(), 2)
    assert len(parsimonious.fit(np.array([0]), np.array([], int), np.array([]))) == 0


def _exact(rows):
    cur = {}
    for f, u, at, c, *_ in rows:
        if u is None or f is None or c is None:
            continue
        k = (at is not None, at, f)
        if u not in cur or k > cur[u][0]:
            cur[u] = (k, Counter(terms_of(c)))
    n, df = len(cur), Counter(t for _, c in cur.values() for t in c)
    out = set()
    for u, (_, c) in cur.items():
        w = [(-(0.4 + 0.6 * (k / sum(c.values()))) * math.log(n / df[t]), t) for t, k in c.items() if 2 <= df[t] <= n / 2]
        out |= {(u, t) for _, t in sorted(w)[:3]}
    return out


@pytest.mark.parametrize("floor", [0.0, 1e-4, 0.5])
def test_distinctive_is_the_exact_order(spark, floor):
    import datetime as dt

    random.seed(2)
    rows = []
    for i in range(60):
        text = " ".join(random.choice(["the"] * 8 + [f"t{k}" for k in range(30)]) for _ in range(random.randrange(0, 25)))
        rows.append((i, f"u{i % 45}", None if i % 5 == 0 else dt.datetime(2024, 1, 1 + i % 3), text, "x", 0))
    rows += [(70, "u1", None, None, "", 0), (71, None, None, "t1", "", 0), (None, "u2", None, "t1", "", 0), rows[3]]
    got = parsimonious.distinctive(*parsimonious.fitted(_docs(spark, rows)), floor=floor)
    assert {(r.url, r.term) for r in got.collect()} == _exact(rows)
    probs = parsimonious.record_models(_docs(spark, rows)).groupBy("url").sum("prob").collect()
    assert all(abs(r[1] - 1) < 1e-9 for r in probs)


def test_distinctive_empty(spark):
    assert parsimonious.distinctive(*parsimonious.fitted(_docs(spark, []))).collect() == []


def test_redelivered_rows_count_once_either_way(spark, monkeypatch):
    rows = [(i % 7, "u", None, f"the cat{i % 7}", "", 0) for i in range(40)] + [(100 + i, "u", None, "the dog", "", 0) for i in range(5)]
    want = {"the": (12, 12), "dog": (5, 5)} | {f"cat{i}": (1, 1) for i in range(7)}
    for most in (1_000_000, 0):
        monkeypatch.setattr(trie_counts, "MAX_AGAIN", most)
        got = trie_counts.term_counts(_docs(spark, rows).repartition(5), "fetch_id", "content").collect()
        assert {r.term: (r.occurrences, r.records) for r in got} == want and {r.mark for r in got if r.term == "the"} == {"common"}
