from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from silkmoth.llm import mixing


def test_share_out():
    assert mixing.share_out(10, [1, 1], [100, 100]) == [5, 5]
    assert mixing.share_out(10, [1, 1], [2, 100]) == [2, 8]
    assert mixing.share_out(10, [1, 1, 2], [1, 2, 3]) == [1, 2, 3]
    assert mixing.share_out(10, [0, 1], [5, 5]) == [0, 5]


def test_siblings_take_before_ancestors():
    root = mixing.build_tree([(("a", "en"), 10), (("a", "de"), 10), (("b", "en"), 1000)], {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, 200)
    mixing.set_budgets(root, 200)
    a, b = root.children["a"], root.children["b"]
    assert (a.budget, b.budget) == (40, 160) and a.wanted == 100 and [c.budget for c in a.children.values()] == [20, 20]


def test_shortage_stays_below_its_ancestor():
    leaves = [(("web", "en", "a"), 10), (("web", "de", "b"), 500), (("books", "en", "a"), 90), (("books", "en", "b"), 500)]
    root = mixing.build_tree(leaves, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 400, at=2)
    mixing.set_budgets(root, 400)
    web, books = root.children["web"], root.children["books"]
    # source a wants 20 and 180 of the domains and has 10 and 90; each domain's shortage is taken inside the domain
    assert (web.wanted, books.wanted) == (120, 280) and (web.budget, books.budget) == (120, 280)
    assert web.children["en"].budget == 10 and web.children["de"].budget == 110
    assert {k: c.budget for k, c in books.children["en"].children.items()} == {"a": 90, "b": 190}


DOCS = "doc_id long, text string, lang string, source string, size string, repeats string"


def _docs(spark):
    rows = [(i, "a b\tc\n d", "en-GB", " News ", "", "") for i in range(50)] + [(100 + i, "x y", None, "blog", "", "") for i in range(30)] + [(200, None, "fr", "news", "", ""), (201, "q " * 1000, "fr", None, "", ""), (202, "", "", "other", "", "")]
    return spark.createDataFrame(rows, DOCS)


def _targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mix(spark):
    sizes = mixing.sized(_docs(spark), mixing.word_size(F.col("text")))
    plan = mixing.plan_mix(sizes, _targets(spark, [("NEWS", 0.5, 2), ("blog", 0.02, 3), ("gone", 0.1, 4), (None, 0.1, 1), ("x", None, 1)]))
    assert plan.total == 50 * 4 + 30 * 2 + 1000
    report = {r.source: (r.size, r.short) for r in plan.report(spark).collect()}
    assert report == {"news": (200, True), "blog": (60, False), "gone": (0, True)}
    rows = mixing.select_mix(sizes, plan).collect()
    news = [r for r in rows if r.source == "news" and r.size]
    assert len(news) == 50 and {r.repeats for r in news} == {2}
    # what others cannot take goes to the blog, up to its cap
    assert sum(r.size * r.repeats for r in rows if r.source == "blog") == 180


def test_prefix_is_seeded_and_within_budget(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    sizes = mixing.sized(docs, mixing.word_size(F.col("text")))
    plan = mixing.plan_mix(sizes, _targets(spark, [("s", 0.35, 1)]))
    plan.root.children["s"].children[""].children["en"].budget = 700.0
    one, two = (sorted(r.doc_id for r in mixing.select_mix(sizes, plan, seed).collect()) for seed in (1, 1))
    assert one == two and len(one) == 350
    assert one != sorted(r.doc_id for r in mixing.select_mix(sizes, plan, 2).collect())


def test_tokens(spark):
    got = {r.doc_id: r.size for r in mixing.sized(_docs(spark), None).collect()}
    assert got[200] == 0 and got[202] == 0 and got[100] == 2
    long = "word " * 100_000
    assert "".join(mixing.pieces(long)) == long
    enc = mixing.encoding(mixing.TOKENIZER)
    assert sum(len(enc.encode_ordinary(p)) for p in mixing.pieces(long[:60_000])) == len(enc.encode_ordinary(long[:60_000]))


def test_empty_and_too_many(spark, monkeypatch):
    empty = mixing.sized(_docs(spark).limit(0), mixing.word_size(F.col("text")))
    plan = mixing.plan_mix(empty, _targets(spark, [("a", 0.5, 1)]))
    assert mixing.select_mix(empty, plan).collect() == [] and plan.report(spark).first().short is False
    monkeypatch.setattr(mixing, "MAX_LEAVES", 1)
    with pytest.raises(ValueError, match="leaves"):
        mixing.plan_mix(mixing.sized(_docs(spark), mixing.word_size(F.col("text"))), _targets(spark, [("a", 0.5, 1)]))


def test_no_document_is_used_more_often_than_its_cap(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, "", "en", "s"), (3, None, "en", "s")], "doc_id long, text string, lang string, source string")
    sizes = mixing.sized(docs, mixing.word_size(F.col("text")))
    rows = mixing.select_mix(sizes, mixing.plan_mix(sizes, _targets(spark, [("s", 5.0, 2)]))).collect()
    assert {(r.doc_id, r.repeats) for r in rows} == {(1, 2), (2, 2), (3, 2)}


def test_levels_are_a_parameter(spark):
    rows = [(i, "a b c d", "en" if i % 2 else "de", f"s{i % 3}", f"h{i % 5}.{'test' if i % 4 else 'example'}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, host string")
    sizes = mixing.sized(docs, mixing.word_size(F.col("text")), half=F.col("doc_id") % 2)
    targets = _targets(spark, [("s0", 0.5, 2), ("s1", 0.3, 2), ("s2", 0.2, 2)])
    for levels in (("source",), ("domain", "lang", "source"), ("lang", "source", "half")):
        plan = mixing.plan_mix(sizes, targets, levels)
        report = {r.source: (r.share, r.short) for r in plan.report(spark).collect()}
        assert all(abs(report[k][0] - w) < 1e-9 and not report[k][1] for k, w in (("s0", 0.5), ("s1", 0.3), ("s2", 0.2)))
        got = {}
        for r in mixing.select_mix(sizes, plan).collect():
            got[r.source] = got.get(r.source, 0) + r.size * r.repeats
        assert all(abs(got[k] - w * 960) <= 4 * len(plan.every()) for k, w in (("s0", 0.5), ("s1", 0.3), ("s2", 0.2)))


def test_short_comes_from_the_budgets(spark):
    sizes = mixing.sized(_docs(spark), mixing.word_size(F.col("text")))
    plan = mixing.plan_mix(sizes, _targets(spark, [("news", 0.5, 2), ("blog", 0.02, 3)]))
    for _, leaf in plan.every():
        leaf.budget = leaf.capacity = 1e9
    assert not any(r.short for r in plan.report(spark).collect())
