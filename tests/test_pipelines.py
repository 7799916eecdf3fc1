from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from silkmoth.functions import text
from silkmoth.operators import crawl, index, kv, linkgraph, pagerank, search
from silkmoth.sources import files, sinks


def _ranks(spark, lines):
    edges = linkgraph.edges(linkgraph.adjacency(spark.createDataFrame([(x,) for x in lines], "value string")))
    return edges, {r.url: round(r["rank"], 6) for r in pagerank.pagerank(edges).collect()}


def test_pagerank(spark):
    _, ranks = _ranks(spark, ["1|2", "2|1,3", "3|9"])
    assert ranks == {"1": 0.89231, "2": 1.21538, "3": 0.89231}
    edges, ranks = _ranks(spark, ["a|b,c,b", "b|c", "c|a|z", "d|", 'e|"p,q",a,'])
    assert {tuple(r) for r in edges.collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", ""), ("e", ""), ("e", '"p,q"'), ("e", "a")}
    assert ranks == {"a": 1.852077, "b": 0.980755, "c": 1.853203, "d": 0.156982, "e": 0.156982}
    _, ranks = _ranks(spark, ["a|x", "b|y"])
    assert ranks == {"a": 1.0, "b": 1.0}
    assert pagerank.pagerank(edges.limit(0)).collect() == []


def test_search(spark):
    postings = spark.createDataFrame([("spark", "d1", 0.5), ("spark", "d2", 0.25), ("graph", "d2", 0.25), ("graph", "d3", 1.0)], "term string, doc string, tf float")
    ranks = spark.createDataFrame([("d1", 2.0), ("d2", 0.5)], "doc string, rank double")
    rows = search.blend(search.tfidf(postings, search.query_terms(spark, "Spark graphs graph nothing"), 4), ranks).collect()
    assert {r.doc: (round(r.tfidf, 6), round(r.harmonic, 6)) for r in rows} == {"d2": (0.762462, 0.75848), "d3": (0.693147, 0.695281), "d1": (0.485203, 0.488906)}
    zero = search.blend(search.tfidf(postings, search.query_terms(spark, "spark"), 2), ranks).collect()
    assert {r.harmonic for r in zero} == {0.0}


@pytest.mark.parametrize(("asked", "want"), [(None, 1), (0, 1), (-3, 1), (2, 2), (3, 3), (4, 1)])
def test_pages(asked, want):
    assert search.page_number(asked, 20) == want


def test_page_rows(spark):
    df = spark.range(20).select(F.col("id").alias("doc"), F.lit(1.0).alias("harmonic"))
    assert [r.doc for r in search.page(df, 2).collect()] == list(range(10, 20))
    assert search.page(df, 3).collect() == [] and search.flags(3, 0) == (False, True) and search.flags(1, 10) == (True, False)


def test_index(spark):
    docs = spark.createDataFrame([(1, "The cats, cats run"), (2, "a cat the"), (3, None), (4, "the of and")], "doc_id long, text string")
    stop = text.default_stop_words(spark)
    rows = {(r.term, r.doc): r.tf for r in index.build(docs, "doc_id", "text", stop).collect()}
    assert set(rows) == {("cat", 1), ("run", 1), ("cat", 2)} and abs(rows["cat", 1] - 2 / 3) < 1e-6
    built = index.build(docs, "doc_id", "text", stop)
    lists = index.posting_lists(built, block=1)
    assert lists.where("term = 'cat'").count() == 2
    again = index.from_text(index.to_text(index.posting_lists(built)))
    assert {(r.term, int(r.doc)) for r in again.collect()} == set(rows)
    double = index.merge(built.withColumn("seq", F.lit(1)), built.withColumn("tf", F.lit(9.0).cast("float")).withColumn("seq", F.lit(2)))
    assert {r.tf for r in index.last_wins(double, "seq").collect()} == {9.0}
    assert index.build(docs.limit(0), "doc_id", "text", stop).collect() == []


def test_rank_files(spark, tmp_path):
    lines = spark.createDataFrame([("(http://a:80/,0.5)",), ("(http://a:80/x,y,0.5)",), ("(http://a:80/x,7,0.5)",)], "value string")
    assert [tuple(r) for r in files.rank_lines(lines).collect()] == [("http://a:80/", 0.5), ("http://a:80/x", 1.0), ("http://a:80/x", 7.0)]
    ranks = spark.createDataFrame([("u", 0.25)], "url string, rank double")
    sinks.write_text(sinks.rank_text(ranks), str(tmp_path / "ranks"))
    assert [tuple(r) for r in files.rank_lines(files.lines(spark, str(tmp_path / "ranks"))).collect()] == [("u", 0.25)]


def test_text_sources(spark, tmp_path):
    for name, body in (("output-a", "cat\tdoc1 0.5  doc2 1.0\n"), ("output-b", "dog doc3 1.0\n"), ("other", "x")):
        (tmp_path / name).write_text(body)
    whole = files.whole_files(spark, str(tmp_path))
    assert {r.doc for r in whole.collect()} == {"output-a", "output-b", "other"}
    assert files.joined_text(whole, "output-").first()[0] == "cat\tdoc1 0.5  doc2 1.0\n\r\ndog doc3 1.0\n"
    assert {r.term for r in files.index_lines(spark, str(tmp_path / "output-*")).collect()} == {"cat", "dog"}
    assert {(r.term, r.doc) for r in index.from_text(files.lines(spark, str(tmp_path / "output-*"))).collect()} == {("cat", "doc1"), ("cat", "doc2"), ("dog", "doc3")}
    assert files.binary_files(spark, str(tmp_path / "other")).first()["length"] == 1
    assert files.seed(spark, "http%3A%2F%2Fa%2F").first().url == "http://a/"
    (tmp_path / "map").write_text("a|b,c\nbad\nd|e\n")
    seen, links = files.recovered(spark, str(tmp_path / "other"), str(tmp_path / "map"))
    assert seen.first().url == "x" and {tuple(r) for r in links.collect()} == {("a", "b,c"), ("d", "e")}


def test_crawl(spark):
    front = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "seq long, url string")
    seen = spark.createDataFrame([("b",)], "url string")
    found = spark.createDataFrame([(9, "b"), (10, "d")], "seq long, url string")
    take, later, now = crawl.frontier_step(front, seen, found, 1)
    assert [tuple(r) for r in take.collect()] == [(1, "a")]
    assert {tuple(r) for r in later.collect()} == {(4, "c"), (10, "d")}
    assert {r.url for r in now.collect()} == {"a", "b"}
    assert crawl.within_budget(front, "seq", 2).count() == 2 and crawl.within_budget(front, "seq", -1).count() == 4


def test_politeness_against_fold(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, f"h{i % 2}", base + dt.timedelta(seconds=(i * 7) % 13)) for i in range(40)] + [(98, None, base), (99, "h0", None)]
    df = spark.createDataFrame(rows, "id long, host string, at timestamp")
    want, free = {}, {}
    for i, h, at in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[1], r[2], r[0])):
        want[i] = max(at, free.get(h, at))
        free[h] = want[i] + dt.timedelta(seconds=5)
    got = {r.id: r.start for r in crawl.schedule(df, "host", "at", "id", 5, chunk=7).collect()}
    assert got == want


def test_keyed_tables(spark, tmp_path):
    store = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    assert {tuple(r) for r in kv.put(store, spark.createDataFrame([("b", "z"), ("c", "w")], "k string, v string"), "k").collect()} == {("a", "x"), ("b", "z"), ("c", "w")}
    assert [r.k for r in kv.scan(store, "k").collect()] == ["a", "b"]
    assert kv.delete_own(store, "k", "a", "v", "y").count() == 2 and kv.delete_own(store, "k", "a", "v", "x").count() == 1
    kv.commit(store, str(tmp_path))
    kv.commit(kv.delete(store, store.where("k = 'a'"), "k"), str(tmp_path))
    assert [r.k for r in kv.current(spark, str(tmp_path)).collect()] == ["b"]
    row = spark.createDataFrame([(["p"],), (None,)], "c array<string>")
    got = row.select(kv.subscribe(F.col("c"), F.lit("q")), kv.subscribe(F.col("c"), F.lit("p")), kv.unsubscribe(F.col("c"), F.lit("p"))).collect()
    assert [tuple(map(list, r)) for r in got] == [(["p", "q"], ["p"], []), (["q"], ["p"], [])]


def test_edges_of_long_fields(spark):
    many = ",".join(f'"p{i},q"' for i in range(20_000))
    df = spark.createDataFrame([("s", many), ("t", 'a,"b,c'), ("u", 'x\x01y,\x02,"\x01,"'), ("v", None), (None, "a"), ("w", "")], "url string, dest string")
    got = linkgraph.edges(df)
    assert got.where("src = 's'").count() == 20_000
    assert {tuple(r) for r in got.where("src <> 's'").collect()} == {("t", "a,\"b"), ("t", "c"), ("u", "x\x01y"), ("u", "\x02"), ("u", '"\x01,"'), ("w", "")}


def test_search_of_many_terms(spark, monkeypatch):
    words = [f"w{i}" for i in range(1500)]
    postings = spark.createDataFrame([(w, f"d{i % 50}", 0.5) for i, w in enumerate(words)], "term string, doc string, tf float")
    terms = search.query_terms(spark, " ".join(words), stems=False)
    want = {r.doc: round(r.tfidf, 6) for r in search.tfidf(postings, terms, 100).collect()}
    assert len(want) == 50
    monkeypatch.setattr(search, "PUSHED", 5000)
    assert {r.doc: round(r.tfidf, 6) for r in search.tfidf(postings, terms, 100).collect()} == want
    assert search.tfidf(postings, search.query_terms(spark, "..."), 100).collect() == []


def test_stored_index_reads_the_groups_of_its_terms(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"t{k}x"), F.col("id") % 50) for k in range(20)]).alias("text"))
    stored = index.store(index.build(docs, "doc_id", "text", None, stems=False), str(tmp_path / "index"), files=4)
    assert stored.count() == 60_000
    hits = search.postings_of(stored, search.query_terms(spark, "t3x7", stems=False))
    assert hits.count() == 60 and "PushedFilters: [IsNotNull(term), EqualTo(term,t3x7)]" in hits._jdf.queryExecution().toString().replace("In(term, [t3x7])", "IsNotNull(term), EqualTo(term,t3x7)")


def test_shown_pages(spark):
    ranked = spark.range(20).select(F.col("id").alias("doc"), (100.0 - F.col("id")).alias("harmonic"))
    for asked, want in ((None, (10, 1, True, False)), (2, (10, 2, False, False)), (4, (10, 1, True, False))):
        rows = search.shown(ranked, asked).collect()
        assert (len(rows), rows[0].page, rows[0]["first"], rows[0]["last"]) == want
    assert search.shown(ranked, 3).collect() == []


def test_many_stop_words(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat and the hat"), (2, "the")], "doc_id long, text string")
    stop = text.default_stop_words(spark)
    want = {tuple(r) for r in index.build(docs, "doc_id", "text", stop, stems=False).collect()}
    monkeypatch.setattr(index, "MAX_STOP", 3)
    assert {tuple(r) for r in index.build(docs, "doc_id", "text", stop, stems=False).collect()} == want and len(want) == 2


def test_full_stop_list_from_files(spark, tmp_path):
    words = [f"stop{i}" for i in range(586)]
    (tmp_path / "stop.txt").write_text("\n".join(words[:300]) + "\n" + " ".join(w.upper() for w in words[300:]) + "\n")
    loaded = text.load_stop_words(spark, str(tmp_path / "stop.txt"))
    assert loaded.count() == 586
    docs = spark.createDataFrame([(1, " ".join([*words, "kept", "Kept"]))], "doc_id long, text string")
    assert [tuple(r) for r in index.build(docs, "doc_id", "text", loaded, stems=False).collect()] == [("kept", 1, 1.0)]


def test_versions(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        kv.current(spark, str(tmp_path))
    for n in range(3):
        kv.commit(spark.range(n + 1), f"file://{tmp_path}")
    assert kv.current(spark, str(tmp_path)).count() == 3


def test_range_parts_follow_the_input(spark, tmp_path):
    from silkmoth.operators import skew

    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert skew.parts_for(df) == int(spark.conf.get("spark.sql.shuffle.partitions")) < skew.parts_for(df.groupBy("id").count(), part=100)
