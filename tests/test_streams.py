from __future__ import annotations

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from silkmoth.functions.robots import robots
from silkmoth.sources import files, sinks
from silkmoth.streaming import topology


def test_word_count_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("big bad big\nwolf,big\n")
    words = files.word_stream(spark, str(tmp_path / "in"))
    plan = topology.Topology(words).shuffle("keep", lambda d: d.where("word <> ''"), 2).fields("count", topology.word_counts, 2, "word").plan()
    got = topology.run_to_table(plan, f"t-{uuid.uuid4().hex}")
    assert {tuple(r) for r in got.collect()} == {("big", 3), ("bad", 1), ("wolf", 1)}


def test_running_count(spark):
    rows = spark.createDataFrame(list(enumerate(["big", "bad", "big", "wolf", "big"])), "seq long, word string")
    got = topology.running_count(rows, "word", "seq").orderBy("seq").collect()
    assert [(r.word, r["count"]) for r in got] == [("big", "1"), ("bad", "1"), ("big", "2"), ("wolf", "1"), ("big", "3")]


def test_groupings(spark):
    rows = spark.range(8).withColumn("k", F.col("id") % 3)
    assert [r.instance for r in topology.round_robin(rows, "id", 3).orderBy("id").collect()] == [0, 1, 2, 0, 1, 2, 0, 1]
    assert topology.by_fields(rows, 4, "k").groupBy("k").agg(F.countDistinct("instance").alias("n")).where("n <> 1").count() == 0
    with pytest.raises(ValueError, match="no field"):
        topology.Topology(rows).fields("x", lambda d: d, 2, "missing").plan()
    with pytest.raises(ValueError, match="needs a field"):
        topology.Topology(rows).fields("x", lambda d: d, 2)


def test_topology_to_files_and_print(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.json").write_text('{"seq": 1, "url": "a"}\n{"seq": 2, "url": "a"}\n')
    urls = files.frontier_stream(spark, str(tmp_path / "in"))
    q = topology.Topology(urls).shuffle("once", lambda d: topology.seen_once(d, "url"), 2).run(str(tmp_path))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [r.url for r in out.collect()] == ["a"]
    assert sinks.printed(out.select("url"), "p").first()[0] == "p: {url: a}"


def _write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_counts_and_politeness_keep_their_state(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    base = dt.datetime(2024, 1, 1)
    rows = [{"id": i, "word": ["big", "bad"][i % 3 == 1], "at": (base + dt.timedelta(seconds=(i * 7) % 11)).isoformat() + "Z"} for i in range(12)] + [{"id": 98, "word": None, "at": None}]
    _write(folder, "a.json", rows[:5])
    _write(folder, "b.json", rows[5:])
    stream = spark.readStream.schema("id long, word string, at timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    got = topology.run_to_table(topology.counted(stream), f"c-{uuid.uuid4().hex}", "append").collect()
    assert sorted((r.word, int(r["count"])) for r in got) == [("bad", k) for k in range(1, 5)] + [("big", k) for k in range(1, 9)]
    polite = {r.id: r.start for r in topology.run_to_table(topology.polite(stream, "word", "at", "id", 5), f"p-{uuid.uuid4().hex}", "append").collect()}
    free, want = {}, {}
    for part in (rows[:5], rows[5:12]):  # a batch each
        for r in sorted(part, key=lambda r: (r["word"], r["at"], r["id"])):
            at = dt.datetime.fromisoformat(r["at"][:-1])
            want[r["id"]] = max(at, free.get(r["word"], at))
            free[r["word"]] = want[r["id"]] + dt.timedelta(seconds=5)
    assert polite == want


def _chain(spark, frontier):
    pages = spark.createDataFrame([("http://a.test:80/", 1, "text/html", "x"), ("http://b.test:80/p", 2, "text/html", "y")], "url string, fetch_id long, mime string, content string")
    rules = spark.createDataFrame([("b.test:80", "User-agent: *\nDisallow: /p")], "host_port string, body string").select("host_port", robots(F.col("body")).alias("rules"))
    seen = spark.createDataFrame([("http://a.test:80/",)], "url string")

    def links(docs):
        return docs.select("fetch_id", F.explode(F.array(F.lit("http://a.test:80/"), F.lit("http://c.test:80/"), F.concat(F.lit("http://d.test:80/"), "content"))).alias("url"))

    return topology.crawl_chain(frontier, rules, pages, seen, links)


def test_crawl_chain_and_its_plan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in", "f.json", [{"seq": i, "url": u} for i, u in enumerate(["http://a.test:80/", "http://a.test:80/", "http://b.test:80/p", "http://no.test/", None])])
    stream = _chain(spark, files.frontier_stream(spark, str(tmp_path / "in")))
    got = topology.run_to_table(stream.plan(), f"k-{uuid.uuid4().hex}", "append")
    batch = _chain(spark, spark.read.schema("seq long, url string").json(str(tmp_path / "in")))
    assert sorted(r.url for r in got.collect()) == sorted(r.url for r in batch.plan().collect()) == ["http://c.test:80/", "http://d.test:80/x"]
    assert [tuple(r) for r in batch.steps_table(spark).collect()] == [(1, "crawl", "shuffle", 10, []), (2, "parse", "shuffle", 10, []), (3, "filter", "shuffle", 5, [])]
    assert "3: filter x 5 by shuffle" in batch.dump() and "Physical Plan" in batch.dump()


def test_stop_deletes_what_it_made(spark, tmp_path):
    query = spark.readStream.format("rate").load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
    assert query.isActive and topology.stop(query, f"{tmp_path}/out", f"{tmp_path}/check")
    assert not query.isActive and not (tmp_path / "check").exists() and topology.stop(query)
