from __future__ import annotations

import datetime as dt
import random

from silkmoth.operators import skew


def _edges(spark, rows):
    return spark.createDataFrame(rows, "edge_id long, url string, dest string, seen_at timestamp, node string, chunk int")


def _brute(rows):
    out = {}
    for side, at in (("dest", 2), ("url", 1)):
        for node in {r[at] for r in rows if r[at] is not None}:
            own = sorted((r for r in rows if r[at] == node), key=lambda r: (r[3] is not None, r[3] or 0, r[0]))
            times = [r[3] for r in own if r[3] is not None]
            steps = [(b - a) // dt.timedelta(microseconds=1) for a, b in zip(times, times[1:], strict=False)]
            out[side, node] = (len(own), min(times, default=None), max(times, default=None), max(steps, default=None))
    return out


def test_per_key_against_brute_force(spark):
    random.seed(1)
    base = dt.datetime(2024, 3, 1)
    rows = []
    for i in range(600):
        dest = random.choice(["hot"] * 6 + ["", None, "a", "b"])
        rows.append((i // 2, random.choice(["u", "v", f"w{i}"]), dest, None if i % 17 == 0 else base + dt.timedelta(seconds=random.randrange(400)), "clash", 7))
    for chunk in (7, 1000):
        got = skew.per_key(_edges(spark, rows), ["dest", "url"], "seen_at", "edge_id", partitions=5, chunk=chunk)
        assert {(r.side, r.node): (r.n_rows, r.first_at, r.last_at, r.longest_step) for r in got.collect()} == _brute(rows)


def test_hot_keys_count_rows_as_delivered(spark):
    rows = [(1, "u", "hot", None, "", 0)] * 99 + [(2, "x", None, None, "", 0)] + [(3, f"s{i}", f"d{i}", None, "", 0) for i in range(101)]
    edges = _edges(spark, rows)
    got = skew.hot_keys(skew.per_key(edges, ["dest", "url"], "seen_at", "edge_id"), edges.count(), 0.4)
    assert sorted((r.side, r.node) for r in got.collect()) == [("dest", "hot"), ("url", "u")]


def test_empty(spark):
    assert skew.per_key(_edges(spark, []), ["dest", "url"], "seen_at", "edge_id").collect() == []


def test_numbering_is_exact(spark):
    df = spark.range(5000).selectExpr("id % 3 as k", "id % 7 as o", "id")
    got = skew.numbered(df, ["k"], ["o", "id"], partitions=6, chunk=100)
    rows = got.groupBy("k").agg({"pos": "max", "id": "count"}).collect()
    assert all(r["max(pos)"] == r["count(id)"] for r in rows)
    assert got.select("k", "pos").distinct().count() == 5000
    assert got.where("chunk <> (pos - 1) div 100").count() == 0
