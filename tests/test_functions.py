from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from silkmoth.functions import html, http, text, urls, xpath
from silkmoth.functions.porter import measure, stem
from silkmoth.functions.robots import is_disallowed, no_rules, parse_rules, robots

URLS = {
    "http://a.com": ("http://a.com:80/", True),
    " https://a.com/x.html ": ("https://a.com:443/x.html", True),
    "https://a.com/x.html#top": ("https://a.com:443/x.html#top", False),
    "http://a.com:8080/b?x=1": ("http://a.com:8080/b?x=1", True),
    "http://a.com:zz/b": ("http://a.com:80/b", True),
    "http://a.com/img.png": ("http://a.com:80/img.png", False),
    "http://a.com?q=1": ("http://a.com?q=1:80/", True),
    "http:///foo": (None, True),
    "ftp://a.com/x": (None, False),
    "": (None, False),
    "HTTP://A.com/": (None, False),
    None: (None, False),
}


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string").withColumn("p", urls.parse_url(F.col("u")))
    got = {r.u: (r.n, r.d) for r in df.select("u", urls.normalize(F.col("p")).alias("n"), urls.is_desired(F.col("p.path")).alias("d")).collect()}
    assert got == URLS


def test_absolutise(spark):
    want = {"/x": "http://h/x", "//o/y": "http://o/y", "z": "http://h/a/z", "?q": "http://h/a/b?q", "#t": None, "": None, "mailto:me": None, "https://o/": "https://o/"}
    df = spark.createDataFrame([(h,) for h in want], "h string").withColumn("b", urls.parse_url(F.lit("http://h/a/b?c#d")))
    assert {r.h: r.a for r in df.select("h", urls.absolutise(F.col("h"), F.col("b")).alias("a")).collect()} == want


def test_html(spark):
    page = "<html><head><title> T </title></head><body><p>one <b>t</b>wo&amp;<br>three<!-- no --><script>x</script><a class=k href='/l?a=1&amp;b=2'>L</a> <a HREF=\"m\">M</a></body>"
    df = spark.createDataFrame([(page,), (None,), ("plain  text",)], "c string")
    rows = df.select(html.body_text(F.col("c")), html.title_text(F.col("c")), html.hrefs(F.col("c"))).collect()
    assert tuple(rows[0]) == ("one two& threeL M", "T", ["/l?a=1&b=2", "m"])
    assert rows[1][0] is None and rows[2][0] == "plain text"
    long = spark.createDataFrame([("<" * 20_000 + "a",)], "c string")
    assert long.select(html.body_text(F.col("c"))).first()[0].endswith("a")


def test_open_elements_are_linear(spark):
    for text in ("<script>x" * 40_000 + "a", "<!-- " * 60_000 + "a", "<style" * 40_000 + "</style>a", "</head>" + "<head>" * 40_000 + "a"):
        began = time.time()
        df = spark.createDataFrame([(text,)], "c string")
        assert df.select(html.body_text(F.col("c"))).first()[0].endswith("a") and time.time() - began < 20
    refs = spark.createDataFrame([("a &amp;lt; &eacute;&Eacute; &nope; &; & &#39;x&copy",)], "c string")
    assert refs.select(html.resolved(F.col("c"))).first()[0] == "a &lt; é\u00c9 &nope; &; & 'x&copy"


def test_controls(spark):
    df = spark.createDataFrame([("a\nb\tc\u200bd\uffffe\ue000f",)], "c string")
    assert df.select(html.without_controls(F.col("c"))).first()[0] == "abcdef"


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("caress", "caress"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("disabled", "disabl"), ("matting", "mat"), ("mating", "mate"), ("meeting", "meet"),
     ("milling", "mill"), ("messing", "mess"), ("meetings", "meet"), ("relational", "relat"), ("conditional", "condit"), ("happy", "happi"), ("sky", "sky"), ("rational", "ration"), ("adoption", "adopt"), ("controll", "control"),
     ("roll", "roll"), ("probate", "probat"), ("rate", "rate"), ("hopefulness", "hope"), ("formaliti", "formal"), ("is", "is"), ("running", "run")],
)
def test_stem(word, want):
    assert stem(word) == want


def test_measure():
    assert [measure(w) for w in ("tr", "ee", "tree", "y", "by", "trouble", "oats", "trees", "ivy", "troubles", "private", "oaten")] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


def test_tokens(spark):
    df = spark.createDataFrame([("The cats, cats!",), ("Être naïve",), ("don't",), ("x9 running 2020",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(text.tokens(F.col("t"))).collect()]
    assert got == [["the", "cats", "cats"], ["tre", "na", "ve"], ["don", "t"], ["x9", "running", "2020"], [], []]
    words = spark.createDataFrame([("running",), ("x9",), ("2020",), (None,)], "token string")
    assert {tuple(r) for r in text.stem_vocabulary(words).collect()} == {("running", "run"), ("x9", "x9"), ("2020", "2020")}


ROBOTS = [
    (None, ([], 5000, False)),
    ("User-agent: *\nDisallow: /a\nCrawl-Delay: 2", (["/a"], 2000, False)),
    ("user-AGENT: *\nDisallow: /a\nCrawl-Delay: 2\n\nUser-agent: me\nDisallow: /b", (["/b"], 2000, True)),
    ("User-agent: me\nDisallow: /b\n\nUser-agent: *\nDisallow: /a", (["/b"], 5000, True)),
    ("User-agent: *\nDisallow: /a\nDisallow:\nDisallow: /c", (["/a"], 5000, False)),
    ("User-agent: *\r\nDisallow: \r\n", ([""], 5000, False)),
    ("User-agent: *\nCrawl-Delay: 0.5\nDisallow: /a", ([], 5000, False)),
    ("User-agent: other\nDisallow: /", ([], 5000, False)),
]


@pytest.mark.parametrize(("body", "want"), ROBOTS)
def test_robots(body, want):
    assert parse_rules(body, "ME") == want


def test_robots_columns(spark):
    df = spark.createDataFrame([(b, "/a/x") for b, _ in ROBOTS], "b string, p string").withColumn("r", robots(F.col("b"), "me"))
    got = [(r.r.delay_ms, r.x) for r in df.select("r", is_disallowed(F.col("p"), F.col("r")).alias("x")).collect()]
    assert got == [(5000, False), (2000, True), (2000, False), (5000, False), (5000, True), (5000, True), (5000, False), (5000, False)]
    assert df.select(is_disallowed(F.col("p"), no_rules())).first()[0] is False


def test_http(spark):
    rows = [(404, None, None, None), (304, None, None, None), (301, "http://b/", None, None), (302, None, None, None), (200, None, 1_000_001, "text/html"), (200, None, None, "text/html; charset=utf-8"), (200, None, 5, "image/png"), (200, None, 5, None)]
    df = spark.createDataFrame(rows, "s int, l string, n long, k string")
    got = [r[0] for r in df.select(http.head_outcome(F.col("s"), F.col("l"), F.col("n"), F.col("k"), 1_000_000)).collect()]
    assert got == ["error", "not_modified", "redirect", "error", "undesired", "text/html; charset=utf-8", "undesired", "undesired"]
    block = spark.createDataFrame([("HTTP/1.1 200 OK\r\nX-A: 1\r\n 2\r\nx-b: c:d\r\nX-A: 3\r\n",)], "b string")
    assert block.select(http.headers(F.col("b"))).first()[0] == {"x-a": "3", "x-b": "c:d"}


def test_xpath(spark):
    want = {"/a/b": True, '/a / b[ text() = "x y" ]': True, '/a[contains(text(),"z")][@id="1"]/c': True, "/a[b]": False, "//a": False, "a/b": False, "/a/": False, '/a[@href="x/y"]': False, "/a[": False, None: False}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r[0]: r[1] for r in df.select("p", xpath.is_valid(F.col("p"))).collect()} == want


def test_redirects_and_times(spark):
    df = spark.createDataFrame([("http://a/, http://b/", False), ("http://a/, http://b/", True), (None, True)], "l string, s boolean")
    assert [r[0] for r in df.select(http.redirect_targets(F.col("l"), F.col("s"))).collect()] == [["http://a/", "http://b/"], ["http://a/, http://b/"], []]
    codes = spark.createDataFrame([(100,), (206,), (299,)], "s int").select(http.head_outcome(F.col("s"), F.lit(None), F.lit(1), F.lit("text/html"), 10))
    assert [r[0] for r in codes.collect()] == ["undesired", "text/html", "text/html"]
    assert spark.sql("select timestamp'2024-03-01 13:05:09' as t").select(http.iso_time(F.col("t"))).first()[0] == "2024-03-01T13:05:09"
