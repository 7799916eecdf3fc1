from __future__ import annotations

import numpy as np

from silkmoth.llm import page_stats, templates, word_salad
from silkmoth.llm.pages import ABOUT, CLOSED, ENDS, FILED, cut, flags_of, is_html, is_page, parse, words_of
from silkmoth.llm.templates import deduce

SUBJECTS = ["The museum", "A clinic", "The old club", "The library", "An agency", "The council"]
VERBS = ["opened", "closed", "reviewed", "approved", "tested", "rejected"]
OBJECTS = ["the bridge", "a new line of shoes", "the winter festival", "a report on sleep", "the ticket office", "a menu of soups"]


def sentence(i):
    return f"{SUBJECTS[i % 6]} {VERBS[i // 6 % 6]} {OBJECTS[i // 36 % 6]} near Town{i} in {1000 + i}."


def page(i, host, body=None):
    lines = [
        "<html><head>",
        f"<title>{sentence(i * 40)[:-1]} - Site</title>",
        "</head><body>",
        '<div class="n">',
        '<a href="/">Home</a> | <a href="/n">News</a>',
        "</div>",
        '<div class="m">',
        f"<h1>{sentence(i * 40)[:-1]}</h1>",
        *(body or [f"<p>{sentence(i * 40 + 1)} {sentence(i * 40 + 2)}</p>", f"<p>{sentence(i * 40 + 3)}", f"{sentence(i * 40 + 4)}</p>"]),
        "<p>Share this article</p>",
        f'<p>Read also: <a href="/x">{sentence(i * 40 + 5)[:-1]}</a></p>',
        f"<p># Town{i}, Ville{i}</p>",
        "</div>",
        '<div class="r">',
        "<h3>Read also</h3>",
        f'<li><a href="/y">{sentence(i * 40 + 6)[:-1]}</a> <span>{sentence(i * 40 + 7)}</span></li>',
        "</div>",
        f"<p>You are reading {host}, the daily companion.</p>",
        "</body></html>",
    ]
    return "\n".join(lines)


def _docs(spark, extra=()):
    rows = [(k * 100 + i, f"http://h{k}.test/{i}", "text/html", page(k * 40 + i, f"Herald {k}"), "clash", 0) for k in range(3) for i in range(12)]
    return spark.createDataFrame([*rows, *extra], "fetch_id long, url string, mime string, content string, host string, line_no int")


def test_parse():
    p = parse("<html><head><title>A b c - S</title>\n<script>\nx < 1\n</script></head><body>\n<div class='k'>\n<h1>A b <b>c</b></h1>\n<p>one<br>two <a href=x>li\nnk</a></p></div>\n<!-- no\nno --> yes", "text/html")
    assert [(x.no, x.text, x.own, x.links, x.path, x.element) for x in p.lines] == [
        (6, "a b c", "a b c", 0, ("div class=k",), "h1"),
        (7, "one two li", "one two", 1, ("div class=k",), "p"),
        (8, "nk", "nk", 0, ("div class=k",), ""),
        (10, "yes", "yes", 0, (), ""),
    ]
    assert p.head == 0
    assert [x.no for x in parse("One.\n\n--\n# a", "text/plain").lines] == [1, 4]


def test_broken_markup_is_linear():
    for text in ("<" * 200_000, "<div>" * 50_000 + "x", "</div>" * 50_000, "<a " * 50_000, "<p class=" + '"' * 50_001):
        parse(text, "text/html")


def test_kinds():
    assert is_page(None, "<html>") and is_page("TEXT/HTML", "") and is_page("text/plain; charset=x", "") and is_page("application/xhtml+xml", "")
    assert not is_page("application/pdf", "x") and not is_page(None, "%PDF-1") and not is_page("image/png", "x")


def test_flags():
    assert flags_of("A b c.”") == ENDS | CLOSED and flags_of("so:") == CLOSED
    assert flags_of("# a, b") == FILED | ABOUT and flags_of("Tags: a, b") & FILED and not flags_of("Town: the council said") & FILED


def test_addresses_are_words_and_lines_have_segments():
    assert words_of("See www.a-b.example or http://x.test/y?z=1") == "see www.a-b.example or http://x.test/y?z=1"
    assert words_of("It ends.Next 3.5 km, a@b.example") == "it ends next 3 5 km a b example"
    assert cut("One two. “Three!” Four · five") == ("one two three four five", (2, 1, 1, 1)) and cut("one two") == ("one two", ())


def test_null_type_is_judged_by_the_whole_content():
    assert is_page(None, "[Update] The council met on Monday.") and is_page(None, "{curly} text") and not is_page(None, '{"a": [1') and not is_page(None, "[1, 2]") and not is_page("", ' [{"x": 1}]')
    assert is_html(None, "<!-- " + "x" * 5000 + " --><p>text</p>") and not is_html(None, "a < b")


def test_classes():
    block = [("u1", [["x"], ["y"], ["a"]]), ("u2", [["x"], ["y"], ["b"]]), ("u3", [["z"], ["b"]]), ("u3", [["b"], ["w"], ["z"]])]
    assert set(deduce(block, alone=0.9).units) == {"x", "y"}
    assert set(deduce(block, alone=0.1).units) == {"x", "y", "b"}
    assert not deduce([]).units


def test_articles(spark):
    got: dict[int, list[int]] = {}
    extra = [(900, "http://h0.test/e", "text/html", "", "", 0), (901, "http://h0.test/n", "text/html", None, "", 0), (902, "http://h0.test/p", "application/pdf", "x", "", 0), (None, "http://h0.test/q", None, "x", "", 0)]
    extra += [(0, "http://h0.test/0", "text/html", page(0, "Herald 0"), "clash", 0), (903, None, "text/html", page(70, "Nobody"), "", 0)]
    for r in templates.articles(_docs(spark, extra)).collect():
        got.setdefault(r.fetch_id, []).append(r.line_no)
    assert set(got) == {k * 100 + i for k in range(3) for i in range(12)} | {903}
    assert all(sorted(v) == [8, 9, 10, 11] for v in got.values())
    assert templates.articles(_docs(spark).limit(0)).collect() == []


def test_plain_text(spark):
    body = "Home > News\n\n{}\n{}\n\nRead also: {}\n{}\n\nRead also\n{}\n{}\n\n© 2020 Herald."
    rows = []
    for i in range(12):
        s = [sentence(90_000 + i * 9 + k) for k in range(6)]
        rows.append((500 + i, f"http://p.test/{i}", "text/plain", body.format(s[0][:-1], s[1], s[2][:-1], s[3], s[4][:-1], s[5][:-1]), "", 0))
    got: dict[int, list[int]] = {}
    for r in templates.articles(_docs(spark, rows)).where("fetch_id >= 500").collect():
        got.setdefault(r.fetch_id, []).append(r.line_no)
    assert set(got) == set(range(500, 512)) and all(sorted(v) == [3, 4, 7] for v in got.values())


def test_spam(spark):
    stuffed, other = (["<p>" + f"{b} casino. {b} cheap pills! buy {b}. " * 12 + "</p>"] for b in ("brandox", "vuleta"))
    links = [f'<li><a href="/{i}">pills Ort{i}</a></li>' for i in range(30)]
    tags = [f"<p>{i}-X | brandox | outlet | XL | {i},99</p>" for i in range(30)]
    sprinkled = [*tags, f"<p>{sentence(60_009)}</p>"]
    hidden = ['<div style="display:none">', *other, "</div>"]
    table = ["<table>", *[f"<tr><td>Place{i}</td><td>Town{i * 7}</td><td>{i}:1</td></tr>" for i in range(8)], "</table>", f"<p>{sentence(60_003)} {sentence(60_040)}</p>"]
    linked = [f'<p><a href="/z">{sentence(70_000 + i * 31)[:12]}</a>{sentence(70_000 + i * 31)[12:]}</p>' for i in range(20)]
    pages = {600: stuffed, 601: links, 602: tags, 603: sprinkled, 604: hidden, 605: table, 606: linked}
    rows = [(f, f"http://h{f % 3}.test/{f}", "text/html", page(f, "Herald", b), "", 0) for f, b in pages.items()]
    rows += [(607, "http://h1.test/t", "text/plain", "Home > News\n\n" + "nelgor casino. cheap nelgor! " * 30, "", 0), rows[0], (608, "http://h1.test/o", "text/plain", "short", "", 0)]
    got = word_salad.spam_pages(_docs(spark, rows))
    assert {r.fetch_id for r in got.where("spam").collect()} == {600, 601, 602, 603, 604, 607}
    assert got.count() == 36 + 9
    assert word_salad.spam_pages(_docs(spark).limit(0)).collect() == []


def _copies(body, ids, url="http://h{k}.test/c{f}"):
    return [(f, url.format(k=f % 3, f=f), "text/html", page(5000 + f, f"Herald {f % 3}", body), "", 0) for f in ids]


def test_spam_copied_onto_many_pages(spark):
    stuffed = ["<p>" + "zorbix casino. zorbix cheap pills! buy zorbix. " * 12 + "</p>", "<p>" + "cheap zorbix pills. casino zorbix outlet. " * 9 + "</p>"]
    got = word_salad.spam_pages(_docs(spark, _copies(stuffed, range(700, 712)))).where("spam")
    assert {r.fetch_id for r in got.collect()} == set(range(700, 712))


def test_copied_and_redelivered_articles_keep_their_lines(spark):
    text = [f"<p>{sentence(80_001)} {sentence(80_002)}</p>", f"<p>{sentence(80_003)}</p>"]
    other = [f"<p>{sentence(81_001)} {sentence(81_002)}</p>", f"<p>{sentence(81_003)}</p>"]
    rows = [(720 + k, f"http://h{k}.test/c", "text/html", page(5100 + k, f"Herald {k}", text), "", 0) for k in range(3)]
    rows += [(730, "http://h1.test/d", "text/html", page(5200, "Herald 1", other), "", 0)] * 5
    got: dict[int, list[int]] = {}
    for r in templates.articles(_docs(spark, rows)).where("fetch_id >= 700").collect():
        got.setdefault(r.fetch_id, []).append(r.line_no)
    assert {k: sorted(v) for k, v in got.items()} == {720: [8, 9, 10], 721: [8, 9, 10], 722: [8, 9, 10], 730: [8, 9, 10]}


def test_article_at_two_urls_and_quoted_passage():
    site = [["home"], ["share this"]]
    text = [f"paragraph {i} of an article that is at two urls" for i in range(4)]
    quote = ["a long passage that two articles quote", "and its second paragraph, no less long"]
    pages = [(f"u{i}", [*site, *([f"own text {i} {k} of this page only"] for k in range(3))]) for i in range(8)]
    pages += [("print", [*site, *([t] for t in text)]), ("mobile", [*site, *([t] for t in text)])]
    pages += [(f"q{i}", [*site, *([t] for t in quote), *([f"opinion {i} {k} about what they said"] for k in range(3))]) for i in range(2)]
    pages += [(f"v{i}", [*site, *([f"other text {i} {k} of this page only"] for k in range(3))]) for i in range(12)]
    slots = [{u for line in lines for u in line} - {"home"} for _, lines in pages]
    assert set(deduce(pages, slots=slots).units) == {"home", "share this"}
    small = [pages[8], pages[9], pages[0], pages[1]]
    assert set(deduce(small, slots=[{u for line in x for u in line} - {"home"} for _, x in small]).units) == {"home", "share this"}


def test_distinct_tags_word_salad_and_short_lists_are_spam(spark):
    salad = ["<p>" + " ".join(f"zq{i * k % 97}x{i}" for i in range(30)) + ".</p>" for k in (3, 5)]
    tags = [f"<p>brand{i} outlet{i} size{i} colour{i}</p>" for i in range(12)]
    short = [f'<li><a href="/{i}">pills Ort{i}</a></li>' for i in range(6)]
    rows = [(800 + k, f"http://h{k}.test/{800 + k}", "text/html", page(6000 + k, f"Herald {k}", b), "", 0) for k, b in enumerate((salad, tags, short))]
    assert {r.fetch_id for r in word_salad.spam_pages(_docs(spark, rows)).where("spam").collect()} == {800, 801, 802}


def test_classes_keep_order_and_nest():
    frame = [["top"], ["middle"], ["end"]]
    own = [[f"own {i}"] for i in range(40)]
    pages = [(f"u{i}", [frame[0], own[i], frame[1], frame[2]]) for i in range(36)]
    right = [(f"r{i}", [frame[0], ["box"], ["line of the box"], own[36 + i], frame[1], frame[2]]) for i in range(2)]
    assert {"box", "line of the box"} <= set(deduce(pages + right).units)
    turned = [right[0], ("r1", [frame[0], ["line of the box"], ["box"], own[37], frame[1], frame[2]])]
    assert "box" not in deduce(pages + turned).units
    across = [(f"r{i}", [frame[0], ["box"], frame[1], ["line of the box"], own[36 + i], frame[2]]) for i in range(2)]
    assert "box" not in deduce(pages + across).units and {"top", "middle", "end"} <= set(deduce(pages + across).units)


def test_templates_of_many_small_hosts(spark):
    rows = []
    for k in range(40):
        for i in range(10):
            body = [f"<p>{sentence(k * 900 + i * 7 + 1)}</p>", f"<p>{sentence(k * 900 + i * 7 + 2)} {sentence(k * 900 + i * 7 + 3)}</p>"]
            if (k + i) % 5 == 0 or k == 0:
                body.insert(1, "<p>Log in to comment</p>" if k else "<p>Our readers' club meets today</p>" if i < 2 else "<p>Own line</p>")
            rows.append((k * 100 + i, f"http://h{k}.test/{i}", "text/html", page(k * 40 + i, f"Herald {k}", body), "", 0))
    rows.append((9000, "http://h7.test/rare", "text/html", page(9000, "Herald 7", [f"<p>{sentence(99_001)}</p>", "<p>Log in to comment Share this article</p>"]), "", 0))
    got: dict[int, list[int]] = {}
    for r in templates.articles(spark.createDataFrame(rows, "fetch_id long, url string, mime string, content string, host string, line_no int").repartition(7)).collect():
        got.setdefault(r.fetch_id, []).append(r.line_no)
    texts = {r[0]: r[3].split("\n") for r in rows}
    lines = [texts[f][n - 1] for f, ns in got.items() for n in ns]
    assert sum("Town" in x or "opened" in x or "<h1>" in x for x in lines) == len(lines) and sum("<h1>" in x for x in lines) == 401 and sorted(got[9000]) == [8, 9]
    assert len(lines) == 401 + 800 + 1


def test_long_units_are_recognised():
    long = " ".join(f"word{i}" for i in range(120))
    block = [(f"u{i}", [[long], [f"own {i}"]]) for i in range(12)]
    template = deduce(block)
    assert templates.rest(long, (), template.units) == [] and template.without("own text here " + long) == "own text here"


def test_information():
    v = page_stats.information([50, 3, 500], [60, 900, 600], [55, 800, 700], 1000, 3)
    assert v[0] > 0.75 and -1 < v[1] < v[2] < v[0] and page_stats.information([1000], [1000], [1000], 1000, 3)[0] <= 1


def test_information_decides(spark, monkeypatch):
    salad = ["<p>" + " ".join(f"zq{i * k % 97}x{i}" for i in range(30)) + ".</p>" for k in (3, 5)]
    docs = _docs(spark, [(800, "http://h1.test/800", "text/html", page(6000, "Herald 1", salad), "", 0)])
    assert {r.fetch_id for r in word_salad.spam_pages(docs).where("spam").collect()} == {800}
    stats = page_stats.statistics(page_stats.parsed(docs))
    flat = page_stats.Stats(stats.pages, stats.least, stats.mean, stats.word_keys, stats.word_pages, np.zeros(0, np.int64), np.zeros(0, np.float32))
    stats.pair_values[:] = 0.5
    p = parse(page(6000, "Herald 1", salad), "text/html")
    assert word_salad.is_spam(*word_salad.Judge(stats).pages([p])[0]) and word_salad.is_spam(*word_salad.Judge(flat).pages([parse(page(1, "Herald 1"), "text/html")])[0])


def test_list_of_addresses_on_one_line_is_spam(spark):
    body = [f"<p>{sentence(60_003)}</p>", "<br>".join(f'<a href="/{i}">www.place{i}-shop.example</a>' for i in range(40))]
    rows = [(950, "http://h1.test/950", "text/html", page(6500, "Herald 1", body), "", 0)]
    assert {r.fetch_id for r in word_salad.spam_pages(_docs(spark, rows)).where("spam").collect()} == {950}


def test_units_at_both_ends_of_a_segment_go():
    template = templates.Template({"print this page": 5, "accept all": 9, "advertisement": 4}, {}, 20)
    assert template.without("print this page some of our partners accept all") == "some of our partners"
    assert template.without("advertisement you can change it") == "you can change it" and template.without("print this page") == "print this page"


def test_copies_are_found_beyond_many_pages_with_the_same_long_units():
    notices = [f"notice {i} of the site, which is longer than any paragraph of its articles and stands below all of them" for i in range(3)]
    text = [f"paragraph {i} of an article that is at three urls" for i in range(4)]
    pages = [(f"u{i:02}", [["home"], *([f"own text {i} {k} of this page only"] for k in range(4)), *([n] for n in notices)]) for i in range(30)]
    pages += [(f"z{i}", [["home"], *([t] for t in text), *([n] for n in notices)]) for i in range(3)]
    slots = [{u for line in lines for u in line} - {"home"} for _, lines in pages]
    got = templates.bodies([(url, own) for (url, _), own in zip(pages, slots, strict=True)])
    assert len(set(got)) == 31 and len(set(got[30:])) == 1
    assert set(deduce(pages, slots=slots).units) == {"home", *notices}


def test_copies_whose_longest_units_differ_are_found():
    text = {f"paragraph {i} of an article that is at two urls" for i in range(60)}
    longest = [{f"paragraph {i} of an article that is at two urls, {how}" for i in range(60, 63)} for how in ("as it was first written", "as it was corrected later")]
    assert len(set(templates.bodies([(f"u{i}", text | x) for i, x in enumerate(longest)]))) == 1
    assert len(set(templates.bodies([("u0", text | longest[0]), ("u1", set(sorted(text)[:50]) | longest[1])]))) == 2


def test_copies_are_those_of_all_pairs():
    for seed in range(300):
        rng = np.random.default_rng(seed)
        pool = ["u" * int(n) + str(i) for i, n in enumerate(rng.integers(1, 12, rng.integers(3, 40)))]
        kinds = [set(rng.choice(pool, rng.integers(0, len(pool) + 1), replace=False).tolist()) for _ in range(4)]
        block = [(f"u{rng.integers(80)}", kinds[rng.integers(4)] ^ set(rng.choice(pool, rng.integers(3)).tolist())) for _ in range(rng.integers(1, 60))]
        body = list(range(len(block)))
        for k, (url, own) in enumerate(block):
            for j, (other, theirs) in enumerate(block[:k]):
                if url == other or own & theirs and sum(map(len, own & theirs)) >= templates.SAME * max(sum(map(len, own)), sum(map(len, theirs))):
                    body = [body[j] if x == body[k] else x for x in body]
        got = templates.bodies(block)
        assert len(set(got)) == len(set(body)) == len(set(zip(got, body, strict=True)))
