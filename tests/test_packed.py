from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from silkmoth.operators.packed import unpack, unpack_rows

CASES = {
    None: [],
    "": [],
    " , ;| ": [],
    "/a": ["/a"],
    "/a,/b": ["/a", "/b"],
    "/a, ,/b;": ["/a", "/b"],
    "/a,x.html, /b": ["/a,x.html", "/b"],
    "/a;v=8|http://h/b?t=a|b": ["/a;v=8", "http://h/b?t=a|b"],
    "[/a, //h/b]": ["/a", "//h/b"],
    '["/a","http:\\/\\/h\\/b?q=\\"x\\""]': ["/a", 'http://h/b?q="x"'],
    '[["/a"],["/b","/c,d"]]': ["/a", "/b", "/c,d"],
    '"/a,/b";/c': ["/a,/b", "/c"],
    '"/a?q=""x""",/b': ['/a?q="x"', "/b"],
    "'/a','/b''c'": ["/a", "/b'c"],
    "/a\\,/b,/c": ["/a,/b", "/c"],
    "/a(x,/y),/b": ["/a(x,/y)", "/b"],
    "www.h.example:443/a http://h/b\t/c\r\n/d": ["www.h.example:443/a", "http://h/b", "/c", "/d"],
    "/a,/a": ["/a", "/a"],
    '"/a': ["/a"],
}


@pytest.mark.parametrize("text", CASES)
def test_unpack(text):
    assert unpack(text) == CASES[text]


@given(st.lists(st.from_regex(r"(/|//h\.example/|https://h\.example:443/|h:8/)[a-z0-9.?=&#]{0,12}", fullmatch=True), max_size=8), st.sampled_from([",", ";", "|", "\t", "\n", ", ", " | "]), st.booleans())
@settings(max_examples=300, deadline=None)
def test_round_trip(values, delimiter, quoted):
    text = delimiter.join(f'"{v}"' if quoted else v for v in values)
    assert unpack(text) == values


@given(st.text(alphabet='/ab,;| "\'\\[](){}:\n8', max_size=40))
@settings(max_examples=500, deadline=None)
def test_any_text_ends_and_loses_no_letter(text):
    got = "".join(unpack(text))
    assert re.sub(r"[^ab]", "", got) == re.sub(r"[^ab]", "", text)


def test_long_text_is_linear():
    assert len(unpack(",".join(["/a,b"] * 100_000))) == 100_000
    assert unpack("[" * 50_000) is not None


def test_nesting_is_linear():
    def took(n):
        began = time.process_time()
        assert unpack("[" * n + "/a" + "]" * n) == ["/a"]
        assert unpack("[" * n + '"/a"') == ["/a"] or unpack("[" * n + "/a") is not None
        return time.process_time() - began

    took(1000)
    assert took(400_000) < 400 * max(took(4_000), 0.01)
    assert unpack("[[/a, [/b, /c]], /d]") == ["/a", "/b", "/c", "/d"]


def test_rows(spark):
    rows = [(1, "/a,/b", "x"), (1, "/a,/b", "x"), (2, None, "y"), (None, "/c", "z"), (3, "  ", "z"), (4, "/d", "z")]
    df = spark.createDataFrame(rows, "line_id long, dest string, value string")
    assert sorted(map(tuple, unpack_rows(df, "line_id", "dest").collect())) == [(1, 1, "/a"), (1, 2, "/b"), (4, 1, "/d")]
    assert unpack_rows(df.limit(0), "line_id", "dest").collect() == []
