from __future__ import annotations

import re
import subprocess
import sys

import oracle
import pytest

import __spark_entry__ as entry
from silkmoth.plans import queries as core


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_as_sql(spark, con, name):
    oracle.same(spark, con, core.queries()[name], core.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.SQL)))
def test_has_rows(spark, name):
    assert core.queries()[name](spark, oracle.SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core.queries()) <= set(entry.queries())


def test_core_does_not_need_the_text_operators():
    code = "import sys; sys.modules['silkmoth.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('p1_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_links_of_every_html_fetch(spark):
    docs = core.table(spark, oracle.SF, "crawl_docs", "fetch_id", "mime", "content").where("contains(mime, 'text/html') and fetch_id is not null")
    with_links = {r.fetch_id for r in docs.collect() if re.search(r"<a\s[^>]*href=[\"']?/[\w/-]+[\"'\s>]", r.content or "")}
    links = {tuple(r) for r in core.link_extract_all(spark, oracle.SF).collect()}
    parsed = {tuple(r) for r in core.link_extract(spark, oracle.SF).collect()}
    assert parsed < links and with_links <= {r[0] for r in links} and not with_links <= {r[0] for r in parsed}
