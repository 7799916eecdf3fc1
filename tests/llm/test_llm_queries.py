from __future__ import annotations

import oracle
import pytest

from silkmoth.llm import queries as llm


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_same_as_sql(spark, con, name):
    oracle.same(spark, con, llm.queries()[name], llm.SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.SQL)))
def test_runs(spark, name):
    assert llm.queries()[name](spark, oracle.SF).count() > 0
