from __future__ import annotations

import pytest

from silkmoth.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
