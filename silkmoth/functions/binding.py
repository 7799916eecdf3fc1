"""A name for a value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it.

    A column that is named several times in an expression is several copies of
    it; nested, they multiply, and inside a lambda they run for every element.
    """
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)
