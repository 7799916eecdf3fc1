"""Small XPath expressions as strings: blanks, tokens and validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEXT = r'"[^"/\[\]]*"'
_TEST = rf"(?:text\(\)={_TEXT}|contains\(text\(\),{_TEXT}\)|@[A-Za-z0-9]+={_TEXT})"
#: A path of steps with tests (fixed by the language).
VALID = rf"^(?:/[A-Za-z0-9]+(?:\[{_TEST}\])*)+$"


def strip_blanks(xpath: Column) -> Column:
    """The expression without blanks outside double quotes."""
    pieces = F.split(xpath, '"', -1)
    cleaned = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit(" "), F.lit(""))).otherwise(x))
    return F.array_join(cleaned, '"')


def tokenise(xpath: Column) -> Column:
    """Slashes, brackets and the runs between them; quotes do not shield."""
    return F.regexp_extract_all(xpath, F.lit(r"[/\[\]]|[^/\[\]]+"), F.lit(0))


def is_valid(xpath: Column) -> Column:
    """Whether the expression, without blanks, is a path; null is not."""
    return F.coalesce(strip_blanks(xpath).rlike(VALID), F.lit(False))
