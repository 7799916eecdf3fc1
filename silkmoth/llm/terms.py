"""Terms of raw page content, shared by the term operators."""

from __future__ import annotations

import re

_TAG = re.compile(r"<[^>]*>")
_TERM = re.compile(r"[A-Za-z0-9]+")


def strip_tags(content: str) -> str:
    """``content`` with each stretch from ``<`` to the next ``>`` replaced by a blank.

    Only the part up to the last ``>`` can hold a tag; looking no further keeps
    the time linear for texts full of lone ``<``.
    """
    last = content.rfind(">") + 1
    return _TAG.sub(" ", content[:last]) + content[last:]


def terms_of(content: str) -> list[str]:
    """Maximal runs of ASCII letters and digits, lower-cased, tags removed first."""
    return [t.lower() for t in _TERM.findall(strip_tags(content))]
