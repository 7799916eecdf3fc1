"""Several values packed into one field: a quote-aware tokenizer.

One pass of a finite-state machine over the field keeps the open quote, a
pending escape and the nesting depth; a delimiter outside quotes, escapes and
parentheses ends a value only where the next piece starts like a value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: How a link target starts (fixed by the data's definition).
LINK_START = r"https?://|/|[A-Za-z0-9.\-]+:[0-9]+/"
#: Characters that may stand between two values.
DELIMITERS = ",;|\t\n\r "

_OPEN, _CLOSE = "([{", ")]}"
_OPENING = re.compile(r"[(\[{]")
_BRACKETS = re.compile(r"\[*")
_QUOTED = {q: re.compile(q + r"|\\") for q in "\"'"}


@lru_cache(maxsize=16)
def _patterns(start: str, delimiters: str) -> tuple[re.Pattern, re.Pattern]:
    """How a value starts, with its quote, and what ends a plain stretch of it."""
    return re.compile(rf"[\"']?(?:{start})"), re.compile("[" + re.escape(delimiters) + r"\\()\[\]{}]")


def _pairs(text: str) -> dict[int, int]:
    """Position of each opening bracket that is closed later -> its closing one."""
    stack: list[tuple[str, int]] = []
    found: dict[int, int] = {}
    for m in re.finditer(r"[()\[\]{}]", text):
        c = m.group()
        if c in _OPEN:
            stack.append((c, m.start()))
        elif stack and _OPEN.index(stack[-1][0]) == _CLOSE.index(c):
            found[stack.pop()[1]] = m.start()
    return found


def unpack(text: str | None, start: str = LINK_START, delimiters: str = DELIMITERS) -> list[str]:
    """The values in ``text``, in order.

    * A value opened by ``"`` or ``'`` runs to the same quote standing before a
      delimiter or the end; a doubled quote and ``\\x`` stand for one character.
    * Outside quotes ``\\`` before a delimiter, quote or backslash takes its meaning away.
    * Brackets around the whole field (and around nested lists) are dropped;
      delimiters inside balanced parentheses of a value do not end it.
    * A delimiter that is not followed by ``start`` (or by a quote before it)
      belongs to the value; at the end of the field it is an empty piece.
    * Null, blank and delimiter-only fields hold no values.
    """
    if text is None:
        return []
    blank = set(delimiters) | {" ", "\t", "\n", "\r"}
    s = text.strip()
    depth = 0
    pairs = _pairs(s) if _OPENING.search(s) else {}
    i, n = 0, len(s)
    while n - i >= 2 and s[i] == "[" and s[n - 1] == "]" and pairs.get(i, n - 1) == n - 1:
        i, n = i + 1, n - 1  # brackets around the whole field
        while i < n and s[i].isspace():
            i += 1
        while n > i and s[n - 1].isspace():
            n -= 1
    value_start, special = _patterns(start, delimiters)
    row = [0, 0]  # the last row of opening brackets that was measured
    out: list[str] = []

    def begins(at: int) -> bool:
        """Whether a value, behind brackets and a quote, begins at ``at``."""
        if not row[0] <= at < row[1]:
            row[:] = at, _BRACKETS.match(s, at, n).end()
        return value_start.match(s, row[1], n) is not None

    def skip(at: int) -> int:
        while at < n and s[at] in blank:
            at += 1
        return at

    def ends(at: int) -> int:
        """Where the next piece begins if the delimiter at ``at`` ends a value, else -1."""
        to = skip(at)
        return to if to >= n or begins(to) else -1

    while True:
        i = skip(i)
        if i >= n:
            return out
        if s[i] == "[" and pairs.get(i, n) < n and begins(i):
            i += 1  # a nested list; its closing bracket is stripped below
            depth += 1
            continue
        buf: list[str] = []
        if s[i] in "\"'":
            q, i, closed = s[i], i + 1, False
            stop = _QUOTED[q]
            while i < n:
                m = stop.search(s, i, n)
                if not m:
                    break
                buf.append(s[i : m.start()])
                i = m.start()
                if s[i] == "\\":
                    if i + 1 < n:
                        buf.append(s[i + 1])
                    i += 2
                elif i + 1 < n and s[i + 1] == q:
                    buf.append(q)
                    i += 2
                elif i + 1 >= n or s[i + 1] in blank or (s[i + 1] == "]" and depth):
                    i += 1
                    closed = True
                    break
                else:
                    buf.append(q)
                    i += 1
            if not closed:
                buf.append(s[i:n])
                i = n
        else:
            while i < n:
                m = special.search(s, i, n)
                if not m:
                    buf.append(s[i:n])
                    i = n
                    break
                buf.append(s[i : m.start()])
                i = m.start()
                c = s[i]
                if c == "\\":
                    if i + 1 < n and (s[i + 1] in blank or s[i + 1] in "\"'\\"):
                        buf.append(s[i + 1])
                        i += 2
                    else:
                        buf.append(c)
                        i += 1
                elif c in _OPEN:
                    to = pairs.get(i, i)
                    to = to if to < n else i
                    buf.append(s[i : to + 1])
                    i = to + 1
                elif c in _CLOSE:
                    if c == "]" and depth and (i + 1 >= n or s[i + 1] in blank or s[i + 1] == "]"):
                        depth -= 1
                    else:
                        buf.append(c)
                    i += 1
                else:
                    to = ends(i)
                    if to >= 0:
                        i = to
                        break
                    to = skip(i)
                    buf.append(s[i:to])
                    i = to
        value = "".join(buf).strip()
        if value:
            out.append(value)


def unpack_rows(df: DataFrame, key: str, packed: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per value of ``packed``: ``(key, pos, value)``, ``pos`` from 1.

    Rows equal in key and field (redeliveries) count once. Rows whose key is
    null cannot be named and are left out; null, blank and empty fields give no
    rows. Other columns of ``df`` are not read, whatever their names. A field of
    any length is scanned once, in time linear in its length.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField(pos, T.IntegerType()), T.StructField(value, T.StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at, values = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                got = unpack(text)
                keys += [i] * len(got)
                at += range(1, len(got) + 1)
                values += got
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(at, pa.int32()), pa.array(values, pa.string())], names=[key, pos, value])

    rows = df.select(key, packed).where(df[key].isNotNull() & df[packed].isNotNull()).distinct()
    return rows.mapInArrow(split, schema)
