"""robots.txt texts as rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Delay where no rule sets one, in milliseconds (fixed value).
DEFAULT_DELAY = 5000
RULES = "struct<disallow:array<string>,delay_ms:int,specific:boolean>"


def parse_rules(body: str | None, agent: str) -> tuple[list[str], int, bool]:
    """Disallowed prefixes, delay and whether a block names ``agent``.

    A block runs from its agent line to a blank line. A block for the agent
    replaces prefixes collected before (not the delay) and shuts out later ``*``
    blocks. A bare ``Disallow:`` or a delay that is no whole number ends the
    reading with the rules so far; ``Disallow:`` and a blank is the empty prefix,
    which every path has. Null gives no rules.
    """
    rules: list[str] = []
    delay, specific, active = DEFAULT_DELAY, False, False
    for line in (body or "").replace("\r\n", "\n").split("\n"):
        if not line.strip():
            active = False
            continue
        name, colon, value = line.partition(":")
        key = name.strip().lower()
        if key == "user-agent":
            who = value.strip().lower()
            if who == agent.lower():
                rules, specific, active = [], True, True
            else:
                active = who == "*" and not specific
        elif active and key == "disallow":
            if not colon or value == "":
                break
            rule = value.strip()
            if rule not in rules:
                rules.append(rule)
        elif active and key == "crawl-delay":
            if not value.strip().isdigit():
                break
            delay = int(value.strip()) * 1000
    return rules, delay, specific


def robots(body: Column, agent: str = "silkmoth") -> Column:
    """Rules of a robots.txt text; null gives the defaults."""

    @F.pandas_udf(RULES)
    def read(bodies: pd.Series) -> pd.DataFrame:
        got = [parse_rules(b if isinstance(b, str) else None, agent) for b in bodies]
        return pd.DataFrame({"disallow": [g[0] for g in got], "delay_ms": [g[1] for g in got], "specific": [g[2] for g in got]})

    return read(body)


def no_rules() -> Column:
    """The rules of a host without a robots.txt."""
    return F.struct(F.array().cast("array<string>").alias("disallow"), F.lit(DEFAULT_DELAY).alias("delay_ms"), F.lit(False).alias("specific"))


def is_disallowed(path: Column, rules: Column) -> Column:
    """Whether any rule is a prefix of the path."""
    return F.exists(rules["disallow"], lambda r: F.startswith(path, r))
