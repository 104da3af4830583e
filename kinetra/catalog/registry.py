"""Named queries with, where SQL can state them, the equivalent SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinetra.catalog.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def r6(c: Column | str) -> Column:
    """Six decimals, with no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 5e-7, F.lit(0.0)).otherwise(F.round(c, 6))


def by_pi(c: Column | str) -> Column:
    """Six decimals of a multiple of pi. Means of short decimals lie on ties of any decimal, where the order of a sum decides the digit; their
    multiples of pi lie on none."""
    return r6((F.col(c) if isinstance(c, str) else c) / F.pi())


def r9(c: Column | str) -> Column:
    """Nine decimals, for means whose exact values end at the seventh and so lie on ties of the sixth."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 5e-10, F.lit(0.0)).otherwise(F.round(c, 9))


def _expand(sql: str) -> str:
    """Fill in view texts and r6(...) calls (innermost parentheses are matched by counting)."""
    for name in sorted(VIEWS, key=len, reverse=True):
        sql = sql.replace(name, VIEWS[name].strip())
    out, at = [], 0
    for m in re.finditer(r"\br6\(", sql):
        if m.start() < at:
            continue
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        arg = sql[m.end():i - 1]
        out += [sql[at:m.start()], f"(CASE WHEN abs({arg}) < 0.0000005 THEN 0.0 ELSE round({arg}, 6) END)"]
        at = i
    return "".join(out) + sql[at:]


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _expand(sql)
        return fn
    return add
