"""Registration of queries with the SQL that another engine checks them by."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import hash_uniform_sql, probit_sql
from ..plans.frames import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _expanded(sql: str) -> str:
    """{frame:x} becomes a frame's common table expression, {u:text} a draw and {probit:p} an inverse normal."""
    sql = re.sub(r"\{frame:(\w+)\}", lambda m: SQL[m[1]], sql)
    while m := re.search(r"\{(u|probit):([^{}]*)\}", sql):  # innermost first
        sql = sql[: m.start()] + (hash_uniform_sql if m[1] == "u" else probit_sql)(m[2]) + sql[m.end() :]
    return sql


def query(oracle: str | None = None, also: str | None = None):
    """Registers a query under its name; also: an earlier name that it goes by."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        for name in filter(None, (f.__name__, also)):
            QUERIES[name] = f
            if oracle:
                ORACLE_SQL[name] = _expanded(oracle)
        return f

    return register
