"""Registry of queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            CHECK_SQL[name] = sql
        return fn

    return add


def with_views(*views: str, body: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body


def sql_case(column: str, table: dict, default: str = "NULL") -> str:
    """CASE expression over a short fixed table."""
    def lit(v: object) -> str:
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_any(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"
