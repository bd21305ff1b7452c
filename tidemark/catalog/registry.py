"""Named queries over the given tables, each with its plain-SQL statement where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, body: str, *needs: str) -> None:
    """A reusable common table expression."""
    _VIEWS[name] = (needs, body)


def _closure(names, seen: list[str]) -> list[str]:
    for n in names:
        if n in seen:
            continue
        _closure(_VIEWS[n][0], seen)
        if n not in seen:
            seen.append(n)
    return seen


def sql(body: str, *needs: str, recursive: bool = False, ctes: str = "") -> str:
    """``body`` behind the views it needs (and extra ``ctes``)."""
    parts = [f"{n} AS ({_VIEWS[n][1]})" for n in _closure(needs, [])]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def query(name: str, statement: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if statement is not None:
            SQL[name] = statement
        return fn

    return keep
