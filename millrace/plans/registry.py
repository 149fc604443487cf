"""Named queries over a folder of tables, each with the SQL that DuckDB checks it by, where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.relations_sql import RELATIONS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, rel: str = "", recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; rel: names of derived relations that its SQL uses, as common table expressions before its own."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            parts = [f"{r} AS ({RELATIONS[r]})" for r in rel.split()]
            body = sql.strip()
            if body.upper().startswith("WITH "):
                parts.append(body[5:])
                text = ",\n".join(parts)
            else:
                text = ",\n".join(parts) + "\n" + body if parts else body
            SQL[name] = (("WITH RECURSIVE " if recursive else "WITH ") if parts else "") + text
        return f

    return add
