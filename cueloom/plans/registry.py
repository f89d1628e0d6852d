"""Registered queries: a callable on (spark, sf_dir) and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import SQL, needs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, fx: tuple[str, ...] = ()):
    """Register a query. sql: the oracle's SELECT, which may start with further CTEs (name AS (...), ...)."""

    def held(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ctes = [f"{k} AS ({SQL[k].replace('SHA256_HEX', 'sha256')})" for k in needs(fx)]
            body = sql.strip()
            if body.upper().startswith("SELECT"):
                ORACLES[name] = ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body
            else:
                ORACLES[name] = "WITH RECURSIVE " + ",\n".join([*ctes, body])
        return f

    return held
