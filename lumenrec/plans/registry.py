"""The register of queries, each with its SQL where SQL can state it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            """Positions are bigint, as in SQL; cast last, so that window limits are still inferred."""
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("bigint") for c, t in df.dtypes if t == "int" and c in ("rank", "n")})

        _QUERIES[f.__name__] = functools.wraps(f)(run)
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
