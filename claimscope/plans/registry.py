"""Registry of queries: a callable over a table folder, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to the six decimals in which results are compared."""
    c = F.col(c) if isinstance(c, str) and name is None else (F.col(c) if isinstance(c, str) else c)
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """All double columns rounded to six decimals."""
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def epoch(c: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp with or without zone (UTC)."""
    return F.unix_seconds((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
