"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Moves values that lie on the border of two roundings (a mean of 16 amounts in cents) off it, further than sums in another order differ.
TIE = 1 + 1e-12


def tidy(df: DataFrame) -> DataFrame:
    """Numbers in the types and to the digits that are compared: bigint, and double to six places without a negative zero."""
    kinds = dict(df.dtypes)
    change = {c: F.col(c).cast("bigint") for c, k in kinds.items() if k in ("int", "smallint", "tinyint") or k.startswith("decimal")}
    change |= {c: F.round(F.col(c) * TIE, 6) + F.lit(0.0) for c, k in kinds.items() if k in ("double", "float")}
    return df.withColumns(change) if change else df


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(x: str) -> str:
    return f"round(CAST(({x}) AS DOUBLE) * CAST({TIE!r} AS DOUBLE), 6) + CAST(0 AS DOUBLE)"


def n(x: str = "count(*)") -> str:
    return f"CAST({x} AS BIGINT)"


from neurograph.plans import graph, invariants, parts, series, structure  # noqa: E402, F401
