"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """QUERIES and ORACLE of one module; add() registers a function under its name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return put


def seconds() -> Column:
    """Seconds of events.ts since 2024-01-01."""
    return (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(1_000_000)


def spark_columns(pairs: list[tuple[str, str]]) -> list[Column]:
    """Columns from (name, expression); the expressions are such as both engines read alike, for made-up inputs of operators."""
    return [F.expr(e).alias(n) for n, e in pairs]


def sql_columns(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in pairs)


#: The same in SQL.
SECONDS = "((epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("s", seconds())


#: The table events with s, in SQL.
EVENTS_SQL = f"(SELECT *, {SECONDS} AS s FROM events)"
