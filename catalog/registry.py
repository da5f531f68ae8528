"""The two registries behind ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _wide_integers(df: DataFrame) -> DataFrame:
    """One integer type on both sides of the comparison."""
    small = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("int", "smallint")]
    return df.withColumns({c: F.col(c).cast("long") for c in small}) if small else df


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = lambda spark, sf: _wide_integers(query(spark, sf))
        if sql is not None:
            SQL[name] = sql
        return query

    return add
