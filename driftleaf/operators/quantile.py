"""Exact quantiles of groups of any size.

An approximate quantile, which merges on the map side, brackets the wanted rank; only values inside
the bracket are then counted one by one. No task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
_MARGIN = 3.0 / ACCURACY


def _counted_near(df: DataFrame, by: list[str], column: str, q: float) -> DataFrame:
    """(by..., _n, _v, _upto): group size, and the values around the share ``q`` with the number of rows
    up to each."""
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_v"))
    span = F.percentile_approx("_v", [max(0.0, q - _MARGIN), min(1.0, q + _MARGIN)], ACCURACY)
    brackets = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        span.alias("_s"),
    )
    # Near the ends the bracket opens to the extreme value, which the rank may need.
    brackets = brackets.select(
        *by,
        "_n",
        F.when(F.lit(q - _MARGIN <= 0.0), F.col("_min")).otherwise(F.col("_s")[0]).alias("_lo"),
        F.when(F.lit(q + _MARGIN >= 1.0), F.col("_max")).otherwise(F.col("_s")[1]).alias("_hi"),
    )
    # A bracket of few values may lie between two neighbouring ranks, so the value next to it on
    # either side is kept as well.
    zoned = rows.join(brackets, by).withColumn(
        "_zone",
        F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0),
    )
    value = F.when(F.col("_zone") == 0, F.col("_v"))
    edge = F.when(F.col("_zone") < 0, F.max("_v")).otherwise(F.min("_v"))
    counts = (
        zoned.groupBy(*by, "_n", "_zone", value.alias("_value"))
        .agg(F.count("*").alias("_c"), edge.alias("_edge"))
        .select(*by, "_n", "_c", F.coalesce("_value", "_edge").alias("_v"))
    )
    upto = (
        Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    return counts.withColumn("_upto", F.sum("_c").over(upto))


def _at(place: Column) -> Column:
    """The value at a place that counts from 0."""
    return F.min(F.when(F.col("_upto") > place, F.col("_v")))


def exact_quantile(df: DataFrame, by: list[str], column: str, q: float, name: str) -> DataFrame:
    """(by..., name): the quantile with linear interpolation between neighbouring ranks."""
    place = (F.col("_n") - 1) * F.lit(q)
    return (
        _counted_near(df, by, column, q)
        .groupBy(*by, "_n")
        .agg(_at(F.floor(place)).alias("_a"), _at(F.ceil(place)).alias("_b"))
        .select(
            *by,
            (F.col("_a") + (F.col("_b") - F.col("_a")) * (place - F.floor(place))).alias(name),
        )
    )


def exact_element(df: DataFrame, by: list[str], column: str, q: float, name: str) -> DataFrame:
    """(by..., name): the value at place floor(n * q), counted from 0."""
    near = _counted_near(df, by, column, q).groupBy(*by, "_n")
    return near.agg(_at(F.floor(F.col("_n") * F.lit(q))).alias(name)).drop("_n")
