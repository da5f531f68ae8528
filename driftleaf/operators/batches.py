"""Roles of training queries, calibration batches and test flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.functions.draws import unit_draw
from driftleaf.operators.running import with_running


def role_by_position(position: Column, n: int) -> Column:
    """Of ``n`` global training queries the first 2/6 train, the next 1/6 validate and the rest
    calibrate."""
    train, valid = n * 2 // 6, n // 6
    return (
        F.when(position < train, "train")
        .when(position < train + valid, "valid")
        .otherwise("calib")
    )


def local_role(position: Column, n: int | Column) -> Column:
    """Of ``n`` local queries the first 4/5 train and the rest validate."""
    return F.when(position < F.floor(F.lit(n) * 4 / 5), "train").otherwise("valid")


def role_by_ratio(position: Column, n: int, ratio: float = 0.9) -> Column:
    return F.when(position < int(n * ratio), "train").otherwise("valid")


def hash_place(df: DataFrame, seed: str, *keys: str) -> DataFrame:
    """Add ``place``: the position of each row in the hash order of ``keys``, from 0."""
    drawn = df.withColumn("_draw", unit_draw(seed, *[F.col(k) for k in keys]))
    order = [F.asc("_draw"), *[F.asc(k) for k in keys]]
    return with_running(drawn, order, number="place").drop("_draw")


def balanced_batches(
    queries: DataFrame, n_batches: int, batch_size: int, seed: str = "balanced"
) -> DataFrame:
    """(batch_id, slot, query_id): every query is used either the floor or the ceiling of the
    average number of times, in hash order."""
    n = queries.count()
    base, extra = divmod(n_batches * batch_size, max(1, n))
    placed = hash_place(queries.select("query_id"), f"{seed}/quota", "query_id")
    quota = F.lit(base) + F.when(F.col("place") < extra, 1).otherwise(0)
    uses = (
        placed.withColumn("quota", quota)
        .where(F.col("quota") > 0)
        .select("query_id", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("use"))
    )
    return hash_place(uses, f"{seed}/pool", "query_id", "use").select(
        F.floor(F.col("place") / batch_size).cast("int").alias("batch_id"),
        (F.col("place") % batch_size).cast("int").alias("slot"),
        "query_id",
    )


def uniform_batches(queries: DataFrame, n_batches: int, seed: str = "uniform") -> DataFrame:
    """(batch_id, slot, query_id): disjoint batches of equal size, at least three queries each;
    the last one takes the remainder."""
    n = queries.count()
    n_batches = max(1, min(n_batches, n // 3))
    size = max(1, n // n_batches)
    batch = F.least(F.floor(F.col("place") / size), F.lit(n_batches - 1))
    return hash_place(queries.select("query_id"), seed, "query_id").select(
        batch.cast("int").alias("batch_id"),
        (F.col("place") - batch * size).cast("int").alias("slot"),
        "query_id",
    )


def test_flag(df: DataFrame, keys: list[str], by: list[str], share: float, seed: str) -> DataFrame:
    """Add ``is_test``: 1 for the first floor(n * share) rows of each group in hash order."""
    parts = [F.col(k) for k in by]
    order = Window.partitionBy(*parts).orderBy(
        unit_draw(seed, *[F.col(k) for k in by + keys]), *[F.col(k) for k in keys]
    )
    size = F.count("*").over(Window.partitionBy(*parts))
    return df.withColumn(
        "is_test", (F.row_number().over(order) <= F.floor(size * F.lit(share))).cast("int")
    )
