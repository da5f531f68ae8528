"""Leaf tables for members that already carry a leaf key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.functions.series import segment_summary, segments_literal
from driftleaf.operators.tree import pack_envelopes
from driftleaf.session import broadcast_if_small


def leaf_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("leaf_id").agg(F.count("*").alias("n"))


def segment_rows(members: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """One row per member and segment: (leaf_id, series_id, ord, off, len, mean, std)."""
    summary = segment_summary(F.col("values"), segments_literal(segments))
    return members.select("leaf_id", "series_id", F.posexplode(summary).alias("ord", "s")).select(
        "leaf_id", "series_id", "ord", "s.off", "s.len", "s.mean", "s.std"
    )


def region_stats(members: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """Minima and maxima per leaf and segment; combined on the map side."""
    return (
        segment_rows(members, segments)
        .groupBy("leaf_id", "ord", "off", "len")
        .agg(
            F.count("*").alias("n"),
            F.min("mean").alias("min_mean"),
            F.max("mean").alias("max_mean"),
            F.min("std").alias("min_std"),
            F.max("std").alias("max_std"),
        )
    )


def key_envelopes(members: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """(leaf_id, n, seg) for leaves given by a key."""
    return pack_envelopes(region_stats(members, segments))


def cluster_by_leaf(members: DataFrame, rows_per_task: int = 500_000) -> DataFrame:
    """One shuffle that brings the rows of a leaf together; leaves above the size are spread over
    several tasks."""
    sizes = members.groupBy("leaf_id").agg(
        F.ceil(F.count("*") / F.lit(rows_per_task)).cast("int").alias("_tasks")
    )
    return (
        members.join(broadcast_if_small(sizes, "sizes"), "leaf_id")
        .withColumn("_salt", F.pmod(F.xxhash64("series_id"), "_tasks"))
        .repartition("leaf_id", "_salt")
        .drop("_tasks", "_salt")
        .sortWithinPartitions("leaf_id")
    )
