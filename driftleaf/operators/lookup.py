"""Matching of triples with target points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftleaf.session import materialise, spread

# The target grid and the match tolerance.
TARGET_RECALLS = (0.9, 0.91, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99, 0.995, 0.999, 1.0)
TARGET_COVERAGES = (0.85, 0.9, 0.95, 0.99, 1.0)
TOLERANCE = 0.001

TARGETS = [(r, c) for r in TARGET_RECALLS for c in TARGET_COVERAGES]


def targets_column(targets: Sequence[tuple[float, float]] = TARGETS) -> Column:
    return F.array(
        *[F.struct(F.lit(r).alias("recall"), F.lit(c).alias("coverage")) for r, c in targets]
    )


def with_targets(filters: DataFrame, targets: Sequence[tuple[float, float]] = TARGETS) -> DataFrame:
    """Every filter with every target point."""
    return filters.select("filter_id", F.explode(targets_column(targets)).alias("t")).select(
        "filter_id", "t.*"
    )


def actual_errors(
    triples: DataFrame,
    targets: Sequence[tuple[float, float]] = TARGETS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(filter_id, recall, coverage, actual_error, match): the mean error of the triples within
    the tolerance of a target on both axes; without any, that of the nearest triples, ties going
    to the smaller recall difference.

    Every triple meets the fixed list of targets and is reduced where it lies to the best
    distance code per filter and target; a second look at the triples then picks those that reach
    it. Distances that differ by less than a billionth count as equal."""
    t, key = F.col("t"), ["filter_id", "recall", "coverage"]
    stored = materialise(triples, "triples")
    rows = spread(stored, "filter_id", "recall", "coverage", rows=stored.count())
    met = rows.withColumn("t", F.explode(targets_column(targets)))
    inside = (F.abs(F.col("recall") - t["recall"]) <= tolerance) & (
        F.abs(F.col("coverage") - t["coverage"]) <= tolerance
    )
    best = met.groupBy(
        "filter_id", t["recall"].alias("target_r"), t["coverage"].alias("target_c")
    ).agg(
        F.avg(F.when(inside, F.col("error"))).alias("inside_error"),
        F.min(_distance_code(t["recall"], t["coverage"])).alias("code"),
    )
    reached = _distance_code(F.col("target_r"), F.col("target_c")) == F.col("code")
    return (
        rows.join(best, "filter_id")
        .where(reached)
        .groupBy(
            "filter_id", F.col("target_r").alias("recall"), F.col("target_c").alias("coverage")
        )
        .agg(F.avg("error").alias("near"), F.max("inside_error").alias("inside"))
        .select(
            *key,
            F.coalesce("inside", "near").alias("actual_error"),
            F.when(F.col("inside").isNotNull(), "exact").otherwise("nearest").alias("match"),
        )
    )


def with_actual_errors(
    predicted: DataFrame,
    triples: DataFrame,
    targets: Sequence[tuple[float, float]] = TARGETS,
) -> DataFrame:
    """(filter_id, recall, coverage, predicted_error, actual_error, match): the predictions of a model at
    the targets, ``predicted`` (filter_id, recall, coverage, error), next to what the triples say. A filter
    without triples has no actual error."""
    said = predicted.select("filter_id", "recall", "coverage", F.col("error").alias("predicted_error"))
    return said.join(actual_errors(triples, targets), ["filter_id", "recall", "coverage"], "left")


def _distance_code(target_r: Column, target_c: Column) -> Column:
    """Distance and then recall difference, in billionths, as an ordered pair."""
    dr, dc = F.abs(F.col("recall") - target_r), F.abs(F.col("coverage") - target_c)
    distance = F.sqrt(dr * dr + dc * dc)
    return F.struct(
        (distance * 1e9 + 0.5).cast("long").alias("distance"), (dr * 1e9 + 0.5).cast("long").alias("dr")
    )
