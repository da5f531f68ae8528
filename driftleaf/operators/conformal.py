"""Conformal margins: sorted held-out residuals with sentinels, and ways to pick one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.operators.facts import valid_predictions
from driftleaf.settings import EPSILON_GAP


def residuals(predicted: DataFrame) -> DataFrame:
    """|pred - lnn| of valid predictions."""
    return valid_predictions(predicted).withColumn(
        "residual", F.abs(F.col("pred") - F.col("lnn"))
    )


def residual_stats(res: DataFrame, by: list[str]) -> DataFrame:
    return res.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.max("residual").alias("max_residual"),
        F.avg("residual").alias("mean_residual"),
        F.stddev_pop("residual").alias("std_residual"),
    )


def _curve(residual_rows: DataFrame, by: list[str], gap: float) -> DataFrame:
    """(by..., curve): 0, the sorted residuals and the sentinel above them. A group holds one row
    per calibration query."""
    sentinel = (
        F.greatest(
            F.max("residual"), F.avg("residual") + 3.0 * F.stddev_pop("residual")
        )
        + gap
    )
    return residual_rows.groupBy(*by).agg(
        F.concat(
            F.array(F.lit(0.0)), F.sort_array(F.collect_list("residual")), F.array(sentinel)
        ).alias("curve")
    )


def conformal_alphas(res: DataFrame) -> DataFrame:
    """(leaf_id, pos, alpha): 0, the sorted residuals, and a top sentinel
    max(largest, mean + 3 deviations)."""
    return _curve(res, ["leaf_id"], 0.0).select("leaf_id", F.posexplode("curve").alias("pos", "alpha"))


def batch_alphas(res: DataFrame, batches: DataFrame) -> DataFrame:
    """(leaf_id, batch_id, pos, alpha): the same per calibration batch, with a gap above the
    largest; a batch without valid residuals gets (0, 0.1)."""
    by = ["leaf_id", "batch_id"]
    joined = res.join(batches.select("batch_id", "slot", "query_id"), "query_id")
    every = res.select("leaf_id").distinct().withColumn(
        "batch_id", F.explode(F.sequence(F.lit(0), F.lit(_batch_count(batches) - 1)))
    )
    curve = F.coalesce("curve", F.array(F.lit(0.0), F.lit(0.1)))
    return every.join(_curve(joined, by, EPSILON_GAP), by, "left").select(
        *by, F.posexplode(curve).alias("pos", "alpha")
    )


def _batch_count(batches: DataFrame) -> int:
    return (batches.agg(F.max("batch_id")).first()[0] or 0) + 1


def alpha_at_position(alphas: DataFrame, pos: int) -> DataFrame:
    return alphas.where(F.col("pos") == pos).select("leaf_id", "alpha")


def alpha_at_confidence(alphas: DataFrame, confidence: float) -> DataFrame:
    """The margin at position floor(n * confidence), at most the last."""
    sized = alphas.groupBy("leaf_id").agg(F.count("*").alias("n"))
    pos = F.least(F.floor(F.col("n") * F.lit(confidence)), F.col("n") - 1)
    return alphas.join(sized, "leaf_id").where(F.col("pos") == pos).select("leaf_id", "alpha")


def max_alpha_by_position(batched: DataFrame) -> DataFrame:
    """Largest margin over the batches at each position."""
    return batched.groupBy("leaf_id", "pos").agg(F.max("alpha").alias("alpha"))


def mean_alpha(alphas: DataFrame) -> DataFrame:
    return alphas.agg(F.count("alpha").alias("n_filters"), F.avg("alpha").alias("mean_alpha"))


def with_alpha(leaf: DataFrame, alpha: DataFrame) -> DataFrame:
    """Set the margin of every leaf listed in ``alpha``; other leaves keep theirs."""
    fresh = alpha.select("leaf_id", F.col("alpha").alias("new_alpha"))
    old = F.col("alpha") if "alpha" in leaf.columns else F.lit(None).cast("double")
    return (
        leaf.join(fresh, "leaf_id", "left")
        .withColumn("alpha", F.coalesce("new_alpha", old))
        .drop("new_alpha")
    )
