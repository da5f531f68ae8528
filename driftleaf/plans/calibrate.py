"""From predictions on held-out queries to one margin per leaf."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.operators.batches import balanced_batches, test_flag
from driftleaf.operators.conformal import conformal_alphas, residuals
from driftleaf.operators.recall import (
    recall_by_position,
    target_gaps,
    triples,
    unique_pairs,
    with_coverage,
)
from driftleaf.operators.surface import surface_at


@dataclass
class Calibration:
    alphas: DataFrame
    batches: DataFrame
    by_position: DataFrame
    triples: DataFrame


def calibrate(
    predicted: DataFrame, n_batches: int, batch_size: int, seed: str = "calibration"
) -> Calibration:
    """``predicted``: (query_id, leaf_id, lnn, pred) of the calibration queries."""
    queries = predicted.select("query_id").distinct()
    batches = balanced_batches(queries, n_batches, batch_size, seed)
    alphas = conformal_alphas(residuals(predicted))
    hits = recall_by_position(target_gaps(predicted), alphas, batches)
    covered = with_coverage(hits)
    rows = triples(unique_pairs(covered), alphas)
    return Calibration(alphas, batches, covered, rows)


def flagged(rows: DataFrame, share: float = 0.2, seed: str = "test") -> DataFrame:
    return test_flag(rows, ["recall", "coverage"], ["filter_id"], share, seed)


def alpha_for_target(rows: DataFrame, recall: float, coverage: float) -> DataFrame:
    """(leaf_id, alpha): every filter's surface evaluated at the target."""
    return surface_at(rows, [(recall, coverage)]).select(
        F.col("filter_id").alias("leaf_id"), F.col("error").alias("alpha")
    )
