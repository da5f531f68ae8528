"""Replay of the sequential search, its pruning ratios, and error records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.plans.search import calibrated
from driftleaf.session import ship_package

ACTIONS = np.array(["resident", "bound", "filter", "visit"])


def _walk(later: np.ndarray, lb: np.ndarray, lnn: np.ndarray, cal: np.ndarray):
    """Actions and distances to beat along one query's leaves in visiting order. Between two
    improvements of the best distance all decisions use the same value, so each run of leaves is
    decided at once."""
    n = len(lb)
    action = np.empty(n, dtype=np.int8)
    bsf = np.empty(n)
    best, at = np.inf, 0
    while at < n:
        rest = slice(at, n)
        decided = np.where(
            ~later[rest], 0, np.where(lb[rest] >= best, 1, np.where(cal[rest] > best, 2, 3))
        )
        better = np.flatnonzero(np.isin(decided, (0, 3)) & (lnn[rest] < best))
        end = n if not len(better) else at + int(better[0]) + 1
        action[at:end], bsf[at:end] = decided[: end - at], best
        if len(better):
            best = lnn[end - 1]
        at = end
    return action, bsf


def replay(facts: DataFrame) -> DataFrame:
    """(query_id, leaf_id, step, action, bsf) of a search for one neighbour that visits leaves one
    after the other: ``resident``, ``bound`` (pruned by the lower bound), ``filter`` (pruned by
    the calibrated prediction) or ``visit``; ``bsf`` is the distance to beat at that moment.
    ``facts``: (query_id, leaf_id, is_resident, lb, lnn, cal), ``cal`` NULL without a filter. A
    group is one query's leaves, at most as many as the tree has."""
    ship_package(facts.sparkSession)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["is_resident", "lb", "leaf_id"], ascending=[False, True, True])
        cal = pdf["cal"].to_numpy(dtype=float, na_value=np.nan)
        action, bsf = _walk(
            ~pdf["is_resident"].to_numpy(dtype=bool),
            pdf["lb"].to_numpy(),
            pdf["lnn"].to_numpy(),
            np.where(np.isnan(cal), -np.inf, cal),
        )
        return pd.DataFrame(
            {
                "query_id": pdf["query_id"].to_numpy(),
                "leaf_id": pdf["leaf_id"].to_numpy(),
                "step": np.arange(len(pdf)),
                "action": ACTIONS[action],
                "bsf": np.where(np.isinf(bsf), np.nan, bsf),
            }
        )

    columns = ["query_id", "leaf_id", "is_resident", "lb", "lnn", "cal"]
    return (
        facts.select(*columns)
        .groupBy("query_id")
        .applyInPandas(
            walk, "query_id long, leaf_id long, step int, action string, bsf double"
        )
        .withColumn("bsf", F.nanvl("bsf", F.lit(None).cast("double")))
    )


def with_calibrated(predicted: DataFrame) -> DataFrame:
    return predicted.withColumn("cal", calibrated(F.col("pred"), F.col("alpha")))


def pruning_report(log: DataFrame, leaf: DataFrame) -> DataFrame:
    """One row: visited and pruned leaves and series, and the share of series pruned in all, by
    filters and by bounds. Ratios are of all series of all queries."""
    rows = log.join(leaf.select("leaf_id", "n"), "leaf_id")

    def leaves(*actions: str):
        return F.count_if(F.col("action").isin(*actions))

    def series(*actions: str):
        return F.sum(F.when(F.col("action").isin(*actions), F.col("n")).otherwise(0))

    return rows.agg(
        leaves("resident", "visit").alias("visited_leaves"),
        leaves("filter").alias("filter_leaves"),
        leaves("bound").alias("bound_leaves"),
        series("resident", "visit").alias("visited_series"),
        (series("filter", "bound") / F.sum("n")).alias("pruned_ratio"),
        (series("filter") / F.sum("n")).alias("filter_ratio"),
        (series("bound") / F.sum("n")).alias("bound_ratio"),
    )


def prune_log(log: DataFrame, predicted: DataFrame) -> DataFrame:
    """One line per leaf pruned by its filter, with what it predicted and what was true."""
    facts = predicted.select("query_id", "leaf_id", "pred", "alpha", "cal", "lnn")
    return (
        log.where(F.col("action") == "filter")
        .join(facts, ["query_id", "leaf_id"])
        .select(
            "query_id",
            F.col("leaf_id").alias("node_id"),
            F.col("pred").alias("pred_raw_distance"),
            F.col("alpha").alias("error_calib"),
            F.col("cal").alias("predicted_nn_distance"),
            F.col("bsf").alias("minbsf"),
            (F.col("pred") - F.col("lnn")).alias("true_error"),
            F.col("lnn").alias("true_distance"),
        )
    )


def wrong_prunes(lines: DataFrame) -> DataFrame:
    """Pruned leaves that held something better than the distance to beat."""
    return lines.where(F.col("true_distance") < F.col("minbsf"))


def prediction_errors(answers: DataFrame, predicted: DataFrame) -> DataFrame:
    """(query_id, filter_id, true_nn_distance, predicted_distance, prediction_error, series_id,
    bsf_distance) at the leaf that holds the nearest neighbour."""
    first = answers.where(F.col("rank") == 1).select("query_id", "leaf_id", "series_id", "dist")
    return first.join(
        predicted.select("query_id", "leaf_id", "pred", "bsf"), ["query_id", "leaf_id"]
    ).select(
        "query_id",
        F.col("leaf_id").alias("filter_id"),
        F.col("dist").alias("true_nn_distance"),
        F.col("pred").alias("predicted_distance"),
        (F.col("pred") - F.col("dist")).alias("prediction_error"),
        "series_id",
        F.col("bsf").alias("bsf_distance"),
    )


def calibration_dump(
    residence: DataFrame, predicted: DataFrame, batches: DataFrame, margins: DataFrame
) -> DataFrame:
    """Per calibration batch, query and leaf with neighbours: distances, the signed error and the
    margin used (its last position). ``margins``: (leaf_id, batch_id, alpha)."""
    return (
        batches.select("batch_id", "query_id")
        .join(residence.select("query_id", "leaf_id"), "query_id")
        .join(
            predicted.select("query_id", "leaf_id", "lnn", "pred", "bsf"), ["query_id", "leaf_id"]
        )
        .join(margins, ["leaf_id", "batch_id"])
        .select(
            "batch_id",
            "query_id",
            F.col("leaf_id").alias("node_id"),
            F.col("lnn").alias("true_distance"),
            F.col("pred").alias("pred_distance"),
            F.col("bsf").alias("bsf_distance"),
            (F.col("pred") - F.col("lnn")).alias("true_error"),
            F.col("alpha").alias("abs_error"),
        )
    )
