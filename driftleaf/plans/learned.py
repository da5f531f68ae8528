"""The learned search from end to end on one index: facts on its leaves, a filter and a margin for each
leaf, calibrated to a target of recall and coverage, then the search and its report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.models.fits import fit_linear, predict_linear
from driftleaf.operators.bounds import leaf_bounds
from driftleaf.operators.conformal import with_alpha
from driftleaf.operators.recall import recall_by_set, search_report
from driftleaf.plans.calibrate import Calibration, alpha_for_target, calibrate
from driftleaf.plans.evaluate import pruning_report, replay, with_calibrated
from driftleaf.plans.index import Index
from driftleaf.plans.search import knn_filtered
from driftleaf.plans.train import collect_facts, with_roles
from driftleaf.session import materialise


@dataclass
class Filters:
    """``lines``: (leaf_id, slope, intercept); ``calibration`` holds their margins at every position."""

    index: Index
    lines: DataFrame
    calibration: Calibration

    def at(self, recall: float, coverage: float) -> DataFrame:
        """(leaf_id, slope, intercept, alpha): filters set to a target; a leaf for which the target
        has no margin has no active filter."""
        margins = alpha_for_target(self.calibration.triples, recall, coverage)
        active = with_alpha(self.lines, margins).where(F.col("alpha").isNotNull() & ~F.isnan("alpha"))
        return materialise(active, "filters")


def learn_filters(index: Index, queries: DataFrame, n_batches: int, batch_size: int) -> Filters:
    """``queries``: (query_id, values) with ids from 0 without gaps; the first third trains, the last half
    calibrates."""
    facts = materialise(with_roles(collect_facts(index, queries), queries.count()), "facts")
    lines = materialise(fit_linear(facts.where(F.col("role") == "train")), "lines")
    held = materialise(predict_linear(facts.where(F.col("role") == "calib"), lines), "held")
    return Filters(index, lines, calibrate(held, n_batches, batch_size))


def predictions(index: Index, queries: DataFrame, active: DataFrame) -> DataFrame:
    """(query_id, leaf_id, lb, pred, alpha) of the leaves with an active filter."""
    asked = queries.select("query_id", F.col(index.route_column).alias("values"))
    bounds = leaf_bounds(asked, index.leaf, shipped=index.shipped_leaves)
    return predict_linear(bounds, active)


def filtered_search(index: Index, queries: DataFrame, k: int, active: DataFrame) -> DataFrame:
    return knn_filtered(index, queries, k, predictions(index, queries, active))


def filtered_report(
    index: Index, queries: DataFrame, active: DataFrame, truth: DataFrame,
    recall: float, coverage: float,
) -> DataFrame:
    """One row: recall and coverage of the search for the nearest series, and the leaves and series that
    it visits and prunes. ``truth``: the exact answers."""
    answers = filtered_search(index, queries, 1, active)
    quality = search_report(recall_by_set(answers, truth, 1), recall, coverage)
    facts = collect_facts(index, queries)
    said = predictions(index, queries, active).drop("lb")
    log = replay(with_calibrated(facts.join(said, ["query_id", "leaf_id"], "left")))
    work = pruning_report(log, index.leaf)
    return quality.join(work)  # one row each
