"""Learned surfaces over all filters, and the dense per-filter spline."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftleaf.operators.augment import FEATURES, engineered, rank_curves, with_ranks
from driftleaf.operators.lookup import with_targets
from driftleaf.operators.metrics import regression_metrics
from driftleaf.operators.quantile import exact_quantile
from driftleaf.operators.surface import clean_triples, fit_grid, running_maximum
from driftleaf.session import materialise, ship_package, spread

PLAIN = ["recall", "coverage"]
LEVEL = ["level_mean", "level_max"]

# Rows of a task while boosted trees are fitted: about 700 bytes each with all features and its place in the trees.
FIT_ROWS = 200_000

# Fixed values of the thin-plate variant.
SPLINE_BASE, SPLINE_FACTOR, SPLINE_FALLBACK = 0.2, 2.5, 0.5


class BoostedSurface:
    """One boosted model for all filters: the filter enters through the mean and the largest
    error of its training triples, so the model does not grow with the number of filters. Rank
    features are read from the training rows' curves: a point's prediction is the same in any batch."""

    def __init__(
        self, model, levels: DataFrame, columns: list[str], curves: dict[str, DataFrame] | None
    ) -> None:
        self.model, self.levels, self.columns, self.curves = model, levels, columns, curves

    @staticmethod
    def fit(
        train: DataFrame, enhanced: bool = False, rounds: int = 20, depth: int = 4
    ) -> BoostedSurface:
        """The tasks of the fit follow the rows, so that none holds more as the table grows, and
        rows have one order in every run."""
        train = materialise(train.select("filter_id", *PLAIN, "error"), "training")
        levels = train.groupBy("filter_id").agg(
            F.avg("error").alias("level_mean"), F.max("error").alias("level_max")
        )
        columns = (FEATURES if enhanced else PLAIN) + LEVEL
        shell = BoostedSurface(None, levels, columns, rank_curves(train) if enhanced else None)
        learner = GBTRegressor(
            featuresCol="x", labelCol="error", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=42
        )
        dealt = spread(shell._narrow(train), "filter_id", *PLAIN, rows=train.count(), most=FIT_ROWS)
        ordered = dealt.sortWithinPartitions("filter_id", *PLAIN, "error")
        shell.model = learner.fit(shell._assembled(ordered).select("x", "error"))
        return shell

    def _narrow(self, rows: DataFrame) -> DataFrame:
        """The rows with what is joined to them, before the features widen them."""
        ranked = rows if self.curves is None else with_ranks(rows, self.curves)
        return ranked.join(self.levels, "filter_id")

    def _assembled(self, narrow: DataFrame) -> DataFrame:
        wide = narrow if self.curves is None else engineered(narrow)
        return VectorAssembler(inputCols=self.columns, outputCol="x").transform(wide)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``pred`` to (filter_id, recall, coverage, ...) rows of known filters."""
        return self.model.transform(self._assembled(self._narrow(rows))).withColumnRenamed(
            "prediction", "pred"
        ).drop("x", *LEVEL)

    def at_targets(
        self, filters: DataFrame, targets: Sequence[tuple[float, float]]
    ) -> DataFrame:
        """(filter_id, recall, coverage, error), rising on both axes."""
        rows = self.predict(with_targets(filters, targets)).select(
            "filter_id", "recall", "coverage", F.greatest("pred", F.lit(0.0)).alias("error")
        )
        return running_maximum(rows)

    def importances(self, spark: SparkSession) -> DataFrame:
        values = self.model.featureImportances.toArray().tolist()
        return spark.createDataFrame(
            list(zip(self.columns, values)), "feature string, importance double"
        )


def evaluate(model: BoostedSurface, rows: DataFrame) -> DataFrame:
    """Metrics on training and test rows."""
    scored = model.predict(rows).withColumnRenamed("error", "actual")
    return regression_metrics(scored, ["is_test"])


def quantile_surface(raw: DataFrame, quantile: float) -> DataFrame:
    """The quantile of the errors of each (filter, recall, coverage) cell, rising on both axes."""
    rounded = raw.withColumn("recall", F.round("recall", 6)).withColumn(
        "coverage", F.round("coverage", 6)
    )
    key = ["filter_id", "recall", "coverage"]
    return running_maximum(exact_quantile(rounded, key, "error", quantile, "error"))


def thin_plate_at(
    triples: DataFrame, targets: Sequence[tuple[float, float]], smoothing: float = 1e-3
) -> DataFrame:
    """(filter_id, target_r, target_c, error) from a smoothed thin-plate spline per filter through
    the nodes of its cleaned grid: at most 400 points, whatever the number of triples."""
    ship_package(triples.sparkSession)
    points = np.array(targets)

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
        return np.where(d2 > 0, 0.5 * d2 * np.log(np.where(d2 > 0, d2, 1.0)), 0.0)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["recall", "coverage"])
        xy = pdf[["recall", "coverage"]].to_numpy()
        low, span = xy.min(0), np.ptp(xy, axis=0)
        span = np.where(span > 0, span, 1.0)
        z, t = (xy - low) / span, (points - low) / span
        n = len(z)
        basis = np.c_[np.ones(n), z]
        if n < 3 or np.linalg.matrix_rank(basis) < 3:
            value = np.full(len(t), SPLINE_FALLBACK)
        else:
            full = np.zeros((n + 3, n + 3))
            full[:n, :n] = kernel(z, z) + smoothing * np.eye(n)
            full[:n, n:], full[n:, :n] = basis, basis.T
            w = np.linalg.solve(full, np.r_[pdf["error"].to_numpy(), np.zeros(3)])
            raw = kernel(t, z) @ w[:n] + np.c_[np.ones(len(t)), t] @ w[n:]
            value = np.maximum(SPLINE_BASE, SPLINE_BASE + SPLINE_FACTOR * raw)
        return pd.DataFrame(
            {"filter_id": pdf["filter_id"].iloc[0], "target_r": points[:, 0],
             "target_c": points[:, 1], "error": value}
        )

    nodes = fit_grid(clean_triples(triples))
    return nodes.groupBy("filter_id").applyInPandas(
        fit, "filter_id long, target_r double, target_c double, error double"
    )

