"""Per-leaf regressors of the nearest distance inside a leaf.

``fit_linear`` stays in built-in aggregates. ``fit_per_leaf`` takes any (fit, predict) pair on
matrices; ridge and a small two-layer network are supplied. A leaf's training rows are the
training queries, a number fixed by parameters and independent of the number of series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.functions.series import segment_summary, segmentation, segments_literal
from driftleaf.session import ship_package


def fit_linear(train: DataFrame) -> DataFrame:
    """(leaf_id, slope, intercept) of lnn on lb; a leaf whose bounds do not vary gets its mean."""
    return train.groupBy("leaf_id").agg(
        F.coalesce(F.regr_slope("lnn", "lb"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("lnn", "lb"), F.avg("lnn")).alias("intercept"),
    )


def predict_linear(facts: DataFrame, model: DataFrame) -> DataFrame:
    return (
        facts.join(model, "leaf_id")
        .withColumn("pred", F.col("intercept") + F.col("slope") * F.col("lb"))
        .drop("slope", "intercept")
    )


def query_features(queries: DataFrame, length: int, n_segments: int = 8) -> DataFrame:
    """(query_id, features): segment means and deviations of the query."""
    summary = segment_summary(F.col("values"), segments_literal(segmentation(length, n_segments)))
    return queries.select("query_id", summary.alias("s")).select(
        "query_id", F.concat(F.col("s.mean"), F.col("s.std")).alias("features")
    )


@dataclass(frozen=True)
class Regressor:
    fit: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    predict: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _ridge_fit(x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray) -> np.ndarray:
    """Ridge on standardised features; the penalty with the smallest validation error wins."""
    mu, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    z, centre = (x - mu) / sd, y.mean()
    gram, right = z.T @ z, z.T @ (y - centre)
    best, best_err = None, np.inf
    for penalty in (0.1, 1.0, 10.0, 100.0):
        w = np.linalg.solve(gram + penalty * np.eye(len(mu)), right) / sd
        bias = centre - mu @ w
        err = np.mean((xv @ w + bias - yv) ** 2) if len(yv) else penalty
        if err < best_err:
            best, best_err = np.r_[bias, w], err
    return best


def _ridge_predict(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return weights[:, 0] + np.einsum("ij,ij->i", weights[:, 1:], x)


RIDGE = Regressor(_ridge_fit, _ridge_predict)


def mlp(hidden: int = 16, epochs: int = 200, rate: float = 0.02, leak: float = 0.01) -> Regressor:
    """Linear, leaky ReLU, linear; full-batch Adam on the squared error. The weights with the
    smallest validation error after half of the epochs are kept."""

    def unpack(w: np.ndarray, d: int) -> tuple[np.ndarray, ...]:
        mu, sd, rest = w[..., :d], w[..., d : 2 * d], w[..., 2 * d :]
        a = rest[..., : d * hidden].reshape(*w.shape[:-1], d, hidden)
        rest = rest[..., d * hidden :]
        return mu, sd, a, rest[..., :hidden], rest[..., hidden : 2 * hidden], rest[..., -1]

    def fit(x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        mu, sd = x.mean(0), x.std(0)
        sd = np.where(sd > 0, sd, 1.0)
        z, zv = (x - mu) / sd, ((xv - mu) / sd if len(yv) else xv)
        rng = np.random.default_rng(7)
        theta = np.r_[
            rng.normal(0, 1 / np.sqrt(d), d * hidden),
            np.zeros(hidden),
            rng.normal(0, 1 / np.sqrt(hidden), hidden),
            y.mean(),
        ]
        cut = (d * hidden, d * hidden + hidden, d * hidden + 2 * hidden)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        best, best_err = theta.copy(), np.inf

        def forward(t: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            pre = data @ t[: cut[0]].reshape(d, hidden) + t[cut[0] : cut[1]]
            act = np.where(pre > 0, pre, leak * pre)
            return pre, act, act @ t[cut[1] : cut[2]] + t[-1]

        for epoch in range(1, epochs + 1):
            pre, act, out = forward(theta, z)
            delta = 2.0 * (out - y) / len(y)
            back = np.outer(delta, theta[cut[1] : cut[2]]) * np.where(pre > 0, 1.0, leak)
            grad = np.r_[(z.T @ back).ravel(), back.sum(0), act.T @ delta, delta.sum()]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta - rate * (m / (1 - 0.9**epoch)) / (
                np.sqrt(v / (1 - 0.999**epoch)) + 1e-8
            )
            if epoch * 2 > epochs:
                err = np.mean((forward(theta, zv)[2] - yv) ** 2) if len(yv) else -epoch
                if err < best_err:
                    best, best_err = theta.copy(), err
        return np.r_[mu, sd, best]

    def predict(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        mu, sd, a, b, c, bias = unpack(weights, x.shape[1])
        pre = np.einsum("ij,ijk->ik", (x - mu) / sd, a) + b
        act = np.where(pre > 0, pre, leak * pre)
        return np.einsum("ij,ij->i", act, c) + bias

    return Regressor(fit, predict)


def fit_per_leaf(train: DataFrame, features: DataFrame, model: Regressor) -> DataFrame:
    """(leaf_id, weights). ``train``: (query_id, leaf_id, role, lnn) with roles train and valid."""
    ship_package(train.sparkSession)
    rows = train.select("query_id", "leaf_id", "role", "lnn").join(features, "query_id")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id")
        is_train = (pdf["role"] == "train").to_numpy()
        x = np.stack(pdf["features"].to_numpy()).astype(float)
        y = pdf["lnn"].to_numpy()
        if not is_train.any():
            return pd.DataFrame({"leaf_id": [], "weights": []})
        w = model.fit(x[is_train], y[is_train], x[~is_train], y[~is_train])
        return pd.DataFrame({"leaf_id": [pdf["leaf_id"].iloc[0]], "weights": [w]})

    return rows.groupBy("leaf_id").applyInPandas(fit, "leaf_id long, weights array<double>")


def predict_per_leaf(
    facts: DataFrame, features: DataFrame, weights: DataFrame, model: Regressor
) -> DataFrame:
    """Add ``pred`` for leaves that have weights; one Arrow batch at a time."""
    ship_package(facts.sparkSession)

    @F.pandas_udf("double")
    def predict(w: pd.Series, x: pd.Series) -> pd.Series:
        if not len(w):
            return pd.Series([], dtype=float)
        return pd.Series(model.predict(np.stack(w.to_numpy()), np.stack(x.to_numpy())))

    return (
        facts.join(weights, "leaf_id")
        .join(features, "query_id")
        .withColumn("pred", predict("weights", "features"))
        .drop("weights", "features")
    )
