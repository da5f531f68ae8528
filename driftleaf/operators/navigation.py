"""Learned visiting order: which leaves are likely to hold the neighbours of a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.operators.scan import to_matrix
from driftleaf.session import broadcast_if_small, materialise, pinned_table, share, ship_package, spread

PATH_SCHEMA = "node_id long, query_id long, child int, share double"
SCORE_SCHEMA = "query_id long, leaf_id long, score double"
# Pairs of a query and a node that a task scores at once.
_SCORED = 1 << 18


class Navigator:
    """Multinomial logistic regression from query features to the leaf that holds a neighbour,
    weighted by the share of neighbours. For trees of moderate size; above that, order leaves by
    their bound."""

    def __init__(self, model, leaves: DataFrame) -> None:
        self.model, self.leaves = model, leaves

    @staticmethod
    def fit(
        shares: DataFrame, features: DataFrame, leaf: DataFrame, max_iter: int = 20
    ) -> Navigator:
        """``shares``: (query_id, leaf_id, share)."""
        number = F.row_number().over(Window.orderBy("leaf_id")) - 1  # leaf metadata only
        leaves = leaf.select("leaf_id", number.cast("int").alias("leaf_no"))
        rows = (
            shares.join(leaves, "leaf_id")
            .join(features, "query_id")
            .select(
                F.col("leaf_no").cast("double").alias("label"),
                F.col("share").alias("weight"),
                array_to_vector("features").alias("x"),
            )
        )
        learner = LogisticRegression(
            featuresCol="x", weightCol="weight", family="multinomial", regParam=0.01,
            maxIter=max_iter,
        )
        return Navigator(learner.fit(rows), leaves)

    def scores(self, features: DataFrame) -> DataFrame:
        """(query_id, leaf_id, score). Leaves above the last one seen in fitting have no row; the
        searches count them as 0."""
        x = features.select("query_id", array_to_vector("features").alias("x"))
        known = (
            self.model.transform(x)
            .select("query_id", F.posexplode(vector_to_array("probability")).alias("leaf_no", "score"))
            .join(self.leaves, "leaf_no")
        )
        return known.select("query_id", "leaf_id", "score")


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(leaf_id, node_id, child): every inner node above a leaf, and which of its children leads there. One
    join a level of the tree, over rows of leaves."""
    above = materialise(
        nodes.alias("n").join(
            nodes.select(F.col("node_id").alias("up"), F.col("first_child").alias("first")), F.col("n.parent_id") == F.col("up")
        ).select("node_id", "up", (F.col("node_id") - F.col("first")).cast("int").alias("child")),
        "parents",
    )
    at = nodes.where("is_leaf").select(F.col("node_id").alias("leaf_id"), F.col("node_id").alias("at"))
    found = None
    while True:
        step = at.join(above, F.col("at") == F.col("node_id")).select("leaf_id", F.col("up").alias("node_id"), "child")
        step = materialise(step, "paths")
        if step.isEmpty():
            return found if found is not None else step
        found = step if found is None else found.unionByName(step)
        at = step.select("leaf_id", F.col("node_id").alias("at"))


def fit_softmax(x: np.ndarray, share: np.ndarray, l2: float = 1e-2, steps: int = 300) -> np.ndarray:
    """Weights (classes x features + 1) of a softmax regression on shares, by accelerated gradient steps on
    scaled features."""
    middle, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    x = np.hstack([(x - middle) / scale, np.ones((len(x), 1))])
    weight = share.sum(1, keepdims=True)
    total = weight.sum()
    rate = 1.0 / (0.5 * float((weight[:, 0] * (x * x).sum(1)).sum() / total) + l2)
    w = ahead = np.zeros((share.shape[1], x.shape[1]))
    for step in range(steps):
        logit = x @ ahead.T
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = (weight * p - share).T @ x / total + l2 * ahead
        new = ahead - rate * slope
        ahead, w = new + step / (step + 3) * (new - w), new
    plain = w[:, :-1] / scale
    return np.hstack([plain, w[:, -1:] - (plain @ middle)[:, None]])


class _Paths:
    """The links of a tree and the weights of its fitted nodes as arrays, for walks inside the tasks."""

    def __init__(self, nodes: pa.Table, weights: pa.Table | None, fan: int) -> None:
        nodes = nodes.sort_by("node_id").combine_chunks()
        self.ids, self.fan = nodes.column("node_id").to_numpy().astype(np.int64), fan
        self.is_leaf = nodes.column("is_leaf").to_numpy(zero_copy_only=False).astype(bool)
        parent = nodes.column("parent_id").fill_null(-1).to_numpy().astype(np.int64)
        first = nodes.column("first_child").fill_null(-1).to_numpy().astype(np.int64)
        self.parent_at, self.first_at = self._at(parent), self._at(first)
        above = np.where(self.parent_at >= 0, self.parent_at, 0)
        self.child = np.where(self.parent_at >= 0, self.ids - first[above], 0).astype(np.int32)
        self.root = int(np.flatnonzero(parent < 0)[0])
        self.fitted, self.weights = np.full(len(self.ids), -1), np.zeros((0, fan, 1))
        if weights is not None and weights.num_rows:
            self.fitted[self._at(weights.column("node_id").to_numpy())] = np.arange(weights.num_rows)
            self.weights = np.array(weights.column("weights").to_pylist(), float)

    def _at(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def above(self, leaf_ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, node id, child) of the nodes above the leaves, a level at a time."""
        at = self._at(leaf_ids)
        row = np.flatnonzero((at >= 0) & self.is_leaf[at])
        at = at[row]
        while True:
            held = self.parent_at[at] >= 0
            row, at = row[held], at[held]
            if not len(row):
                return
            yield row, self.ids[self.parent_at[at]], self.child[at]
            at = self.parent_at[at]

    def scores(self, x: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, leaf id, score), a level at a time."""
        x = np.hstack([x, np.ones((len(x), 1))])
        row, at, score = np.arange(len(x)), np.full(len(x), self.root), np.ones(len(x))
        while len(row):
            ends = self.is_leaf[at]
            yield row[ends], self.ids[at[ends]], score[ends]
            row, at, score = row[~ends], at[~ends], score[~ends]
            part = np.full((len(row), self.fan), 1.0 / self.fan)
            fitted = self.fitted[at]
            known = np.flatnonzero(fitted >= 0)
            if len(known):
                logit = np.einsum("ij,ikj->ik", x[row[known]], self.weights[fitted[known]])
                raised = np.exp(logit - logit.max(1, keepdims=True))
                part[known] = raised / raised.sum(1, keepdims=True)
            at = (self.first_at[at][:, None] + np.arange(self.fan)).ravel()
            row, score = np.repeat(row, self.fan), (score[:, None] * part).ravel()
            kept = score >= least
            row, at, score = row[kept], at[kept], score[kept]


def _shipped(nodes: DataFrame, weights: DataFrame | None, fan: int) -> Broadcast | None:
    """The tree in the tasks' memory, if it fits the broadcast budget."""
    width = 64 + 256 * fan
    links = pinned_table(nodes, ["node_id", "parent_id", "first_child", "is_leaf"], width)
    if links is None or not links.num_rows:
        return None
    # Not more rows than the tree has nodes.
    fitted = None if weights is None else weights.toArrow()
    return share(nodes.sparkSession, _Paths(links, fitted, fan))


class TreeNavigator:
    """A small classifier at every inner node, which gives the share of a query's neighbours below each of
    its children; the score of a leaf is the product along its path. So no model has a class a leaf, the nodes
    are fitted independently, and the scores of all leaves of a query sum to 1. A node without
    training rows shares evenly.

    A tree that fits the broadcast budget is shipped, and the tasks walk its paths; a larger one is met level by
    level in joins."""

    def __init__(self, nodes: DataFrame, weights: DataFrame, fan: int) -> None:
        self.nodes, self.weights, self.fan = nodes, weights, fan

    @staticmethod
    def fit(shares: DataFrame, features: DataFrame, nodes: DataFrame, fan: int) -> TreeNavigator:
        """``shares``: (query_id, leaf_id, share); ``features``: (query_id, features). A group is what the
        training queries, whose number is a parameter, have below one node."""
        ship_package(shares.sparkSession)
        below = (
            _share_paths(shares, nodes, fan)
            .groupBy("node_id", "query_id", "child")
            .agg(F.sum("share").alias("share"))
            .join(features, "query_id")
        )

        def fit_node(pdf: pd.DataFrame) -> pd.DataFrame:
            queries = pdf.drop_duplicates("query_id").sort_values("query_id")
            x = np.stack(queries["features"].to_numpy())
            share = np.zeros((len(queries), fan))
            row = np.searchsorted(queries["query_id"].to_numpy(), pdf["query_id"].to_numpy())
            np.add.at(share, (row, pdf["child"].to_numpy()), pdf["share"].to_numpy())
            w = fit_softmax(x, share)
            return pd.DataFrame({"node_id": [pdf["node_id"].iloc[0]], "weights": [[list(r) for r in w]]})

        fitted = spread(below, "node_id").groupBy("node_id").applyInPandas(fit_node, "node_id long, weights array<array<double>>")
        return TreeNavigator(nodes, materialise(fitted, "navigator"), fan)

    def scores(self, features: DataFrame, least: float = 0.0) -> DataFrame:
        """(query_id, leaf_id, score), from the root down by levels; with ``least`` nothing below a node whose
        share is smaller is looked at, and its leaves have no row (the searches count them as 0)."""
        shared = _shipped(self.nodes, self.weights, self.fan)
        if shared is None:
            return self._scores_by_join(features, least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            paths = shared.value
            step = max(1, _SCORED // len(paths.ids))
            for batch in batches:
                ids = batch.column("query_id").to_numpy(zero_copy_only=False)
                x = to_matrix(batch.column("features"))
                for lo in range(0, len(x), step):
                    for row, leaf, score in paths.scores(x[lo : lo + step], least):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[lo : lo + step][row], pa.int64()), pa.array(leaf), pa.array(score)],
                            names=["query_id", "leaf_id", "score"],
                        )

        return spread(features.select("query_id", "features"), "query_id").mapInArrow(run, SCORE_SCHEMA)

    def _scores_by_join(self, features: DataFrame, least: float) -> DataFrame:
        """The same rows for a tree of any size."""
        inner = self.nodes.where("NOT is_leaf").join(self.weights, "node_id", "left")
        rows = features.select("query_id", "features", F.lit(1).cast("long").alias("at"), F.lit(1.0).alias("score"))
        root_leaf = self.nodes.where("node_id = 1 AND is_leaf").select(F.lit(1).cast("long").alias("only"))
        out = rows.join(F.broadcast(root_leaf), F.col("at") == F.col("only")).select("query_id", F.col("only").alias("leaf_id"), "score")
        even = F.array_repeat(F.lit(1.0 / self.fan), self.fan)

        def logit(w: Column) -> Column:
            one = F.concat(F.col("features"), F.array(F.lit(1.0)))
            return F.aggregate(F.zip_with(w, one, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

        depth = 0
        while True:
            level = inner.where(F.col("depth") == depth).select("node_id", "first_child", "weights")
            level = broadcast_if_small(level, "level", 64 + 256 * self.fan)
            met = rows.join(level, F.col("at") == F.col("node_id"))
            logits = F.transform("weights", logit)
            raised = F.transform("logits", lambda v: F.exp(v - F.array_max("logits")))
            split = met.withColumn("logits", logits).withColumn("raised", raised).withColumn(
                "p", F.when(F.col("weights").isNull(), even).otherwise(
                    F.transform("raised", lambda v: v / F.aggregate("raised", F.lit(0.0), lambda a, b: a + b)))
            )
            split = split.select("query_id", "features", "first_child", "score", F.posexplode("p").alias("child", "part"))
            split = split.select(
                "query_id", "features", (F.col("first_child") + F.col("child")).alias("at"), (F.col("score") * F.col("part")).alias("score")
            ).where(F.col("score") >= least)
            kinds = self.nodes.where(F.col("depth") == depth + 1).select(F.col("node_id").alias("kind_of"), "is_leaf")
            split = materialise(split.join(broadcast_if_small(kinds, "kinds"), F.col("at") == F.col("kind_of")), "shares")
            out = out.unionByName(split.where("is_leaf").select("query_id", F.col("at").alias("leaf_id"), "score"))
            rows = split.where("NOT is_leaf").select("query_id", "features", "at", "score")
            if rows.isEmpty():
                return out
            depth += 1


def _share_paths(shares: DataFrame, nodes: DataFrame, fan: int) -> DataFrame:
    """(node_id, query_id, child, share): the shares at every inner node above their leaves."""
    columns = ["node_id", "query_id", "child", "share"]
    shared = _shipped(nodes, None, fan)
    if shared is None:
        return shares.join(leaf_paths(nodes), "leaf_id").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, share_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("query_id", "share"))
            for row, node, child in shared.value.above(batch.column("leaf_id").to_numpy(zero_copy_only=False)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(query[row], pa.int64()), pa.array(child), pa.array(share_[row], pa.float64())],
                    names=columns,
                )

    return shares.select("query_id", "leaf_id", "share").mapInArrow(run, PATH_SCHEMA)


def combined_scores(scores: DataFrame, bounds: DataFrame, weight: float = 0.2) -> DataFrame:
    """(query_id, leaf_id, score): weight * scaled score + (1 - weight) * (1 - scaled bound),
    both scaled to [0, 1] per query. ``bounds`` leaves the resident leaf out."""
    per_query = Window.partitionBy("query_id")

    def scaled(c: str):
        low, high = F.min(c).over(per_query), F.max(c).over(per_query)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)

    s = scores.withColumn("s", scaled("score"))
    b = bounds.withColumn("b", scaled("lb"))
    return b.join(s.select("query_id", "leaf_id", "s"), ["query_id", "leaf_id"], "left").select(
        "query_id",
        "leaf_id",
        (weight * F.coalesce("s", F.lit(0.0)) + (1.0 - weight) * (1.0 - F.col("b"))).alias("score"),
    )
